"""Token-id output: ORC files in ascending document order.

``write_tokens`` encodes every whole text and writes (doc_id, pos, ids) as ORC:
ids are integer run-length encoded, each stripe has row indexes, and doc_id has
Bloom filters, so a reader opens stripes in parallel and skips those without the
ids it asks for. Documents are range-partitioned and sorted by doc_id, so file
part numbers and the rows in a file ascend. Besides the ids a row has their number
``n`` and ``pos``, the ids before the document in its file; the sums of ``n`` over
earlier files, a scan of that column alone, give the document's place in the whole
sequence. No token array is shuffled: a file's rows get its sum by a broadcast of one
row per file, and what is computed from the ids is computed where they are read.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts
first; rows with one doc_id are all written, ordered by a hash of their text;
an empty table writes no rows; extra input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linklens.llm import texts as X
from linklens.llm.steps import Steps, batches_of
from linklens.llm.tokens import WordIds, default_path, opened
from linklens.session import broadcast_if_small

FILE = "doc_id long, pos long, n int, ids array<int>"
BATCH_ROWS = 256        # texts, or token arrays, that a worker holds at once
FILES_BLOCK = 4096      # files whose sums one window task adds up


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode ``docs`` and write the ORC files under ``path``."""
    text = F.coalesce("text", F.lit(""))
    # the hash lets rows of one id, or without, go to several files
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
               .repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = opened(WordIds, tokenizer)
        pos = 0
        for b in batches:
            for row, data, off in X.pieces(b.column(1)):
                raw = data.tobytes()
                ids = [words.encode(raw[s:e]) + end for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
                n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
                bounds = np.concatenate([[0], np.cumsum(n)])
                flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, len(ids)), pa.array(pos + bounds[:-1]), pa.array(n.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))],
                    names=["doc_id", "pos", "n", "ids"])
                pos += int(bounds[-1])

    with batches_of(docs.sparkSession, BATCH_ROWS):
        (ordered.mapInArrow(encode, FILE).write.option("orc.compress", "zstd")
         .option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", "1000").orc(path))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``part``, the number of their file."""
    return (spark.read.schema(FILE).orc(path)
            .withColumn("part", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")))


def _before(spark: SparkSession, path: str, steps: Steps) -> DataFrame:
    """(part, before): the ids of all earlier files, one row per file. Sums run within
    blocks of files, and over the blocks."""
    files = _scan(spark, path).groupBy("part").agg(F.sum(F.col("n").cast("long")).alias("n"))
    files = steps.table(files.withColumn("block", F.floor(F.col("part") / FILES_BLOCK)), "files")
    inside = Window.partitionBy("block").orderBy("part")
    over = Window.partitionBy(F.lit(0)).orderBy("block")      # one row per block
    blocks = files.groupBy("block").agg(F.sum("n").alias("b"))
    blocks = blocks.select("block", (F.sum("b").over(over) - F.col("b")).alias("base"))
    return steps.table(files.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(blocks, "block")
                       .select("part", (F.col("base") + F.col("inside")).alias("before")), "before")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): ``start`` counts the ids of all documents before."""
    before = broadcast_if_small(_before(spark, path, Steps(spark, "tokens")))
    return _scan(spark, path).join(before, "part").select(
        "doc_id", (F.col("before") + F.col("pos")).alias("start"), "ids")


def op4_token_orc(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract's digest, computed from the files read back."""
    spark = docs.sparkSession
    steps = Steps(spark, "tokens")
    path = steps.path("orc")
    write_tokens(docs, path, tokenizer or default_path("word_bpe_49k.json"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            off = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pc.list_value_length(ids).cast(pa.int64()),
                 pa.array(crc, type=pa.int64())], names=["part", "doc_id", "pos", "n_tokens", "ids_crc32"])

    rows = _scan(spark, path).select("part", "doc_id", "pos", "ids").mapInArrow(
        digest, "part int, doc_id long, pos long, n_tokens long, ids_crc32 long")
    with batches_of(spark, BATCH_ROWS):
        rows = steps.table(rows, "digest")
    return (rows.join(broadcast_if_small(_before(spark, path, steps)), "part")
            .select("doc_id", (F.col("before") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32"))
