"""Substring dedup: seed and extend on words.

Documents are joined on winnowed anchors (the seeds), matches are extended to
both sides of the anchor as far as the text agrees, and every repeat of at least
``min_words`` words is found; a later document loses the words that such a
repeat covers, the document with the smallest doc_id keeps them. See
``repeats`` for the anchors and the extension.

Defined cases: a null or empty text has no words; a text shorter than the
threshold loses nothing; rows with one doc_id are never earlier than each other;
a row with a null doc_id is neither earlier nor later than any row, so it stays
whole and removes nothing; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm import repeats as R
from linklens.llm import texts as X
from linklens.llm.steps import Steps

RESULT = ("doc_id long, n_words long, n_removed long, kept string, "
          "spans array<struct<start:int,end:int>>")


def substring_dedup(docs: DataFrame, min_words: int = 50, gram: int = 12) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): ``kept`` joins the remaining words by
    one space; ``spans`` are the removed word ranges [start, end)."""
    unit = R.Unit(words=True, W=min_words, k=gram)
    steps = Steps(docs.sparkSession, "substring")
    keyed = R.keyed(docs)
    seeds = steps.table(R.anchors(keyed.filter("doc_id IS NOT NULL"), unit), "seeds")

    # one row per anchor k-gram that occurs in two documents
    shared = (seeds.groupBy("kmer")
              .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                   F.min("hull").alias("lo"), F.max("hull").alias("hi"))
              .filter("first < last")
              .select("kmer", "first", (F.col("lo") == F.col("hi")).alias("one")))
    shared = steps.table(shared, "shared")
    met = steps.table(seeds.join(shared, "kmer"), "met")
    steps.drop(seeds, shared)
    whole = met.filter("one AND doc_id > first").select("doc_id", "th", "start", "n")

    # several contexts of one anchor: the first document of each context is compared further
    some = met.filter("NOT one")
    firsts = steps.table(some.groupBy("kmer", "hull").agg(F.min("doc_id").alias("owner")), "firsts")
    owned = steps.table(some.join(firsts, ["kmer", "hull"])
                        .select("kmer", "doc_id", "th", "start", "n", "u", "owner"), "owned")
    later = owned.filter("doc_id > owner").select("doc_id", "th", "start", "n")
    pending = owned.filter("doc_id = owner").withColumnRenamed("owner", "val").distinct()
    split = R.resolve(pending, keyed, unit, R.EARLIER, (8, 1), steps)

    with_gone = R.covered(keyed, [whole, later, *split])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, off, uo, mask in R.removal_masks(b, unit):
                raw = data.tobytes()
                total = np.concatenate([[0], np.cumsum(mask)])
                starts, ends, run_off = R.runs(mask, uo)
                kept = []
                for i in range(len(off) - 1):
                    words = raw[off[i]:off[i + 1]].split()
                    if total[uo[i + 1]] > total[uo[i]]:
                        words = [w for w, m in zip(words, mask[uo[i]:uo[i + 1]].tolist()) if not m]
                    kept.append(b" ".join(words))
                base = np.repeat(uo[:-1], np.diff(run_off))
                spans = pa.StructArray.from_arrays(
                    [pa.array((starts - base).astype(np.int32)),
                     pa.array((ends - base).astype(np.int32))], names=["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, len(kept)), pa.array(np.diff(uo)),
                     pa.array(np.diff(total[uo])),
                     pa.array(kept, type=pa.binary()).cast(pa.string()),
                     pa.ListArray.from_arrays(pa.array(run_off.astype(np.int32)), spans)],
                    names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return with_gone.mapInArrow(cut, RESULT)


def op1_substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest of the 50-word dedup."""
    return (substring_dedup(docs)
            .select("doc_id", "n_words", "n_removed",
                    F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))
