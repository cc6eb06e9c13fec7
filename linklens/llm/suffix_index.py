"""Suffix-array dedup with a logarithmic family of indexes.

Documents arrive in batches. The suffixes of a batch that start at anchor
positions (see ``repeats``; every window of ``min_bytes`` bytes holds one) are
put into a sorted array: one row per different anchor text, ordered by its
fingerprint, with the smallest and largest fingerprint of the text around it.
The array is merge-scanned against every existing level (a sort-merge join of
two sorted arrays); what both hold is a long match or a candidate for one. Then
it enters the family like a bit enters a binary counter: two levels of equal
rank merge into one of the next rank, so n batches make at most log2(n) + 1
levels and each suffix is rewritten log2(n) times.

The arrays are sparse and ordered by fingerprints, not by text: only equality
over at least ``min_bytes`` bytes is asked of them, never the order beyond it.

A byte is removed if a ``min_bytes``-byte string that covers it also starts
anywhere else, in the same document or another (overlaps count). Strings are
judged on the input; matches never cross documents.

Defined cases: a null or empty text has no bytes; repeated rows are documents of
their own, so they repeat each other; a null doc_id is an id like any other;
extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm import repeats as R
from linklens.llm.steps import Steps

RESULT = ("doc_id long, n_bytes long, n_removed long, kept binary, "
          "spans array<struct<start:int,end:int>>")


def _merge(rows: DataFrame) -> DataFrame:
    """One row per anchor text: range of its contexts, and its occurrences (2 = several)."""
    return rows.groupBy("kmer").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                    F.sum("s").alias("s"))


class IndexFamily:
    """Levels of sorted arrays; ``insert`` scans and merges one batch."""

    def __init__(self, steps: Steps):
        self.steps = steps
        self.levels: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []

    def _sorted(self, rows: DataFrame, name: str) -> DataFrame:
        return self.steps.table(rows.sortWithinPartitions("kmer"), name)

    def insert(self, anchor_rows: DataFrame) -> None:
        array = self._sorted(_merge(anchor_rows.select(
            "kmer", F.col("hull").alias("lo"), F.col("hull").alias("hi"),
            F.lit(1).cast("long").alias("s"))), "array")
        self.matches.append(self.steps.table(array.filter("s > 1"), "matches"))
        for level in self.levels.values():
            a, b = array.alias("a"), level.alias("b")
            hit = (a.hint("merge").join(b, F.col("a.kmer") == F.col("b.kmer"))
                   .select("a.kmer", F.least("a.lo", "b.lo").alias("lo"),
                           F.greatest("a.hi", "b.hi").alias("hi"),
                           (F.col("a.s") + F.col("b.s")).alias("s")))
            self.matches.append(self.steps.table(hit, "matches"))
        rank = 0
        while rank in self.levels:
            level = self.levels.pop(rank)
            merged = self._sorted(_merge(array.unionByName(level)), "level")
            self.steps.drop(array, level)
            array, rank = merged, rank + 1
        self.levels[rank] = array

    def repeated(self) -> DataFrame:
        """Anchor texts found twice or more: (kmer, one), one = all contexts are equal."""
        found = reduce(DataFrame.unionByName, self.matches)
        return (found.groupBy("kmer").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .select("kmer", (F.col("lo") == F.col("hi")).alias("one")))


def suffix_dedup(docs: DataFrame, min_bytes: int = 200, gram: int = 48,
                 batches: int = 4) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, spans): ``kept`` is the remaining bytes,
    ``spans`` the maximal removed byte ranges [start, end)."""
    unit = R.Unit(words=False, W=min_bytes, k=gram)
    steps = Steps(docs.sparkSession, "suffix")
    keyed = R.keyed(docs)
    family = IndexFamily(steps)
    for i in range(batches):
        batch = keyed.filter(F.pmod("th", F.lit(batches)) == i)
        family.insert(R.anchors(batch, unit))
    repeated = steps.table(family.repeated(), "repeated")

    met = steps.table(R.anchors(keyed, unit).join(repeated, "kmer"), "met")
    whole = met.filter("one").select("doc_id", "th", "start", "n")

    # several contexts of one anchor: one occurrence of each context is compared further
    some = met.filter("NOT one")
    hulls = steps.table(some.groupBy("kmer", "hull").agg(
        F.count(F.lit(1)).alias("val"),
        F.min(F.struct("doc_id", "th", "start", "n", "u")).alias("at")), "hulls")
    copies = (some.join(hulls.filter("val > 1").select("kmer", "hull"), ["kmer", "hull"])
              .select("doc_id", "th", "start", "n"))
    copies = steps.table(copies, "copies")
    pending = hulls.select("kmer", "at.*", "val")
    split = R.resolve(pending, keyed, unit, R.ANYWHERE, (8, 1), steps)

    with_gone = R.covered(keyed, [whole, copies, *split])

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            for row, data, off, uo, mask in R.removal_masks(b, unit):
                total = np.concatenate([[0], np.cumsum(mask)])
                removed = np.diff(total[uo])
                starts, ends, run_off = R.runs(mask, uo)
                kept = []
                for i in range(len(off) - 1):
                    part = data[off[i]:off[i + 1]]
                    if removed[i]:
                        part = part[~mask[off[i]:off[i + 1]]]
                    kept.append(part.tobytes())
                base = np.repeat(uo[:-1], np.diff(run_off))
                spans = pa.StructArray.from_arrays(
                    [pa.array((starts - base).astype(np.int32)),
                     pa.array((ends - base).astype(np.int32))], names=["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, len(kept)), pa.array(np.diff(off)), pa.array(removed),
                     pa.array(kept, type=pa.binary()),
                     pa.ListArray.from_arrays(pa.array(run_off.astype(np.int32)), spans)],
                    names=["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    return with_gone.mapInArrow(cut, RESULT)


def op8_suffix_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest of the 200-byte dedup."""
    return (suffix_dedup(docs)
            .select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256")))
