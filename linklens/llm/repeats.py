"""Repeated passages: which windows of W consecutive units occur more than once.

Shared by the substring dedup (units are words) and the suffix-array dedup
(units are bytes). Nothing here compares documents pairwise.

1. Anchors. The leftmost smallest hash among the k-grams of a window is its
   anchor. Equal windows have equal anchors at equal offsets, so only windows
   with the same anchor k-gram (``kmer``) can be equal. Consecutive windows with
   one anchor are one row: (kmer, hull, start, n, u) where the n windows start
   at ``start``.., ``u`` is the anchor's distance from ``start`` and ``hull`` is
   the fingerprint of all their text together.
2. Extension. Per kmer only the smallest and largest hull and a summary of the
   documents are kept. One occurrence: nothing repeats. One hull: all of its
   windows repeat. Several hulls: the text left and right of the anchor agrees
   for some windows only; one representative of each different hull is then
   split into blocks of windows, and again down to single windows, until every
   block is decided. A block's ``core`` is the text all its windows share.

Every step is a partially aggregated groupBy or an equi-join whose skewed side
adaptive execution can split; copies collapse before they are shuffled again.

Identity of a window is its kmer and its fingerprint, 128 bits together.

Rows are known by (doc_id, th) with th a hash of the text, so repeated rows and
null ids keep their own texts. Joins on them are null-safe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm import texts as X
from linklens.llm.steps import Steps

ANCHORS = "kmer long, hull long, doc_id long, th long, start int, n int, u int"
BLOCKS = "kmer long, block int, core long, hull long, doc_id long, th long, start int, n int, u int, val long"


@dataclass(frozen=True)
class Unit:
    """What a window counts: W units, anchored on k-grams; ``words`` or bytes."""
    words: bool
    W: int
    k: int

    def spans(self, data: np.ndarray, off: np.ndarray) -> tuple[X.Spans, np.ndarray]:
        if not self.words:
            return X.Spans(X.BYTE_VALUE[data]), off
        s, e, word_off = X.word_spans(data, off)
        return X.Spans(X.word_hashes(data, s, e)), word_off


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) of the documents; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"),
                       text.alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """Anchor rows of ``keyed`` documents; texts shorter than a window have none."""
    W, k = unit.W, unit.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            for row, data, off in X.pieces(b.column(2)):
                sp, uo = unit.spans(data, off)
                length = np.diff(uo)
                n_win = np.maximum(length - W + 1, 0)
                starts = X.ranges(uo[:-1], n_win)
                if not len(starts):
                    continue
                at = np.arange(uo[-1] - k + 1)
                grams = sp.hash(at, at + k)
                anchor = X.sliding_argmin(grams, W - k + 1)[starts]
                doc = np.repeat(np.arange(len(n_win)), n_win)
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(starts)))
                s, p, d = starts[first], anchor[first], doc[first]
                u = p - s
                hull = X.mix(sp.hash(s, s + n - 1 + W) ^ (u.astype(X.U) << X.U(32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[p].view(np.int64)), pa.array(hull.view(np.int64)),
                     ids.take(pa.array(row + d)), pa.array(th[row + d]),
                     pa.array((s - uo[d]).astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(u.astype(np.int32))],
                    names=["kmer", "hull", "doc_id", "th", "start", "n", "u"])

    return docs.mapInArrow(run, ANCHORS)


def blocks(pending: DataFrame, docs: DataFrame, unit: Unit, size: int) -> DataFrame:
    """Split pending anchor rows (kmer, doc_id, th, start, n, u, val) into blocks of
    ``size`` window offsets, with the fingerprints of each block's core and hull."""
    W = unit.W
    todo = (pending.groupBy("doc_id", "th")
            .agg(F.collect_list(F.struct("kmer", "start", "n", "u", "val")).alias("todo")))
    joined = (docs.join(todo, same_row(docs, todo))
              .select(docs["doc_id"], docs["th"], docs["text"], todo["todo"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            todo_off = b.column(3).offsets.to_numpy()
            items = b.column(3).values
            kmer, start, n, u, val = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64)
                                      for i in range(5))
            for row, data, off in X.pieces(b.column(2)):
                sp, uo = unit.spans(data, off)
                rows = len(off) - 1
                lo, hi = todo_off[row], todo_off[row + rows]
                doc = np.repeat(np.arange(rows), np.diff(todo_off[row:row + rows + 1]))
                p = uo[doc] + start[lo:hi] + u[lo:hi]
                u_hi = u[lo:hi]
                u_lo = u_hi - n[lo:hi] + 1
                first = u_lo // size
                count = u_hi // size - first + 1
                src = np.repeat(np.arange(len(doc)), count)
                blk = X.ranges(first, count)
                ua = np.maximum(u_lo[src], blk * size)
                ub = np.minimum(u_hi[src], blk * size + size - 1)
                p, d = p[src], doc[src]
                core = sp.hash(p - blk * size, p - (blk * size + size - 1) + W)
                hull = X.mix(sp.hash(p - ub, p - ua + W) ^ (ub.astype(X.U) << X.U(32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kmer[lo:hi][src]), pa.array(blk.astype(np.int32)),
                     pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)),
                     ids.take(pa.array(row + d)), pa.array(th[row + d]),
                     pa.array((p - ub - uo[d]).astype(np.int32)),
                     pa.array((ub - ua + 1).astype(np.int32)), pa.array(ub.astype(np.int32)),
                     pa.array(val[lo:hi][src])],
                    names=["kmer", "block", "core", "hull", "doc_id", "th", "start", "n", "u", "val"])

    return joined.mapInArrow(run, BLOCKS)


@dataclass(frozen=True)
class Rule:
    """How occurrences decide. ``gather`` summarises the values of equal texts;
    ``repeats(val, summary)`` says that a text with this value is removed;
    ``matters(summary)`` says that some member of a group could be removed."""
    gather: Callable[[Column], Column]
    repeats: Callable[[Column, Column], Column]
    matters: Callable[[Column, Column], Column]


# removed if the text occurs twice or more; val counts occurrences
ANYWHERE = Rule(gather=F.sum, repeats=lambda val, s: s >= 2, matters=lambda s, top: s >= 2)
# removed if the text occurs in a smaller document; val is the document's id
EARLIER = Rule(gather=F.min, repeats=lambda val, s: val > s, matters=lambda s, top: top > s)


def resolve(pending: DataFrame, docs: DataFrame, unit: Unit, rule: Rule, sizes: tuple[int, ...],
            steps: Steps) -> list[DataFrame]:
    """Removed windows (doc_id, th, start, n) of pending representatives, as a list
    of step tables: blocks are decided or split until size 1 decides all."""
    removed: list[DataFrame] = []
    for size in sizes:
        rows = steps.table(blocks(pending, docs, unit, size), f"blocks{size}")
        stats = (rows.groupBy("kmer", "block", "core")
                 .agg(rule.gather(F.col("val")).alias("s"), F.max("val").alias("top"),
                      F.min("hull").alias("lo"), F.max("hull").alias("hi"))
                 .filter(rule.matters(F.col("s"), F.col("top")))
                 .select("kmer", "block", "core", "s", (F.col("lo") == F.col("hi")).alias("one")))
        stats = steps.table(stats, f"stats{size}")
        both = rows.join(stats, ["kmer", "block", "core"])
        decided = F.lit(True) if size == 1 else F.col("one")
        out = steps.table(both.select("kmer", "doc_id", "th", "start", "n", "u", "val",
                                      F.when(decided, rule.repeats(F.col("val"), F.col("s")))
                                      .alias("gone"))
                          .filter(F.col("gone").isNull() | F.col("gone")), f"decided{size}")
        removed.append(out.filter("gone").select("doc_id", "th", "start", "n"))
        steps.drop(rows, stats)
        pending = out.filter(F.col("gone").isNull()).drop("gone")
    return removed


def covered(docs: DataFrame, removed: list[DataFrame]) -> DataFrame:
    """Documents with the list of their removed windows: (doc_id, th, text, gone),
    gone null where nothing is removed."""
    if not removed:
        return docs.withColumn("gone", F.lit(None).cast("array<struct<start:int,n:int>>"))
    gone = removed[0]
    for r in removed[1:]:
        gone = gone.unionByName(r)
    gone = (gone.groupBy("doc_id", "th")
            .agg(F.collect_list(F.struct("start", "n")).alias("gone")))
    return (docs.join(gone, same_row(docs, gone), "left")
            .select(docs["doc_id"], docs["th"], docs["text"], gone["gone"]))


def removal_masks(batch: pa.RecordBatch, unit: Unit
                  ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, byte offsets, unit offsets, removed mask per unit) of slices
    of a ``covered`` batch (doc_id, th, text, gone)."""
    gone = batch.column(3)
    lengths = np.zeros(len(gone), dtype=np.int64)
    valid = gone.is_valid().to_numpy(zero_copy_only=False)
    g_off = gone.offsets.to_numpy().astype(np.int64)
    lengths[valid] = np.diff(g_off)[valid]
    flat = gone.flatten()
    start = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for row, data, off in X.pieces(batch.column(2)):
        uo = X.word_spans(data, off)[2] if unit.words else off
        rows = len(off) - 1
        lo, hi = at[row], at[row + rows]
        doc = np.repeat(np.arange(rows), lengths[row:row + rows])
        edge = np.zeros(int(uo[-1]) + 1, dtype=np.int64)
        np.add.at(edge, uo[doc] + start[lo:hi], 1)
        np.add.at(edge, uo[doc] + start[lo:hi] + n[lo:hi] - 1 + unit.W, -1)
        yield row, data, off, uo, np.cumsum(edge)[:-1] > 0


def runs(mask: np.ndarray, uo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs inside each text: (starts, ends, run offsets per text)."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(uo), np.int64)
    inner = uo[(uo > 0) & (uo < len(mask))]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    begin[inner] |= mask[inner]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    end[inner - 1] |= mask[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, uo)
