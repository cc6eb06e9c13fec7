"""Language-model scores: recursive stupid backoff over tables of n-gram counts.

The model counts the n-grams of up to ``order`` words of the trusted documents.
A word's score after its context is the n-gram's count by the context's if it was
counted, else 0.4 times its score after the context without its first word, down
to the word's share c(v) / N of all words, or 1 / (2 N) for a word never counted:

    S_1(v)         = c(v) / N, or 1 / (2 N)
    S_k(u .. v)    = c(u .. v) / c(u ..)  if counted, else 0.4 S_(k-1)(.. v)

A document's score is the mean of the logs of S_order. A context that the start
of a document cuts off counts as not met.

N-grams are known by 64-bit hashes, and tables of them are blocks: sorted keys of
a range of the hashes, as differences in planes of bytes, and their counts. So a
shuffled n-gram costs some six bytes and no row. Documents are packed into batches
of a few megabytes; a batch asks for each of its distinct n-grams once, whatever
their number in it, and a frequent n-gram is no more than one entry per batch. The
part of the model with that range of hashes answers with the counts, and the
batch's documents are scored where its answers meet. The ranges are asked in
``rounds``, so that only a share of the questions is on disk at once.

The most frequent n-grams, at most ``common`` of them whatever the corpus, go to
every task and are not asked for.

Defined cases: a null or empty text has no words and a null score; without any
trusted document every word scores the floor of an empty model; repeated rows
and null ids keep their own texts; null labels are ignored; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm import texts as X
from linklens.llm.repeats import keyed
from linklens.llm.steps import Steps, batches_of
from linklens.session import broadcast_if_small, plan_size_bytes

BACKOFF = 0.4
BATCH_BYTES = 2 << 20           # texts whose n-grams are asked for together; a longer text is a batch of its own
PART_BYTES = 8 << 20            # of the documents' files, for one range of hashes
MOST_PARTS = 1 << 14
CHUNK = 1 << 16                 # n-grams of one block of the model
ROWS, BLOCKS = 256, 8           # texts, and blocks or batches, that a worker gets at once


def _grams(data: np.ndarray, off: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys, word offsets): for each k up to ``order`` the key of the k words up to each word;
    that of a word with fewer than k - 1 words before it in its text means nothing."""
    starts, ends, uo = X.word_spans(data, off)
    h = X.word_hashes(data, starts, ends)
    keys = [h]
    for _ in range(1, order):
        key = np.zeros(len(h), dtype=X.U)
        key[1:] = X.mix(keys[-1][:-1] * X.U(3) + h[1:])
        keys.append(key)
    return keys, uo


def _place(uo: np.ndarray) -> np.ndarray:
    """Of each word, the number of words before it in its text."""
    return X.ranges(np.zeros(len(uo) - 1, dtype=np.int64), np.diff(uo))


def _zip(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(data, asbytes=True) if data else b""


def _unzip(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True) if size else b"", dtype=np.uint8)


def _pack(x: np.ndarray) -> bytes:
    """64-bit numbers as planes of their bytes, compressed."""
    planes = np.ascontiguousarray(x.astype(X.U).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + _zip(planes.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.ascontiguousarray(_unzip(b[8:], 8 * n).reshape(8, n).T).view(X.U).reshape(n)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return _pack(np.diff(keys, prepend=X.U(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=X.U)


def _edges(parts: int) -> np.ndarray:
    """The least key of each range but the first."""
    return np.array([-(-p * (1 << 32) // parts) << 32 for p in range(1, parts)], dtype=X.U)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, n
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(n, at)


def _counted(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, words, keys, n): the n-grams of batches of texts, by ranges."""
    edges = _edges(parts)

    def blocks(found: list[np.ndarray], words: int) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        full = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([words] + [0] * (len(full) - 1), pa.int64()),
             pa.array([_pack_keys(keys[cut[p]:cut[p + 1]]) for p in full], pa.binary()),
             pa.array([_pack(n[cut[p]:cut[p + 1]]) for p in full], pa.binary())], names=["part", "words", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, words, size = [], 0, 0
        for b in batches:
            for _, data, off in X.pieces(b.column(0)):
                keys, uo = _grams(data, off, order)
                place = _place(uo)
                found += [key[place >= k] for k, key in enumerate(keys)]
                words, size = words + len(place), size + len(data)
                if size >= BATCH_BYTES and words:
                    yield blocks(found, words)
                    found, words, size = [], 0, 0
        if words:
            yield blocks(found, words)

    return docs.select("text").mapInArrow(run, "part int, words long, keys binary, n binary")


def _merged(rows: DataFrame, parts: int) -> DataFrame:
    """(part, words, keys, n): the blocks of each range added up, and cut into chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, kept, more = None, 0, _summed(np.zeros(0, dtype=X.U), np.zeros(0, dtype=X.U)), []

        def add() -> None:
            nonlocal kept, more
            if more:
                kept = _summed(*(np.concatenate([kept[i], *(m[i] for m in more)]) for i in (0, 1)))
                more = []

        def out() -> Iterator[pa.RecordBatch]:
            add()
            for i in range(0, len(kept[0]), CHUNK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([words if i == 0 else 0], pa.int64()),
                     pa.array([_pack_keys(kept[0][i:i + CHUNK])], pa.binary()),
                     pa.array([_pack(kept[1][i:i + CHUNK])], pa.binary())], names=["part", "words", "keys", "n"])

        for b in batches:
            for p, w, keys, n in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    yield from out()
                    part, words, kept, more = p, 0, (np.zeros(0, dtype=X.U), np.zeros(0, dtype=X.U)), []
                words += w
                more.append((_unpack_keys(keys), _unpack(n)))
                # as much again as is kept, so that a key is moved a few times only
                if sum(len(m[0]) for m in more) > max(CHUNK, len(kept[0])):
                    add()
        yield from out()

    return rows.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, rows.schema)


def _frequent(counts: DataFrame, common: int) -> DataFrame:
    """(key, n, weight) of the n-grams with a larger share than 1 / ``common`` of the words, fewer
    than ``common`` of each length; ``counts`` has the number of all words in ``total``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, n, total in zip(*(c.to_pylist() for c in b.columns)):
                n = _unpack(n).astype(np.int64)
                at = np.flatnonzero(n * common > (total or 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_unpack_keys(keys)[at].view(np.int64)), pa.array(n[at]), pa.array(n[at].astype(np.float64))],
                    names=["key", "n", "weight"])

    return counts.select("keys", "n", "total").mapInArrow(run, "key long, n long, weight double")


def _level(n: Column) -> Column:
    """Classes of counts that ascend with them: exact ones to 1,024, then 16 to a doubling."""
    return F.when(n <= 1024, n).otherwise(F.floor(F.log2(n.cast("double")) * 16) + 1024).cast("long")


def _split(grams: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(key, weight) of the most frequent of (key, n, weight), at most ``most``, and of all others.
    Whole levels are taken from the top, so that only a row per level is gathered."""
    sizes = grams.groupBy(_level(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("c")).collect()
    least, taken = 1 << 62, 0
    for level, c in sorted(map(tuple, sizes), reverse=True):
        taken += c
        if taken > most:
            break
        least = level
    top = _level(F.col("n")) >= least
    return grams.filter(top).select("key", "weight"), grams.filter(~top).select("key", "weight")


def _packed(docs: DataFrame) -> DataFrame:
    """(batch, doc_id, th, length, text): documents in batches, their texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        ids, hashes, lengths, texts = [], [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([hashes], pa.list_(pa.int64())), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                 pa.array([_zip(b"".join(texts))], pa.binary())],
                names=["batch", "doc_id", "th", "length", "text"])

        for b in batches:
            for row, data, off in X.pieces(b.column(2)):
                ids += b.column(0).slice(row, len(off) - 1).to_pylist()
                hashes += b.column(1).slice(row, len(off) - 1).to_pylist()
                lengths.append(np.diff(off))
                texts.append(data.tobytes())
                if sum(map(len, texts)) >= BATCH_BYTES:
                    yield out()
                    n, ids, hashes, lengths, texts = n + 1, [], [], [], []
        if ids:
            yield out()

    return docs.mapInArrow(run, "batch long, doc_id array<long>, th array<long>, length array<long>, text binary")


def _batch_grams(length: np.ndarray, text: bytes, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, place, words): the keys of a batch's n-grams, one row for each length; each word's
    place in its text; and the number of words of each text."""
    off = np.concatenate([[0], np.cumsum(length)])
    data = _unzip(text, int(off[-1]))
    keys, place, words, lo = [], [], [], 0
    while lo < len(length):                     # slices, as in X.pieces
        hi = min(max(int(np.searchsorted(off, off[lo] + X.SLICE_BYTES, side="right")) - 1, lo + 1), len(length))
        found, uo = _grams(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], order)
        keys.append(np.stack(found))
        place.append(_place(uo))
        words.append(np.diff(uo))
        lo = hi
    return np.concatenate(keys, axis=1), np.concatenate(place), np.concatenate(words)


def _met(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of the keys of a batch, those with all their words in their text."""
    return np.concatenate([key[place >= k] for k, key in enumerate(keys)])


class BackoffModel:
    """Counts of the n-grams of up to ``order`` words: blocks in ``counts``, and the most frequent,
    at most ``common``, in arrays."""

    def __init__(self, trusted: DataFrame, common: int = 1 << 20, steps: Steps | None = None, order: int = 2,
                 rounds: int = 2):
        self.spark, self.order, self.rounds = trusted.sparkSession, order, rounds
        self.steps = steps or Steps(self.spark, "lm")
        self.parts = self._parts(trusted)
        with batches_of(self.spark, ROWS):
            rows = _counted(trusted, order, self.parts)
            self.counts = self.steps.table(_merged(rows, self.parts), "counts")
        total = self.counts.agg(F.sum("words").alias("total"))       # one row
        with batches_of(self.spark, BLOCKS):
            often = self.steps.table(_frequent(self.counts.crossJoin(F.broadcast(total)), common), "frequent")
        top = _split(often, common)[0].toArrow()
        self.total = int(total.first()[0] or 0)
        key = top.column("key").to_numpy().view(X.U)
        by = np.argsort(key)
        self.keys, self.n = key[by], top.column("weight").to_numpy()[by]
        self.steps.drop(often)

    def _parts(self, docs: DataFrame) -> int:
        size = plan_size_bytes(docs) or 0
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # an estimate without files behind it says nothing
        return max(least, min(math.ceil(size / PART_BYTES), MOST_PARTS) if size < 1 << 50 else 0, 1)

    def _asked(self, packed: DataFrame, shared, lo: int, hi: int) -> DataFrame:
        """(part, batch, keys): what each batch asks the ranges ``lo`` to ``hi`` - 1."""
        order, edges = self.order, _edges(self.parts)
        least = edges[lo - 1] if lo else X.U(0)
        most = edges[hi - 1] - X.U(1) if hi <= len(edges) else X.U((1 << 64) - 1)
        edges = edges[lo:hi - 1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value[0]
            for b in batches:
                for batch, length, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    keys, place, _ = _batch_grams(length.values.to_numpy(), text, order)
                    keys = _met(keys, place)
                    keys = np.unique(keys[(keys >= least) & (keys <= most)])
                    keys = np.delete(keys, _found(keys, known)[0])
                    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                    full = np.flatnonzero(np.diff(cut))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((full + lo).astype(np.int32)), pa.array([batch] * len(full), pa.int64()),
                         pa.array([_pack_keys(keys[cut[p]:cut[p + 1]]) for p in full], pa.binary())],
                        names=["part", "batch", "keys"])

        return packed.select("batch", "length", "text").mapInArrow(run, "part int, batch long, keys binary")

    def _answered(self, asked: DataFrame, lo: int, hi: int) -> DataFrame:
        """(batch, part, n): the counts of the keys that were asked for, in their order."""
        mine = self.counts.where((F.col("part") >= lo) & (F.col("part") < hi))
        rows = mine.select("part", F.lit(None).cast("long").alias("batch"), "keys", "n").unionByName(
            asked.withColumn("n", F.lit(None).cast("binary")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, blocks, keys, n = None, [], None, None
            for b in batches:
                out = []
                for p, batch, k, c in zip(*(c.to_pylist() for c in b.columns)):
                    if p != part:
                        part, blocks, keys = p, [], None
                    if batch is None:
                        blocks.append((_unpack_keys(k), _unpack(c)))
                        continue
                    if keys is None:            # blocks of a range come before its questions
                        blocks.sort(key=lambda x: x[0][0])
                        keys, n = (np.concatenate([np.zeros(0, dtype=X.U), *(x[i] for x in blocks)]) for i in (0, 1))
                        blocks = []
                    found = np.zeros(0, dtype=X.U) if k is None else _unpack_keys(k)
                    count = np.zeros(len(found), dtype=X.U)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                        count = np.where(keys[at] == found, n[at], X.U(0))
                    out.append((batch, p, _pack(count)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int32(), pa.binary()))], names=["batch", "part", "n"])

        return (rows.repartitionById(hi - lo, F.col("part") - lo).sortWithinPartitions("part", F.col("batch").asc_nulls_first())
                .mapInArrow(run, "batch long, part int, n binary"))

    def _scored(self, packed: DataFrame, answers: DataFrame, shared) -> DataFrame:
        order, total = self.order, max(self.total, 1)
        none = [F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("n", "binary"))]
        rows = packed.select("batch", *none, "doc_id", "th", "length", "text").unionByName(answers, allowMissingColumns=True)

        def score(keys: np.ndarray, place: np.ndarray, asked: np.ndarray) -> np.ndarray:
            """Log S of each word."""
            known, often = shared.value
            every, at = np.unique(_met(keys, place), return_inverse=True)
            here, there = _found(every, known)
            n = np.zeros(len(every))
            n[here] = often[there]
            rest = np.ones(len(every), dtype=bool)
            rest[here] = False
            if rest.sum() != len(asked):
                raise RuntimeError(f"{rest.sum()} n-grams, {len(asked)} counts")
            n[rest] = asked
            n, lo, before = n[at], 0, None
            for k in range(order):
                count = np.zeros(len(place))
                met = place >= k
                count[met] = n[lo:lo + met.sum()]
                lo += met.sum()
                if k == 0:
                    s = np.where(count > 0, count, 0.5) / total
                else:
                    s = BACKOFF * s
                    counted = np.flatnonzero(count > 0)
                    s[counted] = count[counted] / before[counted - 1]
                before = count
            return np.log(s)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = []
            for b in batches:
                n = b.column(2).to_pylist()
                for i, part in enumerate(b.column(1).to_pylist()):
                    if part is not None:        # answers come before their batch, by ranges
                        got.append(_unpack(n[i]))
                        continue
                    ids, th, length, text = (b.column(c)[i] for c in (3, 4, 5, 6))
                    keys, place, words = _batch_grams(length.values.to_numpy(), text.as_py(), order)
                    asked, got = np.concatenate([np.zeros(0, dtype=X.U), *got]), []
                    logs = score(keys, place, asked) if len(place) else np.zeros(0)
                    doc = np.repeat(np.arange(len(words)), words)
                    sums = np.bincount(doc, weights=logs, minlength=len(words))
                    yield pa.RecordBatch.from_arrays(
                        [ids.values, th.values, pa.array(words.astype(np.int64)),
                         pa.array(sums / np.maximum(words, 1), mask=words == 0)], names=["doc_id", "th", "n_words", "log_score"])

        return (rows.repartition(self.parts, "batch").sortWithinPartitions("batch", F.col("part").asc_nulls_last())
                .mapInArrow(run, "doc_id long, th long, n_words long, log_score double"))

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, th, n_words, log_score) of ``keyed`` documents, written."""
        table, answers = self.steps.table, []
        shared = self.spark.sparkContext.broadcast((self.keys, self.n))
        with batches_of(self.spark, ROWS):
            packed = table(_packed(docs), "batches")
        rounds = min(self.rounds, self.parts)
        cuts = [self.parts * r // rounds for r in range(rounds + 1)]
        with batches_of(self.spark, BLOCKS):
            for lo, hi in zip(cuts, cuts[1:]):
                answers.append(table(self._answered(self._asked(packed, shared, lo, hi), lo, hi), "answers"))
            all_answers = answers[0]
            for a in answers[1:]:
                all_answers = all_answers.unionByName(a)
            out = table(self._scored(packed, all_answers, shared), "scores")
        self.steps.drop(packed, *answers)
        shared.destroy()
        return out


def _found(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``keys`` and in ``known``, both ascending and distinct, of what both have."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, known), len(keys) - 1)
    there = np.flatnonzero(keys[at] == known)
    return at[there], there


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents labelled with quality 1."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("l_id")).distinct()
    good = Steps(docs.sparkSession, "lm").table(good, "trusted")
    return docs.join(broadcast_if_small(good), F.col("doc_id") == F.col("l_id"), "left_semi")


def op3_lm_scoring(docs: DataFrame, labels: DataFrame, order: int = 2) -> DataFrame:
    """Mean log score of every document under the model of the trusted ones, of n-grams of up to
    ``order`` words."""
    rows = keyed(docs)
    model = BackoffModel(trusted_documents(rows, labels), order=order)
    scores = model.score(rows)
    model.steps.drop(model.counts)
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))
