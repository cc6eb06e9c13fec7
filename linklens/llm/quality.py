"""Quality rules: hashed n-gram likelihood ratio with plain text signals.

Two multinomials over hashed word unigrams and bigrams are counted: one over
trusted documents, one over the whole raw corpus. A document's score is the mean
log ratio of its n-grams; it is kept if the score reaches the threshold and the
base rules hold. Every document gets a verdict, by a rule without randomness.

The trusted documents are those labelled with quality 1, at most ``max_labels``
of them in the order of a hash of their id (the documented bound of the fitted
sample). Every second one is counted; the others are held out and, with as many
labelled 0, place the threshold. Raw counts cover every document. The threshold
splits the held-out labels with the fewest errors, where losing a good document
counts ``clean_cost`` times as much as keeping a bad one; it lies midway between
the scores that it parts, and ties go to the lower cut. Without any bad label
nothing falls to the score; without any good label all scores are 0.

Defined cases: a null or empty text has no words and fails the base rules; null
labels and labels of unknown documents are ignored; repeated rows are scored
alike; all input columns pass through in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm import texts as X

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SIGNALS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, score double")


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray            # log ratio per bucket
    threshold: float


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_off: np.ndarray,
              buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every unigram and every bigram inside a text, in lower case."""
    h = X.word_hashes(X.LOWER_BYTE[data], starts, ends)
    text = np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))
    pair = X.mix(h[:-1] * X.U(3) + h[1:]) if len(h) else h
    inside = np.flatnonzero(text[1:] == text[:-1])
    mask = X.U(buckets - 1)
    return (np.concatenate([h & mask, pair[inside] & mask]).astype(np.int64),
            np.concatenate([text, text[inside]]))


def _repeat_words(h: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    """Words per text inside 3-word windows that occur twice or more in that text."""
    n_win = np.maximum(np.diff(word_off) - 2, 0)
    starts = X.ranges(word_off[:-1], n_win)
    marked = np.zeros(len(h), dtype=np.int64)
    if len(starts):
        text = np.repeat(np.arange(len(n_win)), n_win)
        key = X.mix(X.Spans(h).hash(starts, starts + 3) ^ X.mix(text.astype(X.U) + X.U(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for shift in range(3):
            marked[starts[again] + shift] = 1
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.diff(total[word_off])


def _dup_lines(data: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines per text that hold a word and equal an earlier line of the text."""
    after = np.flatnonzero(data == 10) + 1
    begins = np.concatenate([off[:-1], after])
    text = np.concatenate([np.arange(len(off) - 1),
                           np.searchsorted(off, after - 1, side="right") - 1])
    order = np.lexsort((begins, text))
    begins, text = begins[order], text[order]
    last = np.append(text[1:] != text[:-1], True)
    # a line ends before its line end, the last one with its text
    ends = np.where(last, off[text + 1], np.append(begins[1:], 0) - 1)
    has_word = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends, text = begins[has_word], ends[has_word], text[has_word]
    key = X.mix(X.Spans(X.BYTE_VALUE[data]).hash(begins, ends) ^ X.mix(text.astype(X.U) + X.U(1)))
    n_texts = len(off) - 1
    lines = np.bincount(text, minlength=n_texts)
    _, first = np.unique(key, return_index=True)
    return lines - np.bincount(text[first], minlength=n_texts)


def _counts(docs: DataFrame, trusted: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all and of the trusted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(buckets, dtype=np.int64)
        target = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            chosen = np.isin(b.column(0).to_numpy(zero_copy_only=False), trusted)
            for row, data, off in X.pieces(b.column(1)):
                bucket, text = _features(data, *X.word_spans(data, off), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[chosen[row + text]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])],
                                         names=["bucket", "raw", "target"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def _threshold(scores: np.ndarray, good: np.ndarray, clean_cost: float) -> float:
    """Lowest score with the fewest weighted errors when scores below it are rejected."""
    if not len(scores) or good.all():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) * clean_cost
    left = (~g).sum() - np.concatenate([[0], np.cumsum(~g)])
    cut = np.concatenate([[True], s[1:] != s[:-1], [True]])
    best = int(np.argmin(np.where(cut, lost + left, np.inf)))
    if best == 0:
        return float("-inf")
    return float((s[best - 1] + s[best]) / 2) if best < len(s) else float(np.nextafter(s[-1], np.inf))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000,
                buckets: int = 1 << 16, clean_cost: float = 10.0) -> QualityModel:
    """Count both multinomials and place the threshold."""
    def sample(quality: int) -> np.ndarray:
        rows = (labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull())
                .select(F.col("doc_id").cast("long").alias("doc_id"))
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).collect())
        return np.array(list(dict.fromkeys(r["doc_id"] for r in rows)), dtype=np.int64)

    good, bad = sample(1), sample(0)
    bad = np.setdiff1d(bad, good)
    counted, held = good[::2], good[1::2]
    # at most ``buckets`` rows reach the driver, whatever the corpus
    rows = _counts(docs, counted, buckets).collect()
    at = np.array([r["bucket"] for r in rows], dtype=np.int64)
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[at] += np.array([r["raw"] for r in rows])
    target[at] += np.array([r["target"] for r in rows])
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())
    if not len(good):
        weights = np.zeros(buckets)

    # ids of the held-out sample, at most 1.5 * max_labels
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in np.concatenate([held, bad])], "label_id long")
    chosen = docs.join(F.broadcast(ids), docs["doc_id"].cast("long") == ids["label_id"]).select(
        docs["doc_id"], docs["text"])
    scored = (score(chosen, QualityModel(weights, 0.0)).filter("NOT base_failed")
              .select("row.doc_id", "score").distinct().collect())
    s = np.array([r["score"] for r in scored])
    g = np.isin(np.array([r["doc_id"] for r in scored], dtype=np.int64), held)
    return QualityModel(weights, _threshold(s, g, clean_cost))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(row, signals, score, base_failed, kept); ``row`` holds all input columns."""
    weights, buckets = model.weights, len(model.weights)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.coalesce(docs["text"], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, off in X.pieces(b.column(1)):
                starts, ends, word_off = X.word_spans(data, off)
                n_texts, n_words = len(off) - 1, np.diff(word_off)
                inside = np.concatenate([[0], np.cumsum(X.WORD_BYTE[data] & ((data & 0xC0) != 0x80))])
                symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
                h = X.word_hashes(data, starts, ends)
                bucket, text = _features(data, starts, ends, word_off, buckets)
                grams = np.maximum(np.bincount(text, minlength=n_texts), 1)
                mean = np.bincount(text, weights=weights[bucket], minlength=n_texts) / grams
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, n_texts), pa.array(n_words),
                     pa.array(np.diff(inside[off])), pa.array(np.diff(symbols[off])),
                     pa.array(_dup_lines(data, off, starts)), pa.array(_repeat_words(h, word_off)),
                     pa.array(mean)],
                    names=["row", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                           "n_repeat_words", "score"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, {SIGNALS}"
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (rows.mapInArrow(run, schema).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold))))


def op9_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's signals and verdict of every document."""
    model = fit_quality(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "score")
