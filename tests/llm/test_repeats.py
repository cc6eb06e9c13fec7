import hashlib
from collections import defaultdict

import pytest
from llmdata import DOC
from pyspark.sql import functions as F

from linklens.llm import repeats as R
from linklens.llm.substring_dedup import op1_substring_dedup, substring_dedup
from linklens.llm.suffix_index import op8_suffix_dedup, suffix_dedup



def brute_words(docs, W):
    first = defaultdict(lambda: float("inf"))
    split = [(d, (t or "").encode().split()) for d, t, *_ in docs]
    for d, w in split:
        for i in range(len(w) - W + 1):
            if d is not None:
                key = tuple(w[i:i + W])
                first[key] = min(first[key], d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - W + 1):
            if d is not None and first[tuple(w[i:i + W])] < d:
                gone[i:i + W] = [True] * W
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(docs, W):
    count = defaultdict(int)
    raw = [(d, (t or "").encode()) for d, t, *_ in docs]
    for _, b in raw:
        for i in range(len(b) - W + 1):
            count[b[i:i + W]] += 1
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - W + 1):
            if count[b[i:i + W]] > 1:
                gone[i:i + W] = [True] * W
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_word_windows_equal_brute_force(docs_df, small_docs):
    assert rows(op1_substring_dedup(docs_df)) == sorted(brute_words(small_docs, 50), key=str)


def test_byte_strings_equal_brute_force(docs_df, small_docs):
    assert rows(op8_suffix_dedup(docs_df)) == sorted(brute_bytes(small_docs, 200), key=str)


def test_short_windows_split_many_contexts(spark):
    docs = [(i, " ".join(f"{'abcdefgh'[(i * j) % 5]}{(j * j) % 3}" for j in range(40)), "en", "s", 0)
            for i in range(40)]
    df = spark.createDataFrame(docs, DOC)
    got = substring_dedup(df, min_words=9, gram=3).select("doc_id", "n_words", "n_removed")
    assert rows(got) == sorted(((a, b, c) for a, b, c, _ in brute_words(docs, 9)), key=str)
    got = suffix_dedup(df, min_bytes=23, gram=6, batches=5).select("doc_id", "n_bytes", "n_removed")
    assert rows(got) == sorted(((a, b, c) for a, b, c, *_ in brute_bytes(docs, 23)), key=str)


def test_spans_are_the_removed_ranges(docs_df):
    for r in substring_dedup(docs_df).collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("op", [op1_substring_dedup, op8_suffix_dedup])
def test_empty_table_and_clashing_columns(spark, op):
    assert op(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(1, "a b", "k", 5, 6)], "doc_id long, text string, kmer string, th int, start int")
    assert op(df).count() == 1


def test_long_text_is_one_slice():
    import numpy as np
    import pyarrow as pa

    from linklens.llm import texts as X
    col = pa.array(["a" * 10, None, "b" * 5_000_000, "", "c"])
    got = [(row, len(data), len(off) - 1) for row, data, off in X.pieces(col)]
    assert sum(n for _, _, n in got) == 5 and sum(n for _, n, _ in got) == 5_000_011
    assert R.Unit(False, 200, 48).spans(np.zeros(0, np.uint8), np.zeros(1, np.int64))[1].tolist() == [0]


def test_texts_of_one_32_bit_hash_without_unique_ids(spark):
    """Different texts that share a 32-bit hash, under one id or none, keep their own windows."""
    from linklens.llm.lm_scoring import op3_lm_scoring
    texts = spark.range(300_000).select(F.concat(F.lit("page "), F.col("id").cast("string"), F.lit(" of five words")).alias("text"))
    pair = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first()["t"][:2]
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(d, t, "en", "s", 0) for d in (None, 5) for t in (pair[0], pair[1] + "", long, long + " tail")]
    rows += [(d, t * 40, "en", "s", 0) for d in (None, 5) for t in pair]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    got = sorted((tuple(r) for r in op8_suffix_dedup(df).collect()), key=str)
    assert got == sorted(brute_bytes(rows, 200), key=str)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    n = sorted(r["n_words"] for r in op3_lm_scoring(df, labels).collect())
    assert n == sorted(len(t.split()) for _, t, *_ in rows)
