import random
import re
from collections import Counter

import numpy as np
from llmdata import DOC

from linklens.llm.quality import _threshold, fit_quality, op9_quality_rules, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_signals_equal_brute_force(spark, docs_df, small_docs):
    odd = [(200, "a b\na b\n\n\na b c\n \n \nx\rx\nx\rx", None, None, None),
           (201, "a a a a a", None, None, None), (202, "é#é $ ü|<>\n%&*", None, None, None),
           (203, "\n", None, None, None), (204, "q\n" * 200, None, None, None)]
    df = docs_df.unionByName(spark.createDataFrame(odd, DOC))
    labels = labels_of(spark, [(0, 1, 0), (1, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, None)])
    got = [tuple(r)[:7] for r in op9_quality_rules(df, labels).collect()]
    want = [(d, *brute(t)) for d, t, *_ in small_docs + odd]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_unseen_clean_is_kept_and_junk_is_rejected(spark):
    rng = random.Random(3)
    clean = [f"word{i}" for i in range(300)]
    text = lambda v: " ".join(rng.choice(v) for _ in range(120))
    docs = [(i, text([w + "$$$" for w in clean]) if i % 5 == 0 else text(clean), None, None, None)
            for i in range(400)]
    labels = labels_of(spark, [(i, int(i % 5 != 0), 0) for i in range(200)])
    df = spark.createDataFrame(docs, DOC)
    kept = {r["doc_id"]: r["kept"] for r in op9_quality_rules(df, labels).collect()}
    assert all(kept[i] == (i % 5 != 0) for i in range(400))


def test_threshold_and_missing_labels(spark, docs_df):
    s, g = np.array([0.1, 0.2, 0.3, 0.4]), np.array([False, False, True, True])
    assert abs(_threshold(s, g, 10) - 0.25) < 1e-12
    assert _threshold(s, np.ones(4, bool), 10) == float("-inf")
    assert _threshold(s, ~g, 10) == float("-inf")
    assert _threshold(np.zeros(0), np.zeros(0, bool), 10) == float("-inf")
    got = op9_quality_rules(docs_df, labels_of(spark, [])).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_rows_pass_through_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_words int, score string")
    model = fit_quality(df, labels_of(spark, [(1, 1, 0)]))
    row = score(df, model).collect()[0]
    assert row["row"]["n_words"] == 5 and row["row"]["score"] == "x" and row["n_words"] == 2
    assert op9_quality_rules(spark.createDataFrame([], DOC), labels_of(spark, [])).count() == 0
