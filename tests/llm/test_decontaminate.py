import hashlib
import random
import re

import duckdb
from llmdata import DOC

from linklens.llm.decontaminate import OP10_SQL, PositionalIndex, item_windows, op10_decontaminate

SF = "/root/testdata/sf0.01"
ITEM = "item_id long, text string"


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = [(str(i), w[s:s + 13]) for i, t in items for w in [split(t)] if w
               for s in range(max(len(w) - 13, 0) + 1)]
    out = []
    for d, t, *_ in docs:
        w, hit, found = split(t), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_brute_force(spark, docs_df, small_docs):
    rng = random.Random(9)
    items = [(i, " ".join(split(small_docs[i][1])[2:2 + rng.choice([5, 13, 20, 40])])) for i in range(1, 30, 3)]
    items += [(50, "W1, w2"), (51, "w1 w1 w1"), (52, None), (53, " .. "), (54, "Ünï w55"), (55, "ÜNÏ"), (57, "ΑΣ w9"), (58, "ΑΣB"),
              (56, "absent words " * 8), (10, "ab ab ab"), (10, "edit7")]
    df = spark.createDataFrame(items, ITEM)
    odd = [(300, "ας ΑΣ'x ΑΣ. W9 ασ w9 ΑΣ W9", None, None, None), (301, "ΑΣb ΑΣ:B ΑΣB", None, None, None)]
    more = docs_df.unionByName(spark.createDataFrame(odd, DOC))
    got = sorted((tuple(r) for r in op10_decontaminate(more, df).collect()), key=str)
    assert got == brute(small_docs + odd, items)


def test_equals_sql(spark):
    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    want = sorted(duckdb.sql(OP10_SQL).fetchall())
    got = sorted(tuple(r) for r in op10_decontaminate(
        spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect())
    assert got == want and sum(r[-1] for r in got) > 0


def test_proximity_finds_shuffled_terms(spark):
    rare = ["alpha", "beta", "gamma"]
    docs = [(1, "x " * 30 + "gamma q alpha q q beta " + "x " * 30, None, None, None),
            (2, "alpha " + "x " * 60 + "beta gamma", None, None, None),
            (3, "alpha " + "x " * 9 + "beta " + "x " * 9 + "gamma", None, None, None)]
    docs += [(i, "x y z " * 20, None, None, None) for i in range(4, 12)]
    items = [(1, " ".join([rare[0], "x", "y", "z", rare[1], "x", "y", rare[2]]))]
    df = spark.createDataFrame(docs, DOC)
    index = PositionalIndex(df, item_windows(spark.createDataFrame(items, ITEM), 13))
    assert {r["doc_id"] for r in index.proximity(slop=2).collect()} == {1}
    assert {r["doc_id"] for r in index.proximity(slop=13).collect()} == {1, 3}


def test_empty_tables(spark, docs_df, small_docs):
    none = spark.createDataFrame([], ITEM)
    got = op10_decontaminate(docs_df, none).collect()
    assert len(got) == len(small_docs) and not any(r["contaminated"] for r in got)
    assert op10_decontaminate(spark.createDataFrame([], DOC), none).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, words string, th int")
    items = spark.createDataFrame([(None, "B"), (2, "c")], ITEM)
    assert op10_decontaminate(df, items).collect()[0]["n_items"] == 1
