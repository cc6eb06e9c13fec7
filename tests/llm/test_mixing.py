import re
from collections import Counter

import duckdb
import pytest
from llmdata import DOC
from pyspark.sql import functions as F

from linklens.llm.mixing import OP2_SQL, Mixture, mix_documents, op2_source_mixing

SF = "/root/testdata/sf0.01"


def brute_targets(sizes):
    """Reshare what is above the caps, by weight, until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            for s in free:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets_and_takes(spark, docs_df, small_docs):
    extra = [(900 + i, "w " * (3 + i), None, "tiny", 0) for i in range(4)] + [(990, None, None, "none", 0)]
    df = docs_df.unionByName(spark.createDataFrame(extra, DOC))
    got = op2_source_mixing(df).collect()
    sizes = Counter()
    for _, t, _, s, _ in small_docs + extra:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(dict(sizes))
    src = {d: s for d, _, _, s, _ in small_docs + extra if d not in (2, 8, None)}
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        if r["doc_id"] in src:
            assert r["source_size"] == sizes[src[r["doc_id"]]]
            assert abs(r["target"] - want[src[r["doc_id"]]]) < 1e-6
        taken[r["source_size"], r["target"]] += r["taken"]
    assert len(got) == len(small_docs) + len(extra)
    longest = max(r["size"] for r in got)
    for (_, target), n in taken.items():
        assert abs(n - target) <= longest
    again = op2_source_mixing(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_equals_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = sorted(duckdb.sql(OP2_SQL).fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in op2_source_mixing(docs).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))
    by = Counter()
    for r in got:
        by[r[2], r[3]] += r[4]
    assert all(abs(n - t) / t < 0.05 for (_, t), n in by.items())


def test_mix_holds_each_copy_once_and_shards_are_even(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = Mixture(docs, shard_words=20_000, max_blocks=512)
    takes = Counter()
    for r in op2_source_mixing(docs).collect():
        takes[r["doc_id"]] = r["taken"] // r["size"] if r["size"] else None
    out = Counter(r["doc_id"] for r in mix_documents(docs).collect())
    assert all(out[d] == n for d, n in takes.items() if n is not None)
    draws = m.draws.select(F.explode("shards").alias("shard")).groupBy("shard").count().collect()
    assert len(draws) == m.max_shards == 32
    n = [r["count"] for r in draws]
    assert max(n) - min(n) <= 5
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, "a", None, "s", 1)] * 3])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, DOC).withColumn("size", F.lit(1)).withColumn("block", F.lit("x"))
    assert op2_source_mixing(df).count() == len(rows)
    assert mix_documents(df).columns == df.columns
