import sys
from pathlib import Path

from llmdata import DOC, SF01
from test_near import crowd_brute, template_crowd

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as P  # noqa: E402

from linklens.llm.chosen_path import op6_near_dedup  # noqa: E402
from linklens.llm.queries import ORACLES, QUERIES  # noqa: E402


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    from linklens.llm.steps import Steps
    steps, seen = Steps(spark, "test"), []
    for name, stage in P.STAGES[:-1]:
        out = steps.table(stage(spark, docs, SF01), name)
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert set(ids) <= before and (name == "mix_sources" or len(set(ids)) == len(ids))
        seen.append(len(ids))
        docs = out
    assert 1000 > seen[0] > seen[1] > seen[2] > 0
    last = P.STAGES[-1][1](spark, docs, SF01)
    assert last.count() == seen[3]


def test_near_dedup_leaves_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", "s", 1), (1, text, "a", "s", 1), (2, text + " x", "a", "s", 1),
            (None, "other words here", None, None, None), (None, None, None, None, None), (5, "", "a", "s", 0)]
    out = P.near_dedup(spark, spark.createDataFrame(rows, DOC), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted(
        [(1, text), (0, "other words here"), (0, ""), (5, "")])


def test_near_dedup_keeps_what_brute_force_keeps_of_a_crowd(spark):
    docs = template_crowd(2000, planted=50, slots=1, size=5)
    want = sorted(d for d, c in crowd_brute(docs, 5).items() if d == c)
    assert len(want) == 1950
    out = P.near_dedup(spark, spark.createDataFrame(docs, DOC).repartition(8), "")
    assert sorted(r["doc_id"] for r in out.collect()) == want


def test_near_dedup_of_rows_without_ids(spark):
    from pyspark.sql import functions as F
    texts = spark.range(300_000).select(F.concat(F.lit("page "), F.col("id").cast("string")).alias("text"))
    same = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1")
    pair = same.first()["t"][:2]                      # different texts with one 32-bit hash
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, t, None, None, None) for t in [*pair, near, near + " x", near + " y"]]
    rows += [(3, near.upper().replace("W", "V"), "a", "s", 1)]
    out = [r["text"] for r in P.near_dedup(spark, spark.createDataFrame(rows, DOC), "").collect()]
    assert set(pair) <= set(out) and rows[-1][1] in out
    assert len(out) == 4 and sum(t.startswith(near) for t in out) == 1


def test_registry():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert op6_near_dedup and [n for n, _ in P.STAGES] == [
        "quality_rules", "near_dedup", "decontaminate", "mix_sources", "token_output"]
