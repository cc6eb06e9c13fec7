"""Sources and sinks: slug CSV, conversions, run-stamped metric tables."""

from pyspark.sql import functions as F

from linklens.operators import slugs as SL
from linklens.sources import loaders as L
from linklens.sources import sinks as K


def test_slug_mapping_csv(spark, tmp_path):
    p = tmp_path / "map.csv"
    p.write_text("slug,category\n news , Politics \nsports,\nnan,nan\ntech,Tech\n ,X\n")
    m = L.read_slug_mapping(spark, str(p))
    rows = [(r.slug, r.category) for r in m.orderBy("slug_rank").collect()]
    assert rows == [("news", "Politics"), ("tech", "Tech")]
    ranks = [r.slug_rank for r in m.orderBy("slug_rank").collect()]
    assert ranks == sorted(ranks)


def test_conversions_and_union(spark, tmp_path):
    j = tmp_path / "a.jsonl"
    j.write_text('{"link": "http://x/a", "category": "A"}\n{"link": "http://x/b", "category": "B"}\n')
    L.json_lines_to_parquet(spark, str(j), str(tmp_path / "a.parquet"))
    c = tmp_path / "b.csv"
    c.write_text("link,category,extra\nhttp://x/c,C,1\n")
    L.csv_to_parquet(spark, str(c), str(tmp_path / "b.parquet"))
    u = L.union_splits([spark.read.parquet(str(tmp_path / "a.parquet")),
                        spark.read.parquet(str(tmp_path / "b.parquet"))])
    assert u.count() == 3 and "extra" in u.columns


def test_run_metric_tables_and_template(spark, tmp_path):
    macro = spark.createDataFrame([("en", 0.5)], "dataset string, f1 double")
    K.write_run_metrics({"macro": macro}, str(tmp_path / "res"), "r1")
    K.write_run_metrics({"macro": macro}, str(tmp_path / "res"), "r2")
    back = spark.read.parquet(str(tmp_path / "res" / "macro"))
    assert sorted(r.run_id for r in back.collect()) == ["r1", "r2"]
    arts = spark.createDataFrame([("1", "http://h/a/x"), ("2", "http://h/a/y"), ("3", "http://h/b/z")],
                                 "article_id string, url string")
    K.write_mapping_template(SL.slug_template(arts), str(tmp_path / "tmpl"))
    t = spark.read.option("header", True).csv(str(tmp_path / "tmpl")).collect()
    assert [r.slug for r in t] == ["a", "b"] and all(r.category is None or r.category == "" for r in t)
