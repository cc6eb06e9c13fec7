"""Edge rows: null keys, drifting files, overlapping and repeated slugs, bare suffixes, large counts."""

import pytest
from pyspark.sql import functions as F

from linklens.functions import urls as U
from linklens.operators import distribution as D
from linklens.operators import metrics as M
from linklens.operators import models as MD
from linklens.operators import slugs as SL
from linklens.session import build_session
from linklens.sources import loaders as L


def test_null_publisher(spark):
    df = spark.createDataFrame([(None, "a", "a"), (None, "b", "b"), ("p", "a", "b"), ("p", "a", None)],
                               "publisher string, label string, prediction string")
    stats = M._label_stats(M.confusion(df, ["publisher"]), ["publisher"]).collect()
    assert all(r["fp"] >= 0 and r["fn"] >= 0 for r in stats)
    got = {(r["publisher"], r["label"]): (r["tp"], r["fp"], r["fn"], r["support"]) for r in stats}
    assert got == {(None, "a"): (1, 0, 0, 1), (None, "b"): (1, 0, 0, 1), ("p", "a"): (0, 0, 2, 2),
                   ("p", "b"): (0, 1, 0, 0)}
    assert [r["domain"] for r in M.per_domain_metrics(df).collect()] == ["p"]


def test_drifting_result_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("run_id,dataset,f1\nr1,uci,0.5\n")
    (tmp_path / "b.csv").write_text("dataset,model,f1\nhuffpo,svm,0.25\n")
    (tmp_path / "c.csv").write_text("run_id,dataset,f1\nr3,uci,0.75\n")
    got = {(r["run_id"], r["dataset"], r["model"], r["f1"])
           for r in L.read_result_tables(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("r1", "uci", None, 0.5), (None, "huffpo", "svm", 0.25), ("r3", "uci", None, 0.75)}


def mapping(spark, *rows):
    return spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(rows)],
                                 "slug_rank long, slug string, category string")


def test_overlapping_slugs(spark):
    m = mapping(spark, ("a/b", "AB"), ("a", "A"), ("b/c", "BC"))
    urls = ["/a/b/c", "/a/x", "/x/b/c", "a/b/", "http://h/a", "/q"]
    df = spark.createDataFrame([(u,) for u in urls], "text string")
    got = {r["text"]: r["mapped_category"] for r in SL.mapped_category(df, m).collect()}
    assert got == {"/a/b/c": "AB", "/a/x": "A", "/x/b/c": "BC", "a/b/": "AB", "http://h/a": "A", "/q": None}


def test_repeated_slug_with_and_without_broadcast(spark, monkeypatch):
    m = mapping(spark, ("tech", "ZZZ"), ("tech", "AAA"), ("news", "N"))
    df = spark.createDataFrame([(1, "http://h/tech/x"), (2, "http://h/q")], "article_id long, url string")
    for small in (SL.broadcast_if_small, lambda d: d):
        monkeypatch.setattr(SL, "broadcast_if_small", small)
        got = {r["article_id"]: r["distant_label"] for r in SL.weak_labels(df, m).collect()}
        assert got == {1: "AAA", 2: "unknown"}


def test_bare_suffix_is_no_host(spark):
    df = spark.createDataFrame([("http://co.uk/x",), ("http://a.co.uk/x",), ("http://com/",)], "url string")
    assert [r[0] for r in df.select(U.registered_host("url")).collect()] == [None, "a.co.uk", None]


def test_large_counts_and_degrees_of_freedom(spark):
    df = spark.range(2).select(F.lit(4_000_000_000).cast("long").alias("n"))
    square = df.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0]
    assert square == 2 * 4e9 * 4e9
    for dof in (1e5, 1e6, 1e7, 1e8, 1e9):
        assert D.chi2_sf(dof, dof) == pytest.approx(0.5, abs=2e-3)
        assert D.chi2_sf(dof + 2.326347874 * (2 * dof) ** 0.5, dof) == pytest.approx(0.01, rel=0.05)


def test_mapping_rank_is_file_order(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("slug,category\n" + "".join(f"s{i},C{i}\n" for i in range(50)))
    rows = L.read_slug_mapping(spark, str(p)).orderBy("slug_rank").collect()
    assert [r["slug"] for r in rows] == [f"s{i}" for i in range(50)]


def test_session_keeps_submitted_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4321")
    try:
        assert build_session().conf.get("spark.sql.shuffle.partitions") == "4321"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_vectoriser_settings_by_model():
    assert "min_df" not in MD.VECTORIZERS["log-reg"] and MD.VECTORIZERS["svm"]["min_df"] == 2.0
