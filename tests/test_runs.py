"""Run tables, result files and the small functions without a table of their own."""

import math

import pytest
from pyspark.sql import functions as F

from linklens.functions import text as TX
from linklens.functions import urls as U
from linklens.operators import distribution as D
from linklens.operators import hosts as H
from linklens.operators import models as MD
from linklens.operators import ranks as K
from linklens.operators import runs as RN
from linklens.operators import textfeatures as TF
from linklens.sources import loaders as L
from linklens.sources import sinks as SK


def test_chi2_sf_ends_for_every_input():
    inf, nan = float("inf"), float("nan")
    assert D.chi2_sf(inf, 3) == 0.0 and D.chi2_sf(3.0, inf) == 1.0
    for stat, dof in [(nan, 3), (3, nan), (inf, inf), (None, 3), (3, 0)]:
        assert math.isnan(D.chi2_sf(stat, dof))
    assert D.chi2_sf(-inf, 3) == 1.0 and abs(D.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12


def predictions(spark, flip=0):
    rows = [(i, f"p{i % 3}", "ab"[i % 2], "ab"[(i + (i % 4 == flip)) % 2]) for i in range(40)]
    return spark.createDataFrame(rows, "article_id long, publisher string, label string, prediction string")


def test_run_written_twice_counts_once(spark, tmp_path):
    root = str(tmp_path)
    for run, flip in [("r1", 0), ("r2", 1), ("r1", 9)]:
        pred, rows, seconds = RN.timed(predictions(spark, flip))
        assert rows == 40 and seconds > 0
        SK.write_run_metrics(RN.run_tables(pred, run, "d", "m", "f", rows, seconds), root, run)
    macro = {r.run_id: r for r in spark.read.parquet(f"{root}/macro").collect()}
    assert set(macro) == {"r1", "r2"} and macro["r1"].accuracy == 1.0 and macro["r2"].accuracy == 0.75
    assert macro["r1"].throughput > 0 and macro["r1"].micro_f1 == 1.0 and macro["r1"].dataset == "d"
    assert spark.read.parquet(f"{root}/topic").where("run_id = 'r1'").count() == 2
    assert spark.read.parquet(f"{root}/domain").count() == 6
    assert spark.read.parquet(f"{root}/domain_topic").count() == 12
    none = RN.run_tables(predictions(spark).drop("publisher"), "x", "d", "m", "f")
    assert set(none) == {"macro", "topic"} and none["macro"].first().throughput is None


def test_split_and_column_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "test", "a,b"), (2, "train", "c")], "id long, split string, t string")
    SK.write_split(df, str(tmp_path / "s"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == [("1", "a,b")]
    SK.export_columns(df, str(tmp_path / "c"), ["t"], where="id = 2")
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == [("c",)]


def test_result_files_with_drifting_columns_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("model,f1,n\nm1,0.5,3\nm2,,4\n")
    (tmp_path / "b.csv").write_text("n,model,f1\n7,m3,n/a\n")
    (tmp_path / "c.csv").write_text('model,"f1",extra\nm4,0.25,1.5\n')
    (tmp_path / "empty.csv").write_text("model,f1,n\n")
    out = L.read_result_tables(spark, str(tmp_path / "*.csv"))
    assert dict(out.dtypes) == {"model": "string", "f1": "string", "n": "bigint", "extra": "double"}
    assert sorted((r.model, r.f1, r.n, r.extra) for r in out.collect()) == [
        ("m1", "0.5", 3, None), ("m2", None, 4, None), ("m3", "n/a", 7, None), ("m4", "0.25", None, 1.5)]
    out = L.read_result_tables(spark, str(tmp_path / "*.csv"), ("", "n/a"))
    assert dict(out.dtypes)["f1"] == "double" and out.agg(F.sum("f1")).first()[0] == 0.75


def test_canonical_schema_of_every_dataset(spark):
    rules = spark.createDataFrame([("com",)], "rule string")
    rows = spark.createDataFrame([("http://a.news.com/x/y", "t", "s", "u", "c")] * 2, "URL string, Titulo string, Subtitulo string, "
                                 "Sumario string, Categoria string")
    out = L.load_articles(rows, "recognasumm", suffix_rules=rules)
    assert out.columns == [*L.CANONICAL, "netloc", "path", "path_clean"] and out.first().publisher == "a.news.com"
    uci = spark.createDataFrame([("http://x.com/a", "t", "b", "Reuters"), ("http://x.com/b", "t", "b", "")],
                                "URL string, TITLE string, CATEGORY string, PUBLISHER string")
    out = L.load_articles(uci, "uci", suffix_rules=rules)
    assert sorted(r.publisher for r in out.collect()) == ["Reuters", "x.com"] and out.first().subtitle is None
    assert H.publisher_or_host(uci.drop("PUBLISHER"), rules, "source", "URL").first().source == "x.com"


def test_extension_points(spark):
    TX.register_feature("slug_title", ["path", "title"], {"uci": None})
    assert TX.feature_text("slug_title", "uci") is None
    df = spark.createDataFrame([("/a/9", "t")], "path string, title string")
    assert df.select(TX.feature_text("slug_title", "huffpo")).first()[0] == "/a/9 t"
    rules = {"live": r"/live/", "number": r"\d"}
    paths = spark.createDataFrame([("/live/1",), ("/x/1",), ("/x",)], "p string")
    assert [r[0] for r in paths.select(U.rule_label("p", rules)).collect()] == ["live", "number", "other"]

    from pyspark.ml.classification import LogisticRegression
    MD.register_model("plain", lambda n, features, label, weight, params: LogisticRegression(
        featuresCol=features, labelCol=label, maxIter=5))
    train = spark.createDataFrame([("good words", "a"), ("bad things", "b")] * 5, "text string, label string")
    got = MD.predict(MD.train_model(train, "plain"), train.limit(2), ("label",)).collect()
    assert [r.label for r in got] == [r.prediction for r in got]


@pytest.mark.parametrize("n", [1, 2, 97, 1000])
def test_exact_quantiles_and_prefix_sums(spark, n):
    import numpy as np
    rng = np.random.default_rng(n)
    v = rng.integers(0, 40, n).astype(float)
    rows = [(float(x), int(i % 7), "g" if i % 3 else None) for i, x in enumerate(v)] + [(None, 1, "none")]
    df = spark.createDataFrame(rows, "v double, w long, g string").repartition(5)
    got = K.exact_quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1], list("abcde")).first()
    assert np.allclose(list(got), np.quantile(v, [0, 0.25, 0.5, 0.9, 1]))
    for r in K.exact_quantiles(df, "v", [0.5], ["m"], ["g"]).collect():
        assert r.m == np.median([x for x, _, g in rows if g == r.g])
    sums = sorted(tuple(r) for r in K.with_prefix_sum(df.where("v IS NOT NULL").select("v", "w"), "w", ["v", "w"])
                  .select("v", "w", "_before", "_total").collect())
    before = 0
    for x, w, b, total in sums:
        assert b == before and total == sum(r[1] for r in rows[:-1])
        before += w


def test_gate_without_labels_falls_back_to_true_labels(spark):
    from linklens.sources import tables as T
    rows = [(i, f"http://h/none/{'tech' if i % 2 else 'money'}-{i}", "A" if i % 2 else "B") for i in range(80)]
    df = spark.createDataFrame(rows, "article_id long, url string, category string")
    lab = TF.weak_or_true_labels(df, T.slug_map(spark))
    assert {r.label_source for r in lab.collect()} == {"true"} and lab.count() == 80
    model = TF.weak_label_model(df, T.slug_map(spark))
    out = TF.two_stage_predict(df, model, T.slug_map(spark)).collect()
    assert len(out) == 80 and all(r.prediction == r.label and r.source == "classifier" for r in out)
    unseen = TF.two_stage_predict(df.withColumn("category", F.lit("Z")), model, None)
    assert TF.two_stage_evaluation(unseen, model).count() == 0          # F10
    none = TF.weak_label_model(df.limit(0), T.slug_map(spark))
    assert {(r.prediction, r.source) for r in TF.two_stage_predict(df, none, T.slug_map(spark)).collect()} == {(None, "none")}


def test_salted_scoring_equals_broadcast_and_has_no_class_rows(spark, monkeypatch):
    rows = [(i % 50, "the " * (i % 3 + 1) + ("sun sea" if i % 2 else "tax law") + f" w{i % 17}", "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    for tfidf in (False, True):
        model = TF.nb_train(df, tfidf=tfidf)
        plain = sorted(map(tuple, TF.nb_score(df, model).collect()))
        assert len(plain) == 120 and all(r[2] == r[3] for r in plain)    # a repeated id keeps its rows
        assert {r.term for r in model.terms.where("hot").collect()} >= {"the"}
        monkeypatch.setattr(TF, "_with_terms", TF._salted)
        assert sorted(map(tuple, TF.nb_score(df, model).collect())) == plain
        monkeypatch.undo()


def test_tfidf_naive_bayes_weights(spark):
    """Weights, idf and probabilities of a small model computed by hand."""
    df = spark.createDataFrame([("aa aa bb", "x"), ("bb cc", "y")], "text string, label string")
    model = TF.nb_train(df, tfidf=True)
    idf = {"aa": math.log(3 / 2) + 1, "bb": 1.0, "cc": math.log(3 / 2) + 1}
    d1 = {"aa": 2 * idf["aa"], "bb": 1.0}
    d2 = {"bb": 1.0, "cc": idf["cc"]}
    d1 = {t: v / math.hypot(*d1.values()) for t, v in d1.items()}
    d2 = {t: v / math.hypot(*d2.values()) for t, v in d2.items()}
    want = {t: [math.log((d.get(t, 0) + 1) / (sum(d.values()) + 3)) for d in (d1, d2)] for t in idf}
    got = {r.term: list(r.logp) for r in model.terms.collect()}
    assert model.labels == ["x", "y"] and all(abs(a - b) < 1e-12 for t in want for a, b in zip(got[t], want[t]))


def test_large_run_models_are_joined_without_a_broadcast(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "2019", "12"]
    rows = [(i, f"http://h.com/{words[i % 6]}/2019/0{i % 9 + 1}/{i // 2}" if i % 7 else None, f"{words[i % 4]} {words[i % 5]} common",
             "xyz"[i % 3] if i % 11 else None, "ab"[i % 2], "test" if i % 4 == 0 else "train") for i in range(120)]
    arts = spark.createDataFrame(rows, "article_id long, url string, title string, category string, language string, split string")
    mapping = spark.createDataFrame([(0, "beta", "x")], "slug_rank int, slug string, category string")
    near = sorted(map(str, RN.run_confusion(arts, mapping).collect()))
    salted = []
    monkeypatch.setattr(RN, "broadcast_if_small", lambda d, *a: d)
    monkeypatch.setattr(RN, "salted_terms", lambda *a: salted.append(a) or TF.salted_terms(*a))
    assert sorted(map(str, RN.run_confusion(arts, mapping).collect())) == near and salted


def test_null_terms_are_spread_by_row(spark):
    words = spark.range(400).select(F.col("id").alias("_row"), F.lit(None).cast("string").alias("term"))
    terms = spark.createDataFrame([("a", 1.0, True)], "term string, idf double, hot boolean")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = TF.salted_terms(words, terms, ["term"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 400


def test_terms_of_each_text_come_from_shared_parts(spark):
    """An article's texts share their words, and every run still has the terms of its own text."""
    import random
    from collections import Counter

    from linklens.functions import urls as U
    rng = random.Random(3)
    bits = ["2019", "05", "/", "/", "-", "a", "b", "Σ", ";", "?", "#", "199", "٢٠١٩", ".", "//", "ab1", "_", "/05/", "2010-11-12"]
    hosts = ["http://h.com", "HTTPS://H.COM/", "//h-05", "http://h1/", "", "h2019/"]
    rows = [(rng.choice(hosts) + "".join(rng.choice(bits) for _ in range(rng.randrange(8))),
             "".join(rng.choice(bits) for _ in range(rng.randrange(5))), "x", "d") for _ in range(600)]
    rows += [(None, None, "x", "d"), ("http://www.h.com/news/one-two", "three four", "x", "d")]
    arts = spark.createDataFrame(rows, "url string, title string, category string, language string").repartition(3)
    none = F.array().cast("array<string>")
    found = RN._with_words(arts).select(
        "url", F.transform("words", lambda w: F.struct(w["runs"], F.coalesce(TF.tokens(w["text"]), none))).alias("parts"),
        *[F.coalesce(TF.tokens(c if k == "with_dates" else U.strip_dates(c)), none).alias(f"{f} {k}")
          for f, c in RN._TEXTS.items() for k in RN.CONDITIONS]).collect()
    for r in found:
        for k, (f, c) in enumerate(RN.RUNS):
            assert Counter(t for runs, terms in r.parts if runs >> k & 1 for t in terms) == Counter(r[f"{f} {c}"]), (r.url, f, c)
    plain = [r for r in found if r.url == "http://www.h.com/news/one-two"]
    assert sum(len(terms) for _, terms in plain[0].parts) == len("three four http www com news one two".split())


def test_runs_are_fitted_once_for_cells_and_throughput(spark, monkeypatch, tmp_path):
    from linklens.plans import registry as R
    rows = [(i, f"http://h.com/tech/{'ab'[i % 2]}{i}", f"w{i % 7} {'sun' if i % 2 else 'tax'}", "xy"[i % 2], "de"[i % 3 % 2]) for i in range(200)]
    arts = spark.createDataFrame(rows, "article_id long, url string, title string, category string, language string")
    monkeypatch.setattr(R, "arts", lambda *a: arts)
    fits = []
    real = RN.run_models
    monkeypatch.setattr(RN, "run_models", lambda *a: fits.append(a) or real(*a))
    speed = {(r.dataset, r.model): r.throughput for r in R.measured_runs(spark, str(tmp_path)).collect()}
    assert len(fits) == 1 and len(speed) == 2 * len(RN.MODELS) and all(v > 0 for v in speed.values())
    # a title has no slug, and so no run of the mapping
    assert R.runs(spark, str(tmp_path)).count() == 2 * (len(RN.MODELS) * len(RN.RUNS) - 2) and len(fits) == 1
