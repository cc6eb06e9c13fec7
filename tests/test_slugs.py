"""Weak labels (J6), mapping-order match (J7), section joins and the gate."""

from pyspark.sql import functions as F

from linklens.operators import slugs as SL
from linklens.sources import tables as T


def urls(spark, values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "article_id string, url string")


def test_weak_labels_first_in_path_order(spark):
    df = urls(spark, ["http://h/tech/latest/x", "http://h/m/abc", "http://h/TECH/x", "http://h/2014/business/",
                      "http://h/x/news/y"])
    out = SL.weak_labels(df, T.slug_map(spark)).orderBy("article_id").collect()
    assert [(r.distant_label, r.matched_slug) for r in out] == [
        ("SMALL", "tech"), ("unknown", None), ("unknown", None),
        ("PROMO", "business"), ("unknown", None)]


def million(spark):
    """A mapping far beyond the broadcast check, with repeated and nested slugs."""
    return spark.range(1_000_000).select(
        F.col("id").alias("slug_rank"),
        F.expr("CASE WHEN id % 1000 = 7 THEN concat('Sec', id, '/sub', id % 5) "
               "WHEN id % 10 = 3 THEN concat('slug', id - 1) ELSE concat('slug', id) END").alias("slug"),
        F.concat(F.lit("c"), F.col("id") % 40).alias("category"))


def test_large_mapping_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(SL, "broadcast_if_small", lambda d, *a: d)
    paths = ["/slug5/slug4", "/x/slug12/y", "/slug999999?q", "/none", "", "/SLUG5/sec1007/sub2#f", "slug21/x", "/slug21x"]
    df = spark.createDataFrame([("same", f"http://h{p}", i) for i, p in enumerate(paths)],
                               "article_id string, url string, i int")
    got = {r.i: (r.matched_slug, r.distant_label) for r in SL.weak_labels(df, million(spark)).collect()}
    # of repeated slugs the last row counts: slug12 is at 12 and 13
    assert got == {0: ("slug5", "c5"), 1: ("slug12", "c13"), 2: ("slug999999", "c39"), 3: (None, "unknown"),
                   4: (None, "unknown"), 5: (None, "unknown"), 6: (None, "unknown"), 7: (None, "unknown")}
    got = {r.i: r.c for r in SL.mapped_category(df, million(spark), "url", "c").collect()}
    # mapping order: the lowest rank wins
    assert got == {0: "c4", 1: "c12", 2: "c39", 3: None, 4: None, 5: "c5", 6: None, 7: None}


def test_component_runs_equal_the_literal_rule(spark):
    import itertools
    import random
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab/?#") for _ in range(rng.randrange(9))) for _ in range(300)] + ["", "/", "//", "a/b"]
    slugs = ["".join(p) for n in (1, 2, 3) for p in itertools.product("ab/?#", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", SL.component_runs(F.col("t"), 4).alias("runs"))
    for r in df.collect():
        want = {s for s in slugs if f"/{s}/" in r.t or r.t.endswith(f"/{s}") or r.t.startswith(f"{s}/")
                or f"/{s}?" in r.t or f"/{s}#" in r.t}
        assert {x for x in r.runs if x in set(slugs)} == want, (r.t, r.runs)


def test_lookup_keeps_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([("1", "http://h/tech/x", "a"), ("1", "http://h/tech/x", "a"), ("1", "http://h/m/x", "b"),
                                (None, None, None)], "article_id string, url string, category string")
    out = sorted(map(tuple, SL.weak_labels(df, T.slug_map(spark)).collect()), key=str)
    assert out == sorted([("1", "http://h/tech/x", "a", "tech", "SMALL", "SMALL")] * 2 +
                         [("1", "http://h/m/x", "b", None, None, "unknown"), (None, None, None, None, None, "unknown")], key=str)
    assert SL.mapped_category(df.limit(0), T.slug_map(spark), "url").count() == 0


def test_mapped_category_mapping_order(spark):
    df = spark.createDataFrame([("1", "http://h/TECH/x"), ("2", "http://h/latest/tech/x"),
                                ("3", "http://h/x?u=/m"), ("4", "tech/x"), ("5", "tech"), ("6", None)],
                               "article_id string, text string")
    out = SL.mapped_category(df, T.slug_map(spark), "text").orderBy("article_id").collect()
    assert [r.mapped_category for r in out] == ["SMALL", "SMALL", "STANDARD", "SMALL", None, None]


def test_derive_labels_keeps_all_rows(spark):
    df = urls(spark, ["http://h/business/x", "http://h/news/x", "http://h"])
    out = SL.derive_labels(df, T.slug_map(spark)).orderBy("article_id").collect()
    assert [r.derived_label for r in out] == ["PROMO", None, None]


def test_gate_and_training_set(spark):
    rows = ["http://h/sports/%d" % i for i in range(60)] + ["http://h/none/%d" % i for i in range(40)]
    df = urls(spark, rows)
    chk = SL.url_tagging_check(df, T.slug_map(spark)).first()
    assert chk.sample_size == 100 and chk.matches == 60 and chk.uses_url_tagging
    wt = SL.weak_training_set(df, T.slug_map(spark))
    assert wt.count() == 60 and {r.category_label for r in wt.collect()} == {"LARGE"}
    small = urls(spark, ["http://h/sports/1"] * 10)
    assert SL.weak_training_set(small, T.slug_map(spark)).count() == 0  # sample too small


def test_slug_template_and_valid_categories(spark):
    df = urls(spark, ["http://h/a/1", "http://h/a/2", "http://h/b/1"])
    t = SL.slug_template(df, top=1).collect()
    assert [(r.slug, r.n, r.category) for r in t] == [("a", 2, "")]
    assert [r.category for r in SL.valid_categories(T.slug_map(spark)).collect()] == [
        "ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
