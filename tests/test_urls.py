"""Hand-made edge rows for the URL scalar functions (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from linklens.functions import text as TX
from linklens.functions import urls as U


def one_col(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def col_values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_url_parse_netloc_and_path(spark):
    df = one_col(spark, ["http://u:p@a.com:80/x", "http://a.com/b;c=1?q#f", "http://a.com/b c/é", "nope", ""])
    assert col_values(df, U.url_netloc("x")) == ["u:p@a.com:80", "a.com", "a.com", "", ""]
    assert col_values(df, U.url_path("x")) == ["/x", "/b", "/b c/é", "nope", ""]
    assert col_values(df, U.url_scheme("x")) == ["http", "http", "http", "", ""]


def test_clean_path_and_word_filter(spark):
    df = one_col(spark, ["/", "/a-b\\c/"])
    assert col_values(df, U.clean_path("x")) == [" ", " a b c "]
    assert col_values(df, U.has_word_char(U.clean_path("x"))) == [False, True]


def test_registered_host(spark):
    df = one_col(spark, ["http://localhost/x", "http://10.0.0.1/x", None, "https://WWW.News.co.uk:8080/a",
                         "http://u@blog.example.com/"])
    assert col_values(df, U.registered_host("x")) == [None, None, None, "www.news.co.uk", "blog.example.com"]


def test_candidate_slugs(spark):
    df = one_col(spark, ["/2014/05/tv/Business/"])
    assert col_values(df, U.candidate_slugs("x")) == [["Business"]]


def test_first_section_and_entry_slug(spark):
    df = one_col(spark, ["http://a.com", "https://www.h.com/entry/big-story-here_us_12"])
    assert col_values(df, U.first_section("x")) == ["", "entry"]
    assert col_values(df, U.entry_slug("x"))[1] == "big story here"


def test_skeleton(spark):
    df = one_col(spark, ["/a/123/deadbeef01/x", "/12345678", "", "//a//"])
    assert col_values(df, U.url_skeleton("x")) == ["/a/{num}/{id}/x", "/{num}", "/", "/a"]


def test_strip_dates(spark):
    df = one_col(spark, ["/2014/05/03/x", "/a-2014-05/b", "/x/07/y", None])
    assert col_values(df, U.strip_dates("x")) == ["/x", "/a-/b", "/xy", None]


def test_structure_flags_and_types(spark):
    df = one_col(spark, ["/", "/1a", "/12a"])
    assert col_values(df, U.structure_columns("x")["is_id_heavy"]) == [False, False, True]
    df = one_col(spark, ["/news", "/News/x"])
    assert col_values(df, U.structure_columns("x")["has_category_indicators"]) == [False, True]
    df = one_col(spark, ["/1234567", "/news/story", "/a/story", "/longword/2014/other/z", "/x", "/a/b/c"])
    assert col_values(df, U.structure_columns("x")["url_type"]) == [
        "id_based", "semantic_structured", "semantic_unstructured", "date_based", "simple", "mixed"]


def test_segment_lengths(spark):
    df = one_col(spark, ["/ab/cdef/", ""])
    c = U.structure_columns("x")
    assert col_values(df, c["num_segments"]) == [2, 0]
    assert col_values(df, c["avg_segment_length"]) == [3.0, 0.0]


def test_rule_labels_first_match_wins(spark):
    df = one_col(spark, ["/2014/05/03/x.html", "/9/x", "/A.PHP", "/x"])
    assert col_values(df, U.rule_label("x")) == ["date_based", "numeric_id", "slug_only", "other"]


def test_depth_columns(spark):
    df = one_col(spark, ["/a/12/b3", "", "/7"])
    d = U.depth_columns("x")
    rows = df.select(*[v.alias(k) for k, v in d.items()]).collect()
    assert [tuple(r) for r in rows] == [(3, 2, 1, 1, True), (0, 0, 0, 0, False), (1, 0, 0, 0, True)]


def test_feature_text_null_part_empties(spark):
    df = spark.createDataFrame([("t", None)], "title string, subtitle string")
    assert col_values(df, TX.feature_text("title_subtitle", "articles")) == [""]
    assert col_values(df, TX.feature_text("title", "articles")) == ["t"]
    assert TX.feature_text("snippet_description", "uci") is None


def test_map_answer(spark):
    df = one_col(spark, [" Sports ", "it is business", "", "zzz"])
    assert col_values(df, TX.map_answer("x", ["business", "sports"])) == ["sports", "business", "business", None]


def test_parse_category_line(spark):
    df = one_col(spark, ["Category: Health\nmore", "no label", "Category: Other"])
    assert col_values(df, TX.parse_category_line("x", {"Health": 2})) == [2, None, None]


def test_strip_dates_equals_all_patterns(spark):
    import random
    rng = random.Random(5)
    texts = ["".join(rng.choice(["/", "-", "0", "1", "2", "9", "20", "199", "12", "a", "_", "\u0663"]) for _ in range(rng.randint(0, 14)))
             for _ in range(3000)]
    p = F.col("x")
    for pattern in U.DATE_PATTERNS:
        p = F.regexp_replace(p, "(?U)" + pattern, "")
    for pattern, to in [("/{2,}", "/"), ("-{2,}", "-"), ("[/-]+$", "")]:
        p = F.regexp_replace(p, pattern, to)
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert df.where(~p.eqNullSafe(U.strip_dates("x"))).count() == 0
