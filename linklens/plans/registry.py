"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and for the
SQL-expressible ones the DuckDB oracle text over the same base tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.functions import text as TX
from linklens.functions import urls as U
from linklens.operators import distribution as D
from linklens.operators import filters as FL
from linklens.operators import hosts as H
from linklens.plans import sqlfrag as S
from linklens.plans.views_sql import with_views
from linklens.session import materialize, table_exists, table_path
from linklens.sources import loaders as L
from linklens.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def arts(spark, sf):
    return T.articles(spark, sf)


# ---------------------------------------------------------------- sources -----

@query("load_articles", with_views(f"""
, counts AS (SELECT category, count(*) AS n FROM articles GROUP BY 1),
tot AS (SELECT sum(n) AS t FROM counts),
keep AS (SELECT category FROM counts, tot WHERE category IS NOT NULL AND CAST(n AS DOUBLE) / t > 0.165),
base AS (SELECT *, {S.netloc('url')} AS netloc, {S.path('url')} AS path FROM articles
         WHERE category IN (SELECT category FROM keep) AND starts_with(url, 'http'))
SELECT article_id, url, title, subtitle, CAST(NULL AS VARCHAR) AS summary, category, publisher,
       'articles' AS dataset, language, netloc, path, {S.clean('path')} AS path_clean
FROM base WHERE regexp_matches({S.clean('path')}, '\\w')
""".replace("\n, counts", ", counts", 1)))
def q_load_articles(spark, sf):
    return L.load_articles(arts(spark, sf), "articles")


# ------------------------------------------------------------- URL scalars ----

@query("url_parts", with_views(f"""
SELECT article_id, lower(regexp_extract(url, '{S.PAT}', 1)) AS scheme, {S.netloc('url')} AS netloc,
       {S.path('url')} AS path, {S.netloc('url')} || {S.path('url')} AS netloc_path,
       CASE WHEN {S.netloc('url')} = '' THEN 'unknown' ELSE {S.netloc('url')} END AS domain
FROM articles"""))
def q_url_parts(spark, sf):
    a = arts(spark, sf)
    return a.select("article_id", U.url_scheme("url").alias("scheme"), U.url_netloc("url").alias("netloc"),
                    U.url_path("url").alias("path"), U.netloc_path("url").alias("netloc_path"),
                    U.domain_or_unknown("url").alias("domain"))


@query("clean_path", with_views(f"""
SELECT article_id, {S.clean(S.path('url'))} AS path_clean,
       regexp_matches({S.clean(S.path('url'))}, '\\w') AS has_word
FROM articles"""))
def q_clean_path(spark, sf):
    a = arts(spark, sf)
    pc = U.clean_path(U.url_path("url"))
    return a.select("article_id", pc.alias("path_clean"), U.has_word_char(pc).alias("has_word"))


# the rules of the test view; the joins below compare every host with every rule
def suffix_sql(rows: str) -> str:
    return f"""
rules(rule) AS (VALUES ('com'), ('net'), ('org.uk'), ('example.com'), ('*.example.net'), ('!ththan.example.net')),
u AS (SELECT *, lower(regexp_replace(regexp_replace({S.netloc('url')}, '^.*@', ''), ':[0-9]*$', '')) AS host
      FROM {rows}),
hosts AS (SELECT DISTINCT host, len(string_split(host, '.')) AS n FROM u WHERE host <> ''),
hit AS (SELECT host, n, starts_with(rule, '!') AS exc,
               len(string_split(rule, '.')) - CASE WHEN starts_with(rule, '!') THEN 1 ELSE 0 END AS k
        FROM hosts JOIN rules ON CASE WHEN starts_with(rule, '*.') THEN ends_with(host, substr(rule, 2))
             ELSE ends_with('.' || host, '.' || ltrim(rule, '!')) END),
best AS (SELECT host, n, arg_max(k, (exc, k)) AS k FROM hit WHERE k <= n GROUP BY host, n),
sfx AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), n - k + 1, n), '.') AS public_suffix,
               CASE WHEN n > k AND string_split(host, '.')[n - k] <> ''
                    THEN array_to_string(list_slice(string_split(host, '.'), n - k, n), '.') END AS registered_domain
        FROM best)"""


SUFFIX_SQL = suffix_sql("pages")


@query("registered_domain", f"""
WITH {SUFFIX_SQL}
SELECT page_id, url, CASE WHEN registered_domain IS NOT NULL THEN host END AS registered_host,
       public_suffix, registered_domain
FROM u LEFT JOIN sfx USING (host)""")
def q_registered_domain(spark, sf):
    p = T.read_table(spark, sf, "pages").select("page_id", "url")
    return H.registered_hosts(p, T.suffix_rules(spark), "url")


@query("domain_extraction_report", f"""
WITH {SUFFIX_SQL}
SELECT count(*) AS total_urls, count(registered_domain) AS valid_domains,
       CAST(count(registered_domain) AS DOUBLE) / count(*) AS valid_share,
       count(DISTINCT CASE WHEN registered_domain IS NOT NULL THEN host END) AS unique_domains
FROM u LEFT JOIN sfx USING (host)""")
def q_domain_report(spark, sf):
    return H.domain_extraction_report(T.read_table(spark, sf, "pages"), T.suffix_rules(spark), "url")


@query("unlisted_hosts", f"""
WITH {SUFFIX_SQL}
SELECT host, count(*) AS n FROM u LEFT JOIN sfx USING (host) WHERE host <> '' AND public_suffix IS NULL GROUP BY host""")
def q_unlisted_hosts(spark, sf):
    return H.unlisted_hosts(T.read_table(spark, sf, "pages"), T.suffix_rules(spark), "url")


@query("path_segments", with_views(f"""
SELECT article_id, array_to_string({S.segs(S.path('url'))}, '|') AS segments,
       len({S.segs(S.path('url'))}) AS n_segments
FROM articles"""))
def q_path_segments(spark, sf):
    a = arts(spark, sf)
    s = U.path_segments(U.url_path("url"))
    return a.select("article_id", F.array_join(s, "|").alias("segments"),
                    F.size(s).cast("long").alias("n_segments"))


@query("candidate_slugs", with_views(f"""
SELECT article_id, array_to_string({S.candidate_slugs(S.path('url'))}, '|') AS slugs
FROM articles"""))
def q_candidate_slugs(spark, sf):
    a = arts(spark, sf)
    return a.select("article_id", F.array_join(U.candidate_slugs(U.url_path("url")), "|").alias("slugs"))


@query("first_section", with_views(f"""
SELECT article_id, {S.first_section('url')} AS section FROM articles"""))
def q_first_section(spark, sf):
    return arts(spark, sf).select("article_id", U.first_section("url").alias("section"))


@query("after_tld_text", with_views("""
SELECT article_id, replace(replace(split_part(url, '.com/', 2), '/', ' '), '-', ' ') AS x,
       replace(replace(split_part(replace(url, '.com.br', '.com'), '.com/', 2), '/', ' '), '-', ' ') AS x_br
FROM articles"""))
def q_after_tld_text(spark, sf):
    return arts(spark, sf).select("article_id", U.after_tld_text("url").alias("x"),
                                  U.after_tld_text("url", rewrite_br=True).alias("x_br"))


@query("entry_slug", with_views("""
SELECT article_id, replace(split_part(split_part(p, 'entry/', -1), '_', 1), '-', ' ') AS slug
FROM (SELECT article_id, replace(url, '/article/', '/entry/') AS p FROM articles)"""))
def q_entry_slug(spark, sf):
    a = arts(spark, sf).select("article_id", F.replace("url", F.lit("/article/"), F.lit("/entry/")).alias("p"))
    return a.select("article_id", U.entry_slug("p").alias("slug"))


@query("url_skeleton", with_views(f"""
SELECT article_id, {S.skeleton(S.path('url'))} AS skeleton FROM articles"""))
def q_url_skeleton(spark, sf):
    return arts(spark, sf).select("article_id", U.url_skeleton(U.url_path("url")).alias("skeleton"))


@query("strip_dates", with_views(f"""
SELECT article_id, {S.strip_dates(S.path('url'))} AS path_no_dates,
       {S.clean(S.strip_dates(S.path('url')))} AS path_clean_no_dates
FROM articles"""))
def q_strip_dates(spark, sf):
    a = arts(spark, sf)
    nd = U.strip_dates(U.url_path("url"))
    return a.select("article_id", nd.alias("path_no_dates"), U.clean_path(nd).alias("path_clean_no_dates"))


def _structure_sql(src: str = "articles", keep=("article_id", "category", "publisher")) -> str:
    p = S.path("url")
    cols = ", ".join(f"{v} AS {k}" for k, v in S.structure(p).items())
    return f"SELECT {', '.join(keep)}, url, {S.netloc('url')} AS domain, {cols} FROM {src}"


@query("url_structure", with_views(_structure_sql()))
def q_url_structure(spark, sf):
    from linklens.operators import structure as ST
    return ST.url_structure(arts(spark, sf))


@query("rule_labels", with_views(f"""
SELECT article_id, {S.rule_label(S.path('url'))} AS rule FROM articles"""))
def q_rule_labels(spark, sf):
    return arts(spark, sf).select("article_id", U.rule_label(U.url_path("url")).alias("rule"))


# ------------------------------------------------------------------ filters ---

@query("frequent_categories", with_views("""
, counts AS (SELECT category, count(*) AS n FROM articles GROUP BY 1),
tot AS (SELECT sum(n) AS t FROM counts)
SELECT a.article_id, a.category FROM articles a
WHERE a.category IN (SELECT category FROM counts, tot WHERE CAST(n AS DOUBLE) / t > 0.165)
""".replace("\n, counts", ", counts", 1)))
def q_frequent_categories(spark, sf):
    return FL.frequent_categories(arts(spark, sf).select("article_id", "category"), "category", 0.165)


@query("frequent_categories_pct", with_views("""
, tot AS (SELECT count(*) AS t FROM articles),
pcts AS (SELECT category, count(url) * 100.0 / max(t) AS pct FROM articles, tot
         WHERE category IS NOT NULL GROUP BY category)
SELECT a.article_id, a.category FROM articles a
WHERE a.category IN (SELECT category FROM pcts WHERE pct >= 16.5)
""".replace("\n, tot", ", tot", 1)))
def q_frequent_categories_pct(spark, sf):
    a = arts(spark, sf).select("article_id", "category", "url")
    return FL.frequent_categories(a, "category", 0.165, strict=False, numerator="url").drop("url")


# ----------------------------------------------------------- distributions ----

@query("category_counts", with_views("""
SELECT category, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
FROM articles WHERE category IS NOT NULL GROUP BY category"""))
def q_category_counts(spark, sf):
    return D.value_counts(arts(spark, sf), "category")


@query("category_summary", with_views("""
, c AS (SELECT category, count(*) AS n FROM articles WHERE category IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_categories, CAST(sum(n) AS BIGINT) AS n_records,
       arg_min(category, (-n, category)) AS most_common,
       arg_max(category, (-n, category)) AS least_common,
       CAST(min(n) AS DOUBLE) / max(n) AS balance_ratio,
       -sum((CAST(n AS DOUBLE) / t) * log2(CAST(n AS DOUBLE) / t)) AS entropy,
       1 - sum((CAST(n AS DOUBLE) / t) * (CAST(n AS DOUBLE) / t)) AS gini_impurity
FROM c, (SELECT sum(n) AS t FROM c) tt
""".replace("\n, c AS", ", c AS", 1)))
def q_category_summary(spark, sf):
    return D.category_summary(arts(spark, sf), "category")


@query("text_length_stats", with_views("""
SELECT 'title' AS "column", avg(length(title)) AS mean, quantile_cont(length(title), 0.5) AS median,
       stddev_samp(length(title)) AS std, min(length(title)) AS min, max(length(title)) AS max,
       quantile_cont(length(title), 0.25) AS q25, quantile_cont(length(title), 0.75) AS q75
FROM articles"""))
def q_text_length_stats(spark, sf):
    return D.text_length_stats(arts(spark, sf))


# ---------------------------------------------------- distribution / skew -----
from linklens.plans import sqlgen as G  # noqa: E402


def _ctes(*parts: str) -> str:
    return ",".join(p for p in parts)


@query("domain_distribution", with_views(", " + _ctes(G.domdist_ctes("articles", "publisher", []))
                                         + "\nSELECT * FROM dd"))
def q_domain_distribution(spark, sf):
    return D.domain_distribution(arts(spark, sf), "publisher")


@query("domain_skew", with_views(", " + G.skew_ctes("articles", "publisher", []) + "\nSELECT * FROM skew"))
def q_domain_skew(spark, sf):
    return D.domain_skew(arts(spark, sf), "publisher")


@query("category_per_domain", with_views(", " + G.per_domain_ctes("articles", "publisher", "category", [])
                                         + "\nSELECT domain AS publisher, * EXCLUDE (domain) FROM pd"))
def q_category_per_domain(spark, sf):
    return D.category_per_domain(arts(spark, sf), "publisher", "category")


@query("category_per_domain_summary", with_views(
    ", " + G.per_domain_ctes("articles", "publisher", "category", []) + "\nSELECT * FROM pd_sum"))
def q_category_per_domain_summary(spark, sf):
    return D.category_per_domain_summary(arts(spark, sf), "publisher", "category")


@query("domain_category_cube", with_views("""
SELECT publisher, category, count(*) AS n, grouping_id(publisher, category) AS grouping_id
FROM articles GROUP BY CUBE (publisher, category)"""))
def q_domain_category_cube(spark, sf):
    return D.domain_category_cube(arts(spark, sf), "publisher", "category")


@query("crosstab_shares", with_views("""
SELECT publisher, category, count(*) AS n,
       CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY publisher) AS share
FROM articles WHERE publisher IS NOT NULL AND category IS NOT NULL GROUP BY publisher, category"""))
def q_crosstab_shares(spark, sf):
    return D.crosstab_shares(arts(spark, sf), "publisher", "category")


@query("chi2_independence", with_views("""
, cells AS (SELECT publisher, category, count(*) AS o FROM articles
            WHERE publisher IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
rws AS (SELECT publisher, sum(o) AS r_tot FROM cells GROUP BY 1),
cls AS (SELECT category, sum(o) AS c_tot FROM cells GROUP BY 1),
dims AS (SELECT (SELECT count(*) FROM rws) AS r, (SELECT count(*) FROM cls) AS c,
                (SELECT CAST(sum(o) AS DOUBLE) FROM cells) AS n),
st AS (SELECT n * (sum(CAST(o AS DOUBLE) * o / (r_tot * c_tot)) - 1) AS chi2, max(r) AS r, max(c) AS c, max(n) AS n
       FROM cells JOIN rws USING (publisher) JOIN cls USING (category), dims GROUP BY n)
SELECT chi2 AS chi2_statistic, CAST((r - 1) * (c - 1) AS BIGINT) AS degrees_of_freedom,
       sqrt(chi2 / (n * (least(r, c) - 1))) AS cramers_v FROM st
""".replace("\n, cells", ", cells", 1)))
def q_chi2_independence(spark, sf):
    return D.chi2_independence(arts(spark, sf), "publisher", "category", with_p_value=False)


@query("chi2_test", None)
def q_chi2_test(spark, sf):
    """A16 with the p-value (rows-only: the p-value has no SQL form)."""
    return D.chi2_independence(arts(spark, sf), "publisher", "category", with_p_value=True)


@query("dataset_comparison", with_views(
    ", " + _ctes(G.catsum_ctes("articles", "category", ["language"]),
                 G.skew_ctes("articles", "publisher", ["language"]),
                 G.per_domain_ctes("articles", "publisher", "category", ["language"])) + """
SELECT language AS dataset, cs.n_records, cs.n_categories, skew.n_domains, skew.gini_coefficient,
       skew.top_1_domain_share, pd_sum.single_category_domains_share,
       pd_sum.records_in_single_category_domains_share
FROM cs JOIN skew USING (language) JOIN pd_sum USING (language)"""))
def q_dataset_comparison(spark, sf):
    a = arts(spark, sf).withColumnRenamed("language", "dataset")
    return D.dataset_comparison(a, "dataset", "publisher", "category")


ARTICLE_COLS = ["article_id", "url", "title", "subtitle", "category", "publisher", "language", "noise"]


@query("null_counts", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM articles"
    for c in ARTICLE_COLS)))
def q_null_counts(spark, sf):
    return D.null_counts(arts(spark, sf).select(*ARTICLE_COLS))


_DOMAIN = f"CASE WHEN {S.netloc('url')} = '' THEN 'unknown' ELSE {S.netloc('url')} END"


@query("domain_concentration", with_views(f"""
, d AS (SELECT {_DOMAIN} AS domain FROM articles),
dc AS (SELECT domain, count(*) AS n FROM d WHERE domain <> 'unknown' AND domain <> '' GROUP BY 1),
rk AS (SELECT domain, n, row_number() OVER (ORDER BY n DESC, domain) AS rank FROM dc),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS total_articles, count(*) AS unique_domains FROM dc),
sh AS (SELECT sum(n) FILTER (WHERE rank <= 5) AS t5, sum(n) FILTER (WHERE rank <= 10) AS t10 FROM rk)
SELECT domain, n, rank, total_articles, unique_domains,
       CAST(t5 AS DOUBLE) / total_articles * 100 AS top5_share_pct,
       CAST(t10 AS DOUBLE) / total_articles * 100 AS top10_share_pct,
       CAST(n AS DOUBLE) / total_articles * 100 AS share_pct
FROM rk, tot, sh WHERE rank <= 10""".replace("\n, d AS", ", d AS", 1)))
def q_domain_concentration(spark, sf):
    return D.domain_concentration(arts(spark, sf), "url", 10)


@query("top_domain_topics", with_views(f"""
, d AS (SELECT {_DOMAIN} AS domain, category FROM articles),
top AS (SELECT domain FROM d GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 5),
cells AS (SELECT domain, category, count(*) AS n FROM d WHERE domain IN (SELECT domain FROM top) GROUP BY 1, 2)
SELECT domain, count(*) AS n_topics, CAST(sum(n) AS BIGINT) AS n_articles,
       greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0) AS entropy
FROM cells GROUP BY domain""".replace("\n, d AS", ", d AS", 1)))
def q_top_domain_topics(spark, sf):
    a = arts(spark, sf).select(U.domain_or_unknown("url").alias("domain"), "category")
    return D.top_domain_topics(a, "domain", "category", 5)


@query("domain_topic_matrix", with_views(f"""
, d AS (SELECT {_DOMAIN} AS domain, category FROM articles),
td AS (SELECT domain FROM d GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 10),
tt AS (SELECT category FROM d GROUP BY category ORDER BY count(*) DESC, category LIMIT 10),
cells AS (SELECT domain, category, count(*) AS n FROM d
          WHERE domain IN (SELECT domain FROM td) AND category IN (SELECT category FROM tt) GROUP BY 1, 2)
SELECT domain, category, n, CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY domain) AS pct FROM cells
""".replace("\n, d AS", ", d AS", 1)))
def q_domain_topic_matrix(spark, sf):
    a = arts(spark, sf).select(U.domain_or_unknown("url").alias("domain"), "category")
    return D.domain_topic_matrix(a, "domain", "category", 10, 10)


@query("mean_per_domain", with_views("""
SELECT CAST(count(*) AS DOUBLE) / count(DISTINCT publisher) AS mean_articles_per_domain FROM articles"""))
def q_mean_per_domain(spark, sf):
    return D.mean_per_domain(arts(spark, sf), "publisher")


# ------------------------------------------------------- URL structure ---------
from linklens.operators import metrics as M  # noqa: E402
from linklens.operators import structure as ST  # noqa: E402


def structure_frame(spark, sf):
    return ST.url_structure(arts(spark, sf))


def domain_perf(spark, sf):
    return M.per_domain_metrics(T.predictions(spark, sf), "publisher")


def combined_frame(spark, sf):
    # one row per publisher, read by several branches of the reports below
    return materialize(ST.structure_performance(structure_frame(spark, sf), domain_perf(spark, sf)))


STRUCT_CTE = ("struct", _structure_sql())
PERF_CTES = """
conf AS (SELECT publisher, label, prediction, count(*) AS n FROM predictions GROUP BY ALL),
""" + G.macro_ctes("conf", ["publisher"], "perf").lstrip()
SBP = """
sbp AS (SELECT publisher, avg(path_length) AS path_length_mean, stddev_samp(path_length) AS path_length_std,
               avg(num_segments) AS num_segments_mean, stddev_samp(num_segments) AS num_segments_std,
               round(avg(avg_segment_length), 9) AS avg_segment_length_mean,
               round(stddev_samp(avg_segment_length), 9) AS avg_segment_length_std,
               avg(CAST(has_numbers AS DOUBLE)) AS has_numbers_mean, avg(CAST(is_semantic AS DOUBLE)) AS is_semantic_mean,
               avg(CAST(is_id_heavy AS DOUBLE)) AS is_id_heavy_mean,
               avg(CAST(has_category_indicators AS DOUBLE)) AS has_category_indicators_mean
        FROM struct WHERE publisher IS NOT NULL GROUP BY publisher),
tc AS (SELECT publisher, url_type, count(*) AS n FROM struct WHERE publisher IS NOT NULL GROUP BY 1, 2),
dom AS (SELECT publisher, arg_min(url_type, (-n, url_type)) AS dominant_url_type FROM tc GROUP BY 1),
combined AS (SELECT p.publisher, p.accuracy, p.precision, p.recall, p.f1, p.n_samples AS support, sbp.* EXCLUDE (publisher),
                    dom.dominant_url_type
             FROM perf p JOIN sbp USING (publisher) JOIN dom USING (publisher))"""


def struct_sql(body: str, combined: bool = False) -> str:
    head = with_views("", STRUCT_CTE, views=("predictions",))
    tail = (",\n" + PERF_CTES + "," + SBP) if combined else ""
    return head.rstrip() + tail + "\n" + body


@query("structure_summary", struct_sql("""
SELECT count(*) AS total_urls, count(DISTINCT domain) AS unique_domains, avg(path_length) AS avg_path_length,
       avg(num_segments) AS avg_segments, avg(CAST(has_numbers AS DOUBLE)) * 100 AS pct_with_numbers,
       avg(CAST(is_semantic AS DOUBLE)) * 100 AS pct_semantic, avg(CAST(is_id_heavy AS DOUBLE)) * 100 AS pct_id_heavy,
       avg(CAST(has_category_indicators AS DOUBLE)) * 100 AS pct_with_categories,
       stddev_samp(path_length) AS path_length_std, stddev_samp(num_segments) AS segments_std,
       stddev_samp(avg_segment_length) AS avg_segment_length_std FROM struct"""))
def q_structure_summary(spark, sf):
    return ST.structure_summary(structure_frame(spark, sf))


@query("url_type_distribution", struct_sql("SELECT url_type, count(*) AS n FROM struct GROUP BY 1"))
def q_url_type_distribution(spark, sf):
    return ST.url_type_distribution(structure_frame(spark, sf))


@query("structure_by_publisher", struct_sql(",\n" + SBP.split("tc AS")[0].rstrip().rstrip(",")
                                            + "\nSELECT * FROM sbp"))
def q_structure_by_publisher(spark, sf):
    return ST.structure_by_publisher(structure_frame(spark, sf))


@query("dominant_url_type", struct_sql(""",
tc AS (SELECT publisher, url_type, count(*) AS n FROM struct WHERE publisher IS NOT NULL GROUP BY 1, 2)
SELECT publisher, arg_min(url_type, (-n, url_type)) AS dominant_url_type FROM tc GROUP BY 1"""))
def q_dominant_url_type(spark, sf):
    return ST.dominant_url_type(structure_frame(spark, sf))


@query("structure_performance", struct_sql("SELECT * FROM combined", combined=True))
def q_structure_performance(spark, sf):
    return combined_frame(spark, sf)


@query("publisher_overlap", struct_sql("""
SELECT (SELECT count(DISTINCT publisher) FROM perf) AS performance_publishers,
       (SELECT count(DISTINCT publisher) FROM struct WHERE publisher IS NOT NULL) AS structure_publishers,
       (SELECT count(*) FROM (SELECT publisher FROM perf INTERSECT
                              SELECT publisher FROM struct WHERE publisher IS NOT NULL)) AS overlap""",
                                       combined=True))
def q_publisher_overlap(spark, sf):
    return ST.publisher_overlap(domain_perf(spark, sf), structure_frame(spark, sf))


@query("performance_by_url_type", struct_sql("""
SELECT dominant_url_type, round_even(avg(accuracy), 4) AS accuracy_mean, round_even(stddev_samp(accuracy), 4) AS accuracy_std,
       count(accuracy) AS accuracy_count, round_even(avg(f1), 4) AS f1_mean, round_even(stddev_samp(f1), 4) AS f1_std,
       count(f1) AS f1_count, CAST(sum(support) AS BIGINT) AS support_sum
FROM combined GROUP BY 1""", combined=True))
def q_performance_by_url_type(spark, sf):
    return ST.performance_by_url_type(combined_frame(spark, sf), 4)


_SCOLS = ["path_length_mean", "path_length_std", "num_segments_mean", "num_segments_std",
          "avg_segment_length_mean", "avg_segment_length_std", "has_numbers_mean", "is_semantic_mean",
          "is_id_heavy_mean", "has_category_indicators_mean"]
_CORR = "\nUNION ALL\n".join(
    f"SELECT '{q}' AS quality_metric, '{s}' AS structure_metric, corr({q}, {s}) AS r FROM combined"
    for q in ["accuracy", "precision", "recall", "f1"] for s in _SCOLS)


@query("structure_correlations", struct_sql(f"""
SELECT * FROM ({_CORR}) WHERE r IS NOT NULL AND NOT isnan(r)""", combined=True))
def q_structure_correlations(spark, sf):
    return ST.structure_correlations(combined_frame(spark, sf))


@query("strongest_correlations", struct_sql(f"""
SELECT * FROM ({_CORR}) WHERE r IS NOT NULL AND NOT isnan(r)
ORDER BY abs(r) DESC, quality_metric, structure_metric LIMIT 5""", combined=True))
def q_strongest_correlations(spark, sf):
    return ST.strongest_correlations(ST.structure_correlations(combined_frame(spark, sf)), 5)


@query("high_low_comparison", struct_sql(",\nmed AS (SELECT quantile_cont(f1, 0.5) AS m FROM combined)\n" +
    "\nUNION ALL\n".join(
        f"SELECT '{s}' AS metric, avg({s}) FILTER (WHERE f1 >= m) AS high_performance_mean, "
        f"avg({s}) FILTER (WHERE f1 < m) AS low_performance_mean, "
        f"avg({s}) FILTER (WHERE f1 >= m) - avg({s}) FILTER (WHERE f1 < m) AS difference FROM combined, med"
        for s in _SCOLS), combined=True))
def q_high_low_comparison(spark, sf):
    return ST.high_low_comparison(combined_frame(spark, sf))


@query("f1_by_semantic_share", struct_sql("""
SELECT is_semantic_mean > 0.5 AS mostly_semantic, count(*) AS n, min(f1) AS min, quantile_cont(f1, 0.25) AS q25,
       quantile_cont(f1, 0.5) AS median, quantile_cont(f1, 0.75) AS q75, max(f1) AS max
FROM combined GROUP BY 1""", combined=True))
def q_f1_by_semantic_share(spark, sf):
    return ST.f1_by_semantic_share(combined_frame(spark, sf))


@query("mean_f1_by_type", struct_sql("""
SELECT dominant_url_type, avg(f1) AS f1_mean FROM combined GROUP BY 1""", combined=True))
def q_mean_f1_by_type(spark, sf):
    return ST.mean_f1_by_type(combined_frame(spark, sf))


@query("support_describe", struct_sql("""
SELECT count(support) AS count, avg(support) AS mean, stddev_samp(support) AS std,
       CAST(min(support) AS DOUBLE) AS min, quantile_cont(support, 0.25) AS q25, quantile_cont(support, 0.5) AS q50,
       quantile_cont(support, 0.75) AS q75, CAST(max(support) AS DOUBLE) AS max FROM combined""", combined=True))
def q_support_describe(spark, sf):
    return ST.describe_column(combined_frame(spark, sf), "support")


@query("path_length_hist", struct_sql(""",
rng0 AS (SELECT CAST(min(path_length) AS DOUBLE) AS lo0, CAST(max(path_length) AS DOUBLE) AS hi0 FROM struct),
rng AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
               CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM rng0),
b AS (SELECT CAST(least(floor((path_length - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
      FROM struct, rng GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin, lo, hi FROM range(0, 30), rng)
SELECT g.bin, lo + g.bin * (hi - lo) / 30 AS bin_start, lo + (g.bin + 1) * (hi - lo) / 30 AS bin_end,
       coalesce(n, 0) AS n FROM g LEFT JOIN b USING (bin)"""))
def q_path_length_hist(spark, sf):
    return ST.path_length_hist(structure_frame(spark, sf), 30)


# ------------------------------------------------------------- URL audit -------

@query("skeleton_counts", with_views(f"""
SELECT {S.skeleton(S.path('url'))} AS skeleton, count(*) AS n FROM articles GROUP BY 1
ORDER BY n DESC, skeleton LIMIT 10"""))
def q_skeleton_counts(spark, sf):
    return ST.skeleton_counts(arts(spark, sf), "url", top_n=10)


@query("skeleton_counts_all", with_views(f"""
SELECT {S.skeleton(S.path('url'))} AS skeleton, count(*) AS n FROM articles GROUP BY 1"""))
def q_skeleton_counts_all(spark, sf):
    return ST.skeleton_counts(arts(spark, sf), "url")


@query("rule_counts", with_views(f"""
, lab AS (SELECT {S.rule_label(S.path('url'))} AS rule FROM articles),
names AS (SELECT * FROM (VALUES ('date_based'), ('numeric_id'), ('slug_only'), ('other')) t(rule))
SELECT names.rule, count(lab.rule) AS n FROM names LEFT JOIN lab USING (rule) GROUP BY names.rule
""".replace("\n, lab", ", lab", 1)))
def q_rule_counts(spark, sf):
    return ST.rule_counts(arts(spark, sf), "url")


def _depth_sql() -> str:
    sg = S.segs(S.path("url"))
    d = f"len({sg})"
    other = f"greatest({d} - 1, 0)"
    num = f"len(list_filter({sg}[1:{d} - 1], lambda s: regexp_full_match(s, '[0-9]+')))"
    cols = {"depth": d, "other_segments": other,
            "other_numeric_segments": f"CASE WHEN {d} = 0 THEN 0 ELSE {num} END",
            "other_text_segments": f"{other} - CASE WHEN {d} = 0 THEN 0 ELSE {num} END"}
    sel = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    last = f"coalesce({d} > 0 AND regexp_matches({sg}[-1], '[0-9]'), false)"
    aggs = []
    for k in cols:
        aggs += [f"min({k}) AS {k}_min", f"avg({k}) AS {k}_mean", f"max({k}) AS {k}_max"]
    aggs.append("avg(CASE WHEN last_has_number THEN 1.0 ELSE 0.0 END) * 100 AS last_segment_contains_number_percent")
    return f"SELECT {', '.join(aggs)} FROM (SELECT {sel}, {last} AS last_has_number FROM articles)"


@query("depth_stats", with_views(_depth_sql()))
def q_depth_stats(spark, sf):
    return ST.depth_stats(arts(spark, sf), "url")


# ------------------------------------------------------ slugs / weak labels ----
from linklens.operators import slugs as SL  # noqa: E402
from linklens.operators import splits as SP  # noqa: E402

MAP_CTE = ("m", "SELECT slug_rank, trim(slug) AS slug, trim(category) AS category FROM slug_map "
                "WHERE trim(category) <> '' AND trim(slug) <> ''")


def slug_sql(body: str, *extra) -> str:
    return with_views(body, MAP_CTE, *extra, views=("articles", "slug_map"))


def smap(spark):
    return T.slug_map(spark)


@query("slug_template", with_views(f"""
SELECT {S.first_section('url')} AS slug, count(*) AS n, '' AS category FROM articles WHERE url IS NOT NULL
GROUP BY 1 ORDER BY n DESC, slug LIMIT 250"""))
def q_slug_template(spark, sf):
    return SL.slug_template(arts(spark, sf), "url", 250)


@query("section_label_join", slug_sql(f"""
SELECT article_id, title AS x, m.category AS y FROM articles JOIN m ON {S.first_section('url')} = m.slug"""))
def q_section_label_join(spark, sf):
    return SL.section_label_join(arts(spark, sf), smap(spark), "url", "title")


DERIVED = ("derived", f"SELECT a.article_id, a.category, m.category AS derived_label FROM articles a "
                      f"LEFT JOIN m ON {S.first_section('a.url')} = m.slug")


def derived_frame(spark, sf):
    return SL.derive_labels(arts(spark, sf).select("article_id", "url", "category"), smap(spark)).drop("url")


@query("derive_labels", slug_sql("SELECT * FROM derived", DERIVED))
def q_derive_labels(spark, sf):
    return derived_frame(spark, sf)


@query("label_breakdown", slug_sql("""
SELECT derived_label, count(*) AS n, CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER () AS pct
FROM derived GROUP BY derived_label""", DERIVED))
def q_label_breakdown(spark, sf):
    return SL.label_breakdown(derived_frame(spark, sf))


@query("label_agreement", slug_sql("""
SELECT derived_label, avg(CASE WHEN derived_label = category THEN 1.0 ELSE 0.0 END) AS accuracy,
       CAST(sum(CASE WHEN derived_label = category THEN 1 ELSE 0 END) AS BIGINT) AS matches, count(*) AS total
FROM derived WHERE derived_label IS NOT NULL AND category IS NOT NULL GROUP BY 1""", DERIVED))
def q_label_agreement(spark, sf):
    return SL.label_agreement(derived_frame(spark, sf))


@query("label_cross_view", slug_sql("""
SELECT category, count(*) AS n FROM derived WHERE derived_label = 'PROMO' GROUP BY 1""", DERIVED))
def q_label_cross_view(spark, sf):
    return SL.label_cross_view(derived_frame(spark, sf), "PROMO")


def weak_sql(src: str) -> str:
    return f"""
WITH s AS (SELECT article_id, unnest(cs) AS slug, generate_subscripts(cs, 1) AS pos
           FROM (SELECT article_id, {S.candidate_slugs(S.path('url'))} AS cs FROM {src})),
hit AS (SELECT article_id, arg_min(m.slug, pos) AS matched_slug, arg_min(m.category, pos) AS url_category
        FROM s JOIN m USING (slug) GROUP BY article_id)
SELECT a.article_id, a.url, a.category, h.matched_slug, h.url_category,
       coalesce(h.url_category, 'unknown') AS distant_label
FROM {src} a LEFT JOIN hit h USING (article_id)"""


WEAK = ("weak", weak_sql("articles"))


@query("weak_labels", slug_sql("SELECT article_id, matched_slug, url_category, distant_label FROM weak", WEAK))
def q_weak_labels(spark, sf):
    a = arts(spark, sf).select("article_id", "url")
    return SL.weak_labels(a, smap(spark)).select("article_id", "matched_slug", "url_category", "distant_label")


J7_ON = ("(contains(t, '/' || s || '/') OR ends_with(t, '/' || s) OR starts_with(t, s || '/') "
         "OR contains(t, '/' || s || '?') OR contains(t, '/' || s || '#'))")


@query("mapped_category", slug_sql(f"""
, lm AS (SELECT slug_rank, lower(slug) AS s, category FROM m),
t AS (SELECT article_id, lower(url) AS t, lower({S.path('url')}) AS tp FROM articles),
h1 AS (SELECT article_id, arg_min(category, slug_rank) AS c FROM t JOIN lm ON {J7_ON} GROUP BY 1),
h2 AS (SELECT article_id, arg_min(category, slug_rank) AS c FROM t JOIN lm ON {J7_ON.replace('(t,', '(tp,')}
       GROUP BY 1)
SELECT a.article_id, h1.c AS mapped_category, h2.c AS mapped_category_path
FROM articles a LEFT JOIN h1 USING (article_id) LEFT JOIN h2 USING (article_id)""".replace("\n, lm", ", lm", 1)))
def q_mapped_category(spark, sf):
    a = arts(spark, sf).select("article_id", "url", U.url_path("url").alias("p"))
    a = SL.mapped_category(a, smap(spark), "url", "mapped_category")
    return SL.mapped_category(a, smap(spark), "p", "mapped_category_path").select(
        "article_id", "mapped_category", "mapped_category_path")


SAMPLE_SQL = "SELECT * FROM articles ORDER BY md5('42|' || article_id), article_id LIMIT 1000"


@query("hash_sample", with_views(f"SELECT article_id, url FROM ({SAMPLE_SQL})"))
def q_hash_sample(spark, sf):
    return SL.hash_sample(arts(spark, sf).select("article_id", "url"), "article_id", 1000, 42)


@query("url_tagging_check", slug_sql(f"""
, smp AS ({SAMPLE_SQL}),
s AS (SELECT article_id, unnest(cs) AS slug FROM (SELECT article_id, {S.candidate_slugs(S.path('url'))} AS cs FROM smp)),
hit AS (SELECT DISTINCT article_id FROM s JOIN m USING (slug)),
c AS (SELECT (SELECT count(*) FROM smp) AS sample_size, (SELECT count(*) FROM hit) AS matches)
SELECT sample_size, matches, CAST(matches AS DOUBLE) / sample_size AS ratio,
       sample_size > 50 AND CAST(matches AS DOUBLE) / sample_size >= 0.10 AS uses_url_tagging FROM c
""".replace("\n, smp", ", smp", 1)))
def q_url_tagging_check(spark, sf):
    return SL.url_tagging_check(arts(spark, sf).select("article_id", "url"), smap(spark))


def gate_sql(src: str) -> str:
    return f"""
WITH smp AS (SELECT * FROM {src} ORDER BY md5('42|' || article_id), article_id LIMIT 1000),
s AS (SELECT article_id, unnest(cs) AS slug FROM (SELECT article_id, {S.candidate_slugs(S.path('url'))} AS cs FROM smp)),
hit AS (SELECT DISTINCT article_id FROM s JOIN m USING (slug))
SELECT (SELECT count(*) FROM smp) > 50 AND
       CAST((SELECT count(*) FROM hit) AS DOUBLE) / (SELECT count(*) FROM smp) >= 0.10 AS ok"""


GATE = ("gate", gate_sql("articles"))


def weak_train(spark, sf):
    return SL.weak_training_set(arts(spark, sf).select("article_id", "url", "category"), smap(spark))


@query("weak_training_set", slug_sql("""
SELECT article_id, category, distant_label AS category_label FROM weak, gate
WHERE ok AND distant_label <> 'unknown'""", WEAK, GATE))
def q_weak_training_set(spark, sf):
    return weak_train(spark, sf).select("article_id", "category", "category_label")


@query("weak_label_counts", slug_sql("""
, c AS (SELECT distant_label AS category_label, count(*) AS n FROM weak, gate
        WHERE ok AND distant_label <> 'unknown' GROUP BY 1)
SELECT category_label, n, min(n) OVER () AS min_examples, min(n) OVER () < 10 AS few_examples FROM c
""".replace("\n, c AS", ", c AS", 1), WEAK, GATE))
def q_weak_label_counts(spark, sf):
    return SL.weak_label_counts(weak_train(spark, sf))


# ------------------------------------------------------------------ splits ----

BUCKET = "('0x' || substr(md5('20240823|' || article_id), 1, 8))::BIGINT % 100"
SPLIT = f"CASE WHEN {BUCKET} < 80 THEN 'train' WHEN {BUCKET} < 90 THEN 'val' ELSE 'test' END"


@query("split_assign", with_views(f"SELECT article_id, {SPLIT} AS split FROM articles"))
def q_split_assign(spark, sf):
    return SP.assign_split(arts(spark, sf).select("article_id"))


@query("split_counts", with_views(f"SELECT {SPLIT} AS split, count(*) AS n FROM articles GROUP BY 1"))
def q_split_counts(spark, sf):
    return SP.split_counts(SP.assign_split(arts(spark, sf).select("article_id")))


BUCKET3 = "('0x' || substr(md5('20240823|' || article_id), 1, 8))::BIGINT % 1000"


@query("split_assign_70_20_10", with_views(f"""
SELECT CASE WHEN {BUCKET3} < 700 THEN 'train' WHEN {BUCKET3} < 901 THEN 'val' ELSE 'test' END AS split,
       count(*) AS n FROM articles GROUP BY 1"""))
def q_split_70(spark, sf):
    a = SP.assign_split(arts(spark, sf).select("article_id"), cuts=(("train", 700), ("val", 901)),
                        buckets=1000)
    return SP.split_counts(a)


@query("stratified_subset", with_views("""
, d AS (SELECT article_id, category, md5('42|' || article_id) AS h FROM articles),
cnt AS (SELECT category, count(*) AS nc FROM d GROUP BY 1),
q AS (SELECT category, least(nc, greatest(1, floor(1000 * nc / (SELECT sum(nc) FROM cnt)))) AS quota FROM cnt),
tot AS (SELECT sum(quota) AS s FROM q),
r AS (SELECT d.*, row_number() OVER (PARTITION BY category ORDER BY h, article_id) AS rn FROM d),
strat AS (SELECT r.article_id, r.category FROM r JOIN q USING (category) WHERE rn <= quota),
plain AS (SELECT article_id, category FROM d ORDER BY h, article_id LIMIT 1000)
SELECT strat.* FROM strat, tot WHERE s >= 1000
UNION ALL SELECT plain.* FROM plain, tot WHERE s < 1000""".replace("\n, d AS", ", d AS", 1)))
def q_stratified_subset(spark, sf):
    a = arts(spark, sf).select("article_id", "category")
    return SP.stratified_subset(a, 1000, "category", "article_id", 42, "reference")


# ----------------------------------------------------------- feature text -----

FEAT_BASE = f"SELECT *, {S.path('url')} AS path, {S.clean(S.path('url'))} AS path_clean FROM articles"
FEATS = {"title_subtitle": "coalesce(title || ' ' || subtitle, '')", "title": "coalesce(title, '')",
         "url_heading_subhead": "coalesce(url || ' ' || title || ' ' || subtitle, '')",
         "url_raw": "coalesce(url, '')", "url_path_raw": "coalesce(path, '')",
         "url_path_cleaned": "coalesce(path_clean, '')"}


def feature_frame(spark, sf):
    a = L.with_url_parts(arts(spark, sf))
    cols = [TX.feature_text(f, "articles") for f in TX.FEATURES]
    return a.select("article_id", "language", *[c.alias(f) for f, c in zip(TX.FEATURES, cols) if c is not None])


@query("feature_text", with_views("SELECT article_id, " + ", ".join(f"{v} AS {k}" for k, v in FEATS.items())
                                  + " FROM fb", ("fb", FEAT_BASE)))
def q_feature_text(spark, sf):
    return feature_frame(spark, sf).drop("language")


@query("feature_availability", with_views("\nUNION ALL\n".join(
    f"SELECT language AS dataset, '{k}' AS feature, avg(CASE WHEN {v} <> '' THEN 1.0 ELSE 0.0 END) AS share "
    f"FROM fb GROUP BY language" for k, v in FEATS.items()), ("fb", FEAT_BASE)))
def q_feature_availability(spark, sf):
    f = feature_frame(spark, sf)
    feats = [c for c in f.columns if c not in ("article_id", "language")]
    wide = f.groupBy(F.col("language").alias("dataset")).agg(
        *[F.avg((F.col(c) != "").cast("double")).alias(c) for c in feats])
    stack = "stack({}, {}) as (feature, share)".format(len(feats), ", ".join(f"'{c}', `{c}`" for c in feats))
    return wide.selectExpr("dataset", stack)


@query("url_variants", with_views(f"""
SELECT article_id, {S.path('url')} AS path, {S.netloc('url')} || {S.path('url')} AS netloc_path,
       {S.clean(S.path('url'))} AS cleaned_path FROM articles"""))
def q_url_variants(spark, sf):
    return arts(spark, sf).select("article_id", U.url_path("url").alias("path"),
                                  U.netloc_path("url").alias("netloc_path"),
                                  U.clean_path(U.url_path("url")).alias("cleaned_path"))


CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ANSWER_SQL = ("CASE noise WHEN 0 THEN upper(category) WHEN 1 THEN 'it is ' || lower(category) WHEN 2 THEN '' "
              "WHEN 3 THEN title WHEN 4 THEN ' ' || category || ' ' WHEN 5 THEN substr(lower(category), 1, 3) "
              "ELSE 'zzz' END")


def answers(spark, sf):
    a = arts(spark, sf)
    n = F.col("noise")
    ans = (F.when(n == 0, F.upper("category")).when(n == 1, F.concat(F.lit("it is "), F.lower("category")))
            .when(n == 2, F.lit("")).when(n == 3, F.col("title"))
            .when(n == 4, F.concat(F.lit(" "), F.col("category"), F.lit(" ")))
            .when(n == 5, F.substring(F.lower("category"), 1, 3)).otherwise(F.lit("zzz")))
    return a.select("article_id", "category", ans.alias("answer"))


def _map_answer_sql(col: str) -> str:
    c = f"lower(trim({col}))"
    exact = " ".join(f"WHEN {c} = '{k.lower()}' THEN '{k}'" for k in CATEGORIES)
    part = " ".join(f"WHEN contains({c}, '{k.lower()}') OR contains('{k.lower()}', {c}) THEN '{k}'"
                    for k in CATEGORIES)
    return f"coalesce(CASE {exact} END, CASE {part} END)"


ANS = ("ans", f"SELECT article_id, category, {ANSWER_SQL} AS answer FROM articles")


@query("map_answer", with_views(f"SELECT article_id, answer, {_map_answer_sql('answer')} AS prediction FROM ans",
                                ANS))
def q_map_answer(spark, sf):
    return answers(spark, sf).select("article_id", "answer",
                                     TX.map_answer("answer", CATEGORIES).alias("prediction"))


@query("success_rate", with_views(f"""
SELECT count(*) AS submitted, count(p) AS valid, avg(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0.0 END) AS success_rate
FROM (SELECT {_map_answer_sql('answer')} AS p FROM ans)""", ANS))
def q_success_rate(spark, sf):
    a = answers(spark, sf).select(TX.map_answer("answer", CATEGORIES).alias("prediction"))
    return M.success_rate(a)


PROMPT = "Classify the headline into one of: {categories}.\nHeadline: {text}\nCategory:"


@query("prompt_text", with_views(
    "SELECT article_id, replace(replace('" + PROMPT.replace("\n", "' || chr(10) || '") +
    "', '{categories}', '" + ", ".join(CATEGORIES) + "'), '{text}', substr(title, 1, 2500)) AS prompt FROM articles"))
def q_prompt_text(spark, sf):
    return arts(spark, sf).select("article_id", TX.prompt_text(PROMPT, CATEGORIES, "title", 2500).alias("prompt"))


# ----------------------------------------------------------------- metrics ----
from linklens.operators import results as R  # noqa: E402
from linklens.operators import runs as RN  # noqa: E402


def preds(spark, sf):
    return T.predictions(spark, sf)


def pred_sql(body: str, *extra) -> str:
    return with_views(body, *extra, views=("predictions",))


CONF = ("conf", "SELECT label, prediction, count(*) AS n FROM predictions GROUP BY ALL")
CONF_D = ("confd", "SELECT publisher, label, prediction, count(*) AS n FROM predictions GROUP BY ALL")
CONF_DT = ("confdt", "SELECT publisher, label AS topic, label, prediction, count(*) AS n FROM predictions GROUP BY ALL")


def _m(conf, keys, name):
    body = G.macro_ctes(conf, keys, name).strip()
    return body


def pred_chain(body: str, *ctes: str) -> str:
    head = with_views("", CONF, CONF_D, CONF_DT, views=("predictions",)).rstrip()
    return head + "".join(",\n" + c for c in ctes) + "\n" + body


@query("confusion", pred_sql("SELECT * FROM conf", CONF))
def q_confusion(spark, sf):
    return M.confusion(preds(spark, sf))


@query("per_topic_metrics", pred_chain("""
SELECT label, tp, fp, fn, support, precision, recall, f1 FROM mac_lab WHERE support > 0""",
                                       _m("conf", [], "mac")))
def q_per_topic_metrics(spark, sf):
    return M.per_topic_metrics(M.confusion(preds(spark, sf)))


@query("macro_metrics", pred_chain("SELECT * FROM mac", _m("conf", [], "mac")))
def q_macro_metrics(spark, sf):
    return M.macro_metrics(M.confusion(preds(spark, sf)))


@query("micro_metrics", pred_chain("""
SELECT CASE WHEN sum(tp + fp) > 0 THEN CAST(sum(tp) AS DOUBLE) / sum(tp + fp) ELSE 0.0 END AS micro_precision,
       CASE WHEN sum(tp + fn) > 0 THEN CAST(sum(tp) AS DOUBLE) / sum(tp + fn) ELSE 0.0 END AS micro_recall,
       CASE WHEN sum(tp) > 0 THEN 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0.0 END AS micro_f1
FROM mac_ls""", _m("conf", [], "mac")))
def q_micro_metrics(spark, sf):
    return M.micro_metrics(M.confusion(preds(spark, sf)))


DOMAIN_CTES = (_m("confd", ["publisher"], "dm"), _m("confdt", ["publisher", "topic"], "dtm"))
DOMAIN_SEL = ("dmo", "SELECT publisher AS domain, accuracy, precision, recall, f1, n_samples AS support, n_correct FROM dm")
DT_SEL = ("dto", "SELECT publisher AS domain, topic, accuracy, precision, recall, f1, n_samples AS support, "
                 "n_correct FROM dtm")


@query("per_domain_metrics", pred_chain("SELECT * FROM dmo", *DOMAIN_CTES, f"{DOMAIN_SEL[0]} AS ({DOMAIN_SEL[1]})"))
def q_per_domain_metrics(spark, sf):
    return M.per_domain_metrics(preds(spark, sf), "publisher")


@query("per_domain_topic_metrics", pred_chain("SELECT * FROM dto", *DOMAIN_CTES, f"{DT_SEL[0]} AS ({DT_SEL[1]})"))
def q_per_domain_topic_metrics(spark, sf):
    return M.per_domain_topic_metrics(preds(spark, sf), "publisher")


LIFT = ("lift", """
WITH tc AS (SELECT domain, topic, sum(support) AS support FROM dto GROUP BY 1, 2),
g AS (SELECT domain, count(*) AS k, sum(support) AS t, max(support) AS mx,
             sum(support * log2(support)) AS nlogn FROM tc GROUP BY 1)
SELECT dmo.*, CASE WHEN k > 1 THEN (log2(t) - nlogn / t) / log2(k) ELSE 0.0 END AS entropy_norm,
       CAST(mx AS DOUBLE) / t AS baseline_acc, accuracy - CAST(mx AS DOUBLE) / t AS accuracy_lift
FROM dmo JOIN g USING (domain)""")


def lift_frame(spark, sf):
    p = preds(spark, sf)
    return M.domain_lift(M.per_domain_metrics(p, "publisher"), M.per_domain_topic_metrics(p, "publisher"))


LIFT_CHAIN = (*DOMAIN_CTES, f"{DOMAIN_SEL[0]} AS ({DOMAIN_SEL[1]})", f"{DT_SEL[0]} AS ({DT_SEL[1]})",
              f"{LIFT[0]} AS ({LIFT[1]})")


@query("domain_lift", pred_chain("SELECT * FROM lift", *LIFT_CHAIN))
def q_domain_lift(spark, sf):
    return lift_frame(spark, sf)


@query("lift_correlations", pred_chain("""
SELECT corr(log10(support), f1) AS r_log_support_f1, corr(entropy_norm, accuracy_lift) AS r_entropy_lift,
       avg(CASE WHEN accuracy_lift > 0.05 THEN 1.0 ELSE 0.0 END) AS share_lift_gt_5pp,
       avg(CASE WHEN accuracy_lift < -0.05 THEN 1.0 ELSE 0.0 END) AS share_lift_lt_neg_5pp FROM lift""",
                                       *LIFT_CHAIN))
def q_lift_correlations(spark, sf):
    return M.lift_summary(lift_frame(spark, sf))


@query("class_weights", with_views(f"""
, c AS (SELECT category, count(*) AS n FROM articles WHERE {SPLIT} = 'train' GROUP BY 1)
SELECT category, n, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * CAST(n AS DOUBLE)) AS weight FROM c
""".replace("\n, c AS", ", c AS", 1)))
def q_class_weights(spark, sf):
    from linklens.operators import models as MD
    tr = SP.assign_split(arts(spark, sf).select("article_id", "category")).where(F.col("split") == "train")
    return MD.class_weights(tr, "category")


# ------------------------------------------------------------ result tables ---

def bayes_runs_sql(k: int, alpha: str) -> str:
    """Naive Bayes predictions of every stacked run with one smoothing."""
    return f"""bp{k} AS (SELECT article_id, feature, condition, arg_min(label, (-score, label)) AS p{k} FROM (
  SELECT t.article_id, t.feature, t.condition, c.label, ln(CAST(c.d AS DOUBLE) / c.a) + coalesce(s.s, 0) AS score
  FROM rtest t JOIN rcls c USING (dataset, feature, condition) LEFT JOIN (
    SELECT w.article_id, w.feature, w.condition, c.label,
           sum(w.tf * ln((coalesce(ct.n, 0) + {alpha}) / (c.t + {alpha} * c.v))) AS s
    FROM rtok w JOIN rvoc USING (dataset, feature, condition, term) JOIN rcls c USING (dataset, feature, condition)
    LEFT JOIN rct ct ON ct.dataset = w.dataset AND ct.feature = w.feature AND ct.condition = w.condition
      AND ct.label = c.label AND ct.term = w.term
    WHERE w.split = 'test' GROUP BY ALL) s
  ON s.article_id = t.article_id AND s.feature = t.feature AND s.condition = t.condition AND s.label = c.label) GROUP BY ALL)"""


_TEXTS = {"title": "title", "url_raw": "url", "url_path_raw": S.path("url")}
RUN_KEYS = ["dataset", "model", "feature", "condition"]
RUNS_CHAIN = (
    "m AS (" + MAP_CTE[1] + ")",
    "lm AS (SELECT slug_rank, lower(slug) AS s, category FROM m)",
    "ra AS (SELECT article_id, language AS dataset, category AS label, url, title, " + SPLIT + " AS split FROM articles)",
    "rt AS (" + " UNION ALL ".join(
        f"SELECT article_id, dataset, '{f}' AS feature, '{c}' AS condition, label, split, "
        f"{t if c == 'with_dates' else S.strip_dates(t)} AS text FROM ra" for f, t in _TEXTS.items()
        for c in ("with_dates", "no_dates")) + ")",
    "rtest AS (SELECT * FROM rt WHERE split = 'test' AND label IS NOT NULL)",
    f"rtok AS (SELECT article_id, dataset, feature, condition, label, split, term, count(*) AS tf FROM (SELECT *, "
    f"unnest(regexp_extract_all(lower(text), '{G.TOKEN_SQL}')) AS term FROM rt) GROUP BY ALL)",
    "rct AS (SELECT dataset, feature, condition, label, term, sum(tf) AS n FROM rtok WHERE split = 'train' GROUP BY ALL)",
    "rvoc AS (SELECT DISTINCT dataset, feature, condition, term FROM rct)",
    "rcls AS (SELECT d.*, coalesce(t, 0) AS t, coalesce(v, 0) AS v, sum(d) OVER (PARTITION BY dataset, feature, condition) AS a "
    "FROM (SELECT dataset, feature, condition, label, count(*) AS d FROM rt WHERE split = 'train' GROUP BY ALL) d "
    "LEFT JOIN (SELECT dataset, feature, condition, label, sum(n) AS t FROM rct GROUP BY ALL) USING (dataset, feature, condition, label) "
    "LEFT JOIN (SELECT dataset, feature, condition, count(*) AS v FROM rvoc GROUP BY ALL) USING (dataset, feature, condition))",
    bayes_runs_sql(0, "1.0"), bayes_runs_sql(1, "0.1"),
    "rmaj AS (SELECT dataset, feature, condition, arg_min(label, (-d, label)) AS maj FROM rcls GROUP BY ALL)",
    f"rmap AS (SELECT article_id, feature, condition, arg_min(category, slug_rank) AS mapped FROM "
    f"(SELECT *, lower(text) AS t FROM rtest) JOIN lm ON {J7_ON} GROUP BY ALL)",
    "rp AS (SELECT t.dataset, t.feature, t.condition, t.label, unnest([{'model': 'naive-bayes', 'prediction': p0}, "
    "{'model': 'naive-bayes-0.1', 'prediction': p1}, {'model': 'mapping', 'prediction': mapped}, "
    "{'model': 'two-stage', 'prediction': coalesce(mapped, p0)}, {'model': 'majority', 'prediction': maj}], recursive := true) "
    "FROM rtest t LEFT JOIN bp0 USING (article_id, feature, condition) LEFT JOIN bp1 USING (article_id, feature, condition) "
    "LEFT JOIN rmap USING (article_id, feature, condition) LEFT JOIN rmaj USING (dataset, feature, condition))",
    "rall AS (SELECT dataset, model, feature, condition, label, prediction, count(*) AS n FROM rp GROUP BY ALL)",
    "rconf AS (SELECT * FROM rall WHERE prediction IS NOT NULL)",
    G.macro_ctes("rconf", RUN_KEYS, "rmac").strip(),
    "rok AS (SELECT dataset, model, feature, condition, CAST(sum(CASE WHEN prediction IS NOT NULL THEN n ELSE 0 END) "
    "AS DOUBLE) / sum(n) AS success_rate FROM rall GROUP BY ALL)",
    "runs AS (SELECT dataset, model, feature, condition, round(accuracy, 9) AS accuracy, "
    "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, n_samples, success_rate "
    "FROM rmac JOIN rok USING (dataset, model, feature, condition))",
)


def runs_sql(body: str, *more: str) -> str:
    head = with_views("", views=("articles", "slug_map")).rstrip()
    return head + "".join(",\n" + c for c in RUNS_CHAIN + more) + "\n" + body


_RUN_STORE: dict[tuple, str] = {}


def _stored(spark, sf, kind, make):
    """A table of the evaluation: written once per application and input, as an evaluation
    does, and read by every summary below."""
    key = spark.sparkContext.applicationId, sf, kind
    if key not in _RUN_STORE or not table_exists(spark, _RUN_STORE[key]):
        a = SP.assign_split(arts(spark, sf).select("article_id", "url", "title", "category", "language"))
        _RUN_STORE[key] = table_path(make(a, smap(spark)))
    return spark.read.parquet(_RUN_STORE[key])


_RUN_MODELS: dict[tuple, RN.RunModels] = {}


def _run_models(spark, sf, articles):
    """The fitted runs: once per application and input as well."""
    key = spark.sparkContext.applicationId, sf
    if key not in _RUN_MODELS or not table_exists(spark, _RUN_MODELS[key].path):
        _RUN_MODELS[key] = RN.run_models(RN.labelled(articles, "train"))
    return _RUN_MODELS[key]


def run_cells(spark, sf):
    return _stored(spark, sf, "cells", lambda a, m: RN.run_confusion(a, m, _run_models(spark, sf, a)))


def runs(spark, sf):
    return RN.evaluation_runs(run_cells(spark, sf))


def measured_runs(spark, sf):
    """The runs with the throughput that scoring their models took here."""
    speed = _stored(spark, sf, "speed", lambda a, m: materialize(RN.measured_throughput(a, m, _run_models(spark, sf, a))))
    return runs(spark, sf).join(F.broadcast(speed.select("dataset", "model", "throughput")), ["dataset", "model"])


@query("evaluation_runs", runs_sql("SELECT * FROM runs"))
def q_evaluation_runs(spark, sf):
    return runs(spark, sf)


@query("topn_per_group", runs_sql("""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, model, feature, condition) AS rank
               FROM runs) WHERE rank <= 5"""))
def q_topn_per_group(spark, sf):
    return R.topn_per_group(runs(spark, sf), "dataset", "f1", 5).withColumn("rank", F.col("rank").cast("long"))


@query("best_per_group", runs_sql("""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY f1 DESC, feature, condition) AS rank
               FROM runs) WHERE rank = 1"""))
def q_best_per_group(spark, sf):
    return R.topn_per_group(runs(spark, sf), ["model", "dataset"], "f1", 1).withColumn(
        "rank", F.col("rank").cast("long"))


@query("top_results", runs_sql("SELECT * FROM runs ORDER BY f1 DESC, dataset, model, feature, condition LIMIT 10"))
def q_top_results(spark, sf):
    return R.top_k(runs(spark, sf), "f1", 10, tiebreak=("dataset", "model", "feature", "condition"))


@query("filtered_results", runs_sql("""
SELECT * FROM runs WHERE model NOT IN ('naive-bayes-0.1') AND f1 IS NOT NULL
AND contains(lower(model), 'naive')"""))
def q_filtered_results(spark, sf):
    r = FL.drop_missing(FL.exclude_values(runs(spark, sf), "model", ["naive-bayes-0.1"]), "f1")
    return FL.name_contains(r, "model", "NAIVE")


ABL = ("abl", """
SELECT dataset, model, feature, max(f1) FILTER (WHERE condition = 'with_dates') AS f1_with_dates,
       max(f1) FILTER (WHERE condition = 'no_dates') AS f1_no_dates,
       max(f1) FILTER (WHERE condition = 'no_dates') - max(f1) FILTER (WHERE condition = 'with_dates') AS delta_f1,
       CASE WHEN max(f1) FILTER (WHERE condition = 'with_dates') > 0 THEN
         (max(f1) FILTER (WHERE condition = 'no_dates') - max(f1) FILTER (WHERE condition = 'with_dates'))
         / max(f1) FILTER (WHERE condition = 'with_dates') * 100 ELSE 0.0 END AS pct_change
FROM runs GROUP BY 1, 2, 3
HAVING count(*) = 2 AND count(*) FILTER (WHERE condition = 'with_dates') > 0
   AND count(*) FILTER (WHERE condition = 'no_dates') > 0""")


def ablation(spark, sf):
    return M.ablation_compare(runs(spark, sf))


@query("ablation_compare", runs_sql("SELECT * FROM abl", f"abl AS ({ABL[1]})"))
def q_ablation_compare(spark, sf):
    return ablation(spark, sf)


@query("ablation_summary", runs_sql("""
SELECT avg(delta_f1) AS mean_delta, stddev_samp(delta_f1) AS std_delta, max(delta_f1) AS max_delta,
       min(delta_f1) AS min_delta, count(*) FILTER (WHERE delta_f1 > 0) AS improved,
       count(*) FILTER (WHERE delta_f1 < 0) AS degraded, count(*) FILTER (WHERE delta_f1 = 0) AS unchanged,
       count(*) AS n FROM abl""", f"abl AS ({ABL[1]})"))
def q_ablation_summary(spark, sf):
    return M.ablation_summary(ablation(spark, sf))


@query("ablation_extremes", runs_sql("""
SELECT * FROM (SELECT 'smallest' AS side, * FROM abl ORDER BY delta_f1, dataset, model, feature LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'largest' AS side, * FROM abl ORDER BY delta_f1 DESC, dataset, model, feature LIMIT 5)""",
                                     f"abl AS ({ABL[1]})"))
def q_ablation_extremes(spark, sf):
    a = ablation(spark, sf)
    tb = ("dataset", "model", "feature")
    lo = R.top_k(a, "delta_f1", 5, ascending=True, tiebreak=tb).select(F.lit("smallest").alias("side"), "*")
    hi = R.top_k(a, "delta_f1", 5, tiebreak=tb).select(F.lit("largest").alias("side"), "*")
    return lo.unionByName(hi)


@query("f1_pivot", runs_sql("""
SELECT dataset, model, avg(f1) FILTER (WHERE feature = 'title') AS title,
       avg(f1) FILTER (WHERE feature = 'url_raw') AS url_raw,
       avg(f1) FILTER (WHERE feature = 'url_path_raw') AS url_path_raw FROM runs GROUP BY 1, 2"""))
def q_f1_pivot(spark, sf):
    return R.f1_pivot(runs(spark, sf))


@query("model_summary", runs_sql("""
SELECT model, avg(accuracy) AS accuracy_mean, avg(precision) AS precision_mean, avg(recall) AS recall_mean,
       avg(f1) AS f1_mean, stddev_samp(f1) AS f1_std, quantile_cont(f1, 0.5) AS f1_median
       FROM runs GROUP BY 1"""))
def q_model_summary(spark, sf):
    return R.model_summary(runs(spark, sf))


@query("feature_summary", runs_sql("""
SELECT feature, avg(f1) AS f1_mean, stddev_samp(f1) AS f1_std FROM runs GROUP BY 1"""))
def q_feature_summary(spark, sf):
    return R.feature_summary(runs(spark, sf))


@query("throughput_pivot")
def q_throughput_pivot(spark, sf):
    """R4, over throughput by the clock; no SQL gives it."""
    return R.throughput_pivot(measured_runs(spark, sf))


@query("success_pivot", runs_sql("""
SELECT feature, avg(success_rate) FILTER (WHERE dataset = 'en') AS en,
       avg(success_rate) FILTER (WHERE dataset = 'es') AS es,
       avg(success_rate) FILTER (WHERE dataset = 'pt') AS pt FROM runs GROUP BY 1"""))
def q_success_pivot(spark, sf):
    return R.success_pivot(runs(spark, sf))


@query("model_group_means", runs_sql("""
SELECT count(*) AS n_runs, avg(success_rate) AS success_rate_mean, avg(f1) AS f1_mean FROM runs WHERE contains(model, 'mapping')
OR contains(model, 'two-stage')"""))
def q_model_group_means(spark, sf):
    """R7's overall means, of the runs that may leave rows without a prediction."""
    r = runs(spark, sf)
    return R.overall_means(FL.name_contains(r, "model", "mapping").unionByName(FL.name_contains(r, "model", "two-stage")))


@query("mean_f1_by_dataset_model", runs_sql("SELECT dataset, model, avg(f1) AS f1_mean FROM runs GROUP BY 1, 2"))
def q_mean_f1_by(spark, sf):
    return R.mean_f1_by(runs(spark, sf))


@query("top_domains", with_views("""
SELECT * FROM (SELECT 'publisher' AS kind, publisher AS "key", count(*) AS n FROM articles GROUP BY 2
               ORDER BY n DESC, "key" LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'category' AS kind, category AS "key", count(*) AS n FROM articles GROUP BY 2
               ORDER BY n DESC, "key" LIMIT 10)"""))
def q_top_domains(spark, sf):
    a = arts(spark, sf)
    p = R.top_k(D.domain_counts(a, "publisher"), "n", 10, tiebreak=("publisher",))
    c = R.top_k(D.domain_counts(a, "category"), "n", 10, tiebreak=("category",))
    return (p.select(F.lit("publisher").alias("kind"), F.col("publisher").alias("key"), "n")
             .unionByName(c.select(F.lit("category").alias("kind"), F.col("category").alias("key"), "n")))


@query("most_skewed_domains", with_views(", " + G.per_domain_ctes("articles", "publisher", "category", []) + """
SELECT domain AS publisher, dominant_category, dominant_category_share, total_records FROM pd
ORDER BY dominant_category_share DESC, publisher LIMIT 10"""))
def q_most_skewed_domains(spark, sf):
    pd_ = D.category_per_domain(arts(spark, sf), "publisher", "category")
    return R.top_k(pd_, "dominant_category_share", 10, tiebreak=("publisher",)).select(
        "publisher", "dominant_category", "dominant_category_share", "total_records")


_SECTIONS = {
    "categories": ("cs", ["n_categories", "n_records", "balance_ratio", "entropy", "gini_impurity"]),
    "domain_skew": ("skew", ["n_domains", "total_records", "skewness", "kurtosis", "gini_coefficient",
                             "top_1_domain_share", "top_5pct_domains_share", "top_10pct_domains_share",
                             "herfindahl_hirschman_index", "effective_number_domains",
                             "domains_with_single_record", "domains_with_lt_10_records",
                             "domains_with_gt_100_records"]),
    "category_per_domain": ("pd_sum", ["avg_entropy_per_domain", "std_entropy_per_domain",
                                       "avg_dominant_category_share", "std_dominant_category_share",
                                       "single_category_domains", "single_category_domains_share",
                                       "records_in_single_category_domains",
                                       "records_in_single_category_domains_share"]),
    "domain_distribution": ("dd", ["n_domains", "mean", "median", "std", "min", "max", "q25", "q75"]),
    "text_length": ("tl", ["mean", "median", "std", "min", "max", "q25", "q75"]),
    "chi_square": ("chi", ["chi2_statistic", "degrees_of_freedom", "cramers_v"]),
}
_REPORT_SQL = f""",
tl AS (SELECT language, avg(length(title)) AS mean, quantile_cont(length(title), 0.5) AS median, stddev_samp(length(title)) AS std,
       min(length(title)) AS min, max(length(title)) AS max, quantile_cont(length(title), 0.25) AS q25,
       quantile_cont(length(title), 0.75) AS q75 FROM articles GROUP BY 1),
xc AS (SELECT language, publisher, category, count(*) AS o FROM articles WHERE publisher IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
xe AS (SELECT r.language, CAST(r.r AS DOUBLE) * c.c / sum(coalesce(o, 0)) OVER (PARTITION BY r.language) AS e, coalesce(o, 0) AS o,
       count(*) OVER (PARTITION BY r.language) AS cells, count(*) OVER (PARTITION BY r.language, r.publisher) AS nc,
       count(*) OVER (PARTITION BY r.language, c.category) AS nr
       FROM (SELECT language, publisher, sum(o) AS r FROM xc GROUP BY ALL) r
       JOIN (SELECT language, category, sum(o) AS c FROM xc GROUP BY ALL) c USING (language)
       LEFT JOIN xc ON xc.language = r.language AND xc.publisher = r.publisher AND xc.category = c.category),
chi AS (SELECT *, sqrt(chi2_statistic / (total * (least(nr, nc) - 1))) AS cramers_v FROM (
        SELECT language, any_value((nr - 1) * (nc - 1)) AS degrees_of_freedom, sum(o) AS total, any_value(nr) AS nr, any_value(nc) AS nc,
               sum(CASE WHEN (nr - 1) * (nc - 1) = 1 THEN power(greatest(abs(o - e) - 0.5, 0), 2) / e ELSE power(o - e, 2) / e END) AS chi2_statistic
        FROM xe GROUP BY 1)),
tops AS (SELECT language AS dataset, 'top_domains' AS section, publisher AS metric, CAST(n AS DOUBLE) / t AS value FROM (
         SELECT language, publisher, count(*) AS n, row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, publisher) AS rk,
                any_value(t) AS t FROM articles JOIN (SELECT language, count(*) AS t FROM articles GROUP BY 1) USING (language)
         WHERE publisher IS NOT NULL GROUP BY 1, 2) WHERE rk <= 10),
types AS (SELECT language AS dataset, 'url_types' AS section, url_type AS metric, CAST(count(*) AS DOUBLE) / any_value(t) AS value
          FROM (SELECT language, {S.structure(S.path('url'))['url_type']} AS url_type FROM articles)
          JOIN (SELECT language, count(*) AS t FROM articles GROUP BY 1) USING (language) GROUP BY 1, 3)"""


@query("stats_report", with_views(
    ", " + _ctes(G.catsum_ctes("articles", "category", ["language"]),
                 G.skew_ctes("articles", "publisher", ["language"]),
                 G.per_domain_ctes("articles", "publisher", "category", ["language"]),
                 G.domdist_ctes("articles", "publisher", ["language"])) + _REPORT_SQL + "\n" +
    "\nUNION ALL\n".join(f"SELECT language AS dataset, '{sec}' AS section, '{c}' AS metric, "
                         f"CAST({c} AS DOUBLE) AS value FROM {cte}"
                         for sec, (cte, cols) in _SECTIONS.items() for c in cols) + """
UNION ALL SELECT * FROM tops UNION ALL SELECT * FROM types"""))
def q_stats_report(spark, sf):
    return R.stats_report(arts(spark, sf).withColumnRenamed("language", "dataset"))


# -------------------------------------------------- text features / NB --------
from linklens.operators import textfeatures as TF  # noqa: E402


def docs(spark, sf):
    return T.read_table(spark, sf, "documents").select("doc_id", "text")


@query("tfidf_terms", f"""
WITH {G.tf_cte('documents', 'doc_id', 'text', 'tf')},
n AS (SELECT count(*) AS n FROM documents),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
vocab AS (SELECT term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM st, n
          WHERE df >= 2 AND df <= 0.95 * n ORDER BY cf DESC, term LIMIT 5000),
w AS (SELECT doc_id, term, tf, tf * idf AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w""")
def q_tfidf_terms(spark, sf):
    return TF.tfidf(docs(spark, sf), "doc_id", "text", 5000, 2, 0.95)


@query("term_counts", f"""
WITH {G.tf_cte('documents', 'doc_id', 'text', 'tf')}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term""")
def q_term_counts(spark, sf):
    return TF.term_counts(docs(spark, sf))


DOC_BUCKET = "('0x' || substr(md5('20240823|' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100"
NB_SPLIT = f"""
lab AS (SELECT d.doc_id, d.text, l.quality AS label, {DOC_BUCKET} < 80 AS is_train
        FROM documents d JOIN labels l USING (doc_id)),
tr AS (SELECT doc_id, text, label FROM lab WHERE is_train),
te AS (SELECT doc_id, text, label FROM lab WHERE NOT is_train)"""


def labelled_docs(spark, sf):
    d = T.read_table(spark, sf, "documents").select("doc_id", "text")
    lab = T.read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return SP.assign_split(d.join(lab, "doc_id"), key="doc_id")


def nb_model(spark, sf):
    ld = labelled_docs(spark, sf)
    return TF.nb_fit(ld.where(F.col("split") == "train"), "doc_id", "text", "label"), ld


@query("nb_term_logprob", f"WITH {NB_SPLIT},\n{G.nb_ctes('tr', 'te')}\nSELECT label, term, count, log_prob FROM nb_tlp")
def q_nb_term_logprob(spark, sf):
    (tlp, _), _ = nb_model(spark, sf)
    return tlp


@query("nb_classes", f"WITH {NB_SPLIT},\n{G.nb_ctes('tr', 'te')}\n"
                     "SELECT label, n_docs, log_prior, total, vocab_size, ln(1.0 / den) AS unseen_log_prob FROM nb_cls")
def q_nb_classes(spark, sf):
    (_, cls), _ = nb_model(spark, sf)
    return cls


@query("nb_predict", f"WITH {NB_SPLIT},\n{G.nb_ctes('tr', 'te')}\n"
                     "SELECT te.doc_id, te.label, nb_pred.prediction FROM te JOIN nb_pred USING (doc_id)")
def q_nb_predict(spark, sf):
    (tlp, cls), ld = nb_model(spark, sf)
    te = ld.where(F.col("split") != "train").select("doc_id", "label", "text")
    return TF.nb_score(te, TF.nb_tables_model(tlp, cls), "text").drop("text")


TWO_STAGE = [
    ("sa", f"SELECT article_id, url, category, {SPLIT} AS split FROM articles"),
    ("trn", "SELECT article_id, url, category FROM sa WHERE split = 'train'"),
    ("tst", "SELECT article_id, url, category FROM sa WHERE split = 'test'"),
    ("wtrn", weak_sql("trn")), ("gtrn", gate_sql("trn")),
    ("weak_ok", "SELECT (SELECT ok FROM gtrn) AND (SELECT count(url_category) > 0 FROM wtrn) AS use"),
    ("wt", "SELECT article_id AS doc_id, url AS text, url_category AS label FROM wtrn, weak_ok "
           "WHERE use AND url_category IS NOT NULL UNION ALL "
           "SELECT article_id, url, category FROM trn, weak_ok WHERE NOT use AND category IS NOT NULL"),
    ("lm", "SELECT slug_rank, lower(slug) AS s, category FROM m"),
    ("j7", f"SELECT article_id, arg_min(category, slug_rank) AS mapped FROM (SELECT article_id, lower(url) AS t FROM tst) "
           f"JOIN lm ON {J7_ON} GROUP BY 1"),
    ("s1", "SELECT tst.article_id, tst.url, tst.category, CASE WHEN j7.mapped IN (SELECT DISTINCT label FROM wt) "
           "THEN j7.mapped END AS p1 FROM tst LEFT JOIN j7 USING (article_id)"),
    ("rest", "SELECT article_id AS doc_id, url AS text FROM s1 WHERE p1 IS NULL"),
]
TWO_STAGE_SQL = ",\n" + G.tfidf_nb_ctes("wt", "rest", 10000)


def two_stage_run(spark, sf):
    """M11 on the training split and M9 on the test split."""
    a = SP.assign_split(arts(spark, sf).select("article_id", "url", "category"))
    model = TF.weak_label_model(a.where(F.col("split") == "train"), smap(spark))
    return TF.two_stage_predict(a.where(F.col("split") == "test"), model, smap(spark)), model


@query("two_stage_predict", slug_sql(TWO_STAGE_SQL + """
SELECT s1.article_id, s1.category AS label, coalesce(p1, tn_pred.prediction) AS prediction,
       CASE WHEN p1 IS NOT NULL THEN 'mapping' ELSE 'classifier' END AS source
FROM s1 LEFT JOIN tn_pred ON tn_pred.doc_id = s1.article_id""", *TWO_STAGE))
def q_two_stage_predict(spark, sf):
    return two_stage_run(spark, sf)[0]


@query("two_stage_metrics", slug_sql(TWO_STAGE_SQL + """,
res AS (SELECT s1.category AS label, coalesce(p1, tn_pred.prediction) AS prediction
        FROM s1 LEFT JOIN tn_pred ON tn_pred.doc_id = s1.article_id
        WHERE s1.category IN (SELECT label FROM wt)),
conf AS (SELECT label, prediction, count(*) AS n FROM res GROUP BY ALL),
""" + G.macro_ctes("conf", [], "mac").strip() + "\nSELECT * FROM mac", *TWO_STAGE))
def q_two_stage_metrics(spark, sf):
    """M9's metrics over the test rows whose label was trained."""
    pred, model = two_stage_run(spark, sf)
    return M.macro_metrics(M.confusion(TF.two_stage_evaluation(pred, model)))


def weak_model_sql(mapping: str) -> str:
    """M11 on titles, with the weak labels of a part of the mapping."""
    named = [(n, q.replace("article_id, url, category", "article_id, url, title, category") if n in ("sa", "trn", "tst") else q)
             for n, q in TWO_STAGE if n in ("sa", "trn", "tst", "wtrn", "gtrn", "weak_ok")]
    named.append(("wt", "SELECT w.article_id AS doc_id, title AS text, url_category AS label FROM wtrn w JOIN trn USING (article_id), "
                        "weak_ok WHERE use AND url_category IS NOT NULL UNION ALL "
                        "SELECT article_id, title, category FROM trn, weak_ok WHERE NOT use AND category IS NOT NULL"))
    named.append(("te", "SELECT article_id AS doc_id, title AS text, category FROM tst"))
    part = ("m", MAP_CTE[1] + f" AND {mapping}")
    return with_views(",\n" + G.tfidf_nb_ctes("wt", "te", 10000) + """
SELECT te.doc_id AS article_id, te.category AS label, tn_pred.prediction,
       CASE WHEN use THEN 'url' ELSE 'true' END AS label_source
FROM te JOIN tn_pred USING (doc_id), weak_ok""", part, *named, views=("articles", "slug_map"))


def weak_model_run(spark, sf, mapping):
    a = SP.assign_split(arts(spark, sf).select("article_id", "url", "title", "category"))
    rows = TF.weak_or_true_labels(a.where(F.col("split") == "train"), mapping)
    rows = materialize(rows.select("title", "label", "label_source"))
    model = TF.nb_train(rows, "title", "label", tfidf=True, max_features=10000)
    te = a.where(F.col("split") == "test").select("article_id", F.col("category").alias("label"), "title")
    source = rows.agg(F.first("label_source").alias("label_source"))
    return TF.nb_score(te, model, "title").drop("title").crossJoin(F.broadcast(source))


@query("weak_model_predict", weak_model_sql("true"))
def q_weak_model_predict(spark, sf):
    """M11 where the URL check passes: trained on mapped labels."""
    return weak_model_run(spark, sf, smap(spark))


@query("weak_model_fallback", weak_model_sql("slug = 'politics'"))
def q_weak_model_fallback(spark, sf):
    """M11 where a short mapping fails the URL check: trained on true labels."""
    return weak_model_run(spark, sf, smap(spark).where("slug = 'politics'"))


# ------------------------------------------------ Spark ML (rows-only checks) ---
from linklens.operators import models as MD  # noqa: E402


def _doc_model_run(spark, sf, model, **kw):
    ld = labelled_docs(spark, sf).withColumn("label", F.col("label").cast("string"))
    tr, te = ld.where(F.col("split") == "train"), ld.where(F.col("split") != "train")
    m = MD.train_model(tr, model, "text", "label", **kw)
    return MD.predict(m, te, ("doc_id", "label"))


@query("predict_logreg")
def q_predict_logreg(spark, sf):
    return _doc_model_run(spark, sf, "log-reg")


@query("predict_svm")
def q_predict_svm(spark, sf):
    return _doc_model_run(spark, sf, "svm", balanced=True)


@query("predict_forest")
def q_predict_forest(spark, sf):
    return _doc_model_run(spark, sf, "forest")


@query("predict_gbt")
def q_predict_gbt(spark, sf):
    return _doc_model_run(spark, sf, "gbt")


@query("predict_nb_ml")
def q_predict_nb_ml(spark, sf):
    return _doc_model_run(spark, sf, "naive-bayes", vectorizer={"max_features": None, "min_df": 1.0,
                                                                "max_df": 1.0, "idf": False})


@query("predict_gbt_embeddings")
def q_predict_gbt_embeddings(spark, sf):
    e = T.read_table(spark, sf, "embeddings")
    e = MD.embedding_features(SP.assign_split(e, key="vec_id")).withColumn("label", F.col("label").cast("string"))
    tr, te = e.where(F.col("split") == "train"), e.where(F.col("split") != "train")
    m = MD.train_model(tr, "gbt", None, "label", features="features",
                       params={"maxDepth": 6})
    return MD.predict(m, te, ("vec_id", "label"))


def _url_runs(spark, sf, variants: dict, model="log-reg"):
    """Train and score one model per feature column; macro metrics per run."""
    # one written copy of the split article table feeds every run
    # the reference's threshold, which drops no category of the view
    a = materialize(SP.assign_split(L.load_articles(arts(spark, sf), "articles", min_share=0.02))
                    .select("article_id", "category", "netloc", "path", "path_clean", "split"))
    def job(name, col):
        def run():
            d = a.select("article_id", "category", col.alias("text"), "split")
            tr, te = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
            m = MD.train_model(tr, model, "text", "category")
            p = MD.predict(m, te, ("article_id", "category")).withColumnRenamed("category", "label")
            return materialize(M.macro_metrics(M.confusion(p)).withColumn("run", F.lit(name)))
        return run
    done = MD.fit_many({name: job(name, col) for name, col in variants.items()})
    out = None
    for name in variants:
        out = done[name] if out is None else out.unionByName(done[name])
    return out


@query("date_ablation_run")
def q_date_ablation_run(spark, sf):
    """URL path feature with and without dates, same split."""
    r = _url_runs(spark, sf, {"with_dates": U.clean_path(F.col("path")),
                              "no_dates": U.clean_path(U.strip_dates(F.col("path")))})
    r = r.withColumnRenamed("run", "condition").withColumn("dataset", F.lit("articles")) \
         .withColumn("model", F.lit("log-reg")).withColumn("feature", F.lit("url_path_cleaned"))
    return M.ablation_compare(r)


@query("variant_run")
def q_variant_run(spark, sf):
    """One model per URL variant."""
    return _url_runs(spark, sf, {"path": F.col("path"), "netloc_path": F.concat("netloc", "path"),
                                 "cleaned_path": F.col("path_clean")})


@query("learning_curve")
def q_learning_curve(spark, sf):
    """Fixed-size training subsets (reference rule), same test set."""
    ld = labelled_docs(spark, sf).withColumn("label", F.col("label").cast("string"))
    tr, te = ld.where(F.col("split") == "train"), ld.where(F.col("split") != "train")

    def job(size):
        def run():
            sub = tr if size is None else SP.stratified_subset(tr, size, "label", "doc_id", 42)
            m = MD.train_model(sub, "log-reg", "text", "label")
            return materialize(M.macro_metrics(M.confusion(MD.predict(m, te))).withColumn(
                "train_size", F.lit(size if size else -1)).withColumn("n_train", F.lit(sub.count())))
        return run
    sizes = (1000, 3000, None)
    done = MD.fit_many({str(s_): job(s_) for s_ in sizes})
    out = None
    for s_ in sizes:
        out = done[str(s_)] if out is None else out.unionByName(done[str(s_)])
    return out


def keyword_scorer_factory():
    """A stand-in batch scorer: answers with the category named in the text."""
    cats = [c.lower() for c in CATEGORIES]

    def score(texts):
        out = []
        for t in texts:
            low = (t or "").lower()
            hit = next((c.upper() for c in cats if c in low), None)
            out.append(hit)
        return out
    return score


@query("batch_score", with_views("SELECT article_id, category, CASE " + " ".join(
    f"WHEN contains(lower(coalesce(answer, '')), '{c.lower()}') THEN '{c}'" for c in CATEGORIES)
    + " END AS prediction FROM ans", ANS))
def q_batch_score(spark, sf):
    """Caller-supplied scorer over Arrow batches, then E9 success rate."""
    a = answers(spark, sf).withColumnRenamed("answer", "text")
    scored = MD.batch_score(a, keyword_scorer_factory, "text", ("article_id", "category"))
    return scored


# ------------------------------------------------------ remaining inventory ----

@query("basic_stats", with_views("""
SELECT count(*) AS n_records, CAST(8 AS BIGINT) AS n_features,
       'article_id,url,title,subtitle,category,publisher,language,noise' AS column_names FROM articles"""))
def q_basic_stats(spark, sf):
    return D.basic_stats(arts(spark, sf).select(*ARTICLE_COLS))


@query("label_codes", with_views("""
SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT category FROM articles WHERE category IS NOT NULL)"""))
def q_label_codes(spark, sf):
    return D.label_codes(arts(spark, sf), "category")


TOPIC_RUNS = (
    "tconf AS (SELECT model, feature, condition, label, prediction, sum(n) AS n FROM rconf GROUP BY ALL)",
    G.macro_ctes("tconf", ["model", "feature", "condition"], "tmac").strip(),
    "truns AS (SELECT model, feature, condition, label AS topic, round(f1, 9) AS f1, support "
    "FROM tmac_lab WHERE support > 0)",
)


@query("best_per_topic", runs_sql("""
SELECT model, feature, condition, topic, f1, support FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY f1 DESC, model, feature, condition) AS rk FROM truns)
WHERE rk = 1""", *TOPIC_RUNS))
def q_best_per_topic(spark, sf):
    return R.best_per_topic(RN.evaluation_topic_runs(run_cells(spark, sf)))


@query("url_type_extremes", struct_sql("""
SELECT * FROM (SELECT 'most_common' AS kind, url_type, CAST(count(*) AS DOUBLE) AS value FROM struct
               GROUP BY url_type ORDER BY count(*) DESC, url_type LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'best_mean_f1' AS kind, dominant_url_type AS url_type, avg(f1) AS value FROM combined
               GROUP BY 2 ORDER BY avg(f1) DESC, dominant_url_type LIMIT 1)""", combined=True))
def q_url_type_extremes(spark, sf):
    return R.url_type_extremes(structure_frame(spark, sf), combined_frame(spark, sf))


_CM = ["accuracy", "f1", "path_length_mean", "num_segments_mean", "is_semantic_mean", "is_id_heavy_mean"]


@query("structure_correlation_matrix", struct_sql("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM combined" for a in _CM for b in _CM),
    combined=True))
def q_structure_correlation_matrix(spark, sf):
    return ST.correlation_matrix(combined_frame(spark, sf), _CM)


SECTION_NB = [
    ("sa", f"SELECT article_id, url, title, category, {SPLIT} AS split FROM articles"),
    ("str", f"SELECT a.article_id AS doc_id, a.title AS text, m.category AS label FROM sa a "
            f"JOIN m ON {S.first_section('a.url')} = m.slug WHERE a.split = 'train'"),
    ("ste", "SELECT article_id AS doc_id, title AS text, category AS label FROM sa WHERE split = 'test'"),
]


SECTION_NB_TRUE = [(n, f"SELECT article_id AS doc_id, title AS text, category AS label FROM sa WHERE split = 'train'"
                    if n == "str" else q) for n, q in SECTION_NB]
SECTION_NB_OUT = """
SELECT ste.doc_id AS article_id, ste.label, nb_pred.prediction FROM ste JOIN nb_pred USING (doc_id)"""


def section_nb_run(spark, sf, mapping):
    a = SP.assign_split(arts(spark, sf).select("article_id", "url", "title", "category"))
    pairs = TF.section_training_rows(a.where(F.col("split") == "train"), mapping, "url", "title")
    model = TF.nb_train(pairs, "x", "y")
    te = a.where(F.col("split") == "test").select("article_id", F.col("category").alias("label"), "title")
    return TF.nb_score(te, model, "title", doc="article_id").drop("title")


@query("section_nb_predict", slug_sql(",\n" + G.nb_ctes("str", "ste") + SECTION_NB_OUT, *SECTION_NB))
def q_section_nb_predict(spark, sf):
    """Section-join weak labels on the training split train a naive
    Bayes text classifier that scores the test split."""
    return section_nb_run(spark, sf, smap(spark))


@query("section_nb_unmapped", slug_sql(",\n" + G.nb_ctes("str", "ste") + SECTION_NB_OUT, *SECTION_NB_TRUE))
def q_section_nb_unmapped(spark, sf):
    """M12 without a mapping: true labels train it."""
    return section_nb_run(spark, sf, None)


@query("accuracy", pred_sql("""
SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM predictions"""))
def q_accuracy(spark, sf):
    """E10."""
    return M.accuracy(preds(spark, sf))


@query("best_per_dataset", runs_sql("""
SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY dataset
                              ORDER BY f1 DESC, model, feature, condition) AS rank FROM runs) WHERE rank = 1"""))
def q_best_per_dataset(spark, sf):
    """The best run per dataset."""
    return R.topn_per_group(runs(spark, sf), "dataset", "f1", 1).drop("rank")


@query("model_perf_summary")
def q_model_perf_summary(spark, sf):
    """R6 (rounded half-even to 4 decimals; pytest compares it with the
    unrounded summary)."""
    return R.model_perf_summary(measured_runs(spark, sf), 4)


# ------------------------------------------- datasets, texts, filters, results --
HUFFPO_VIEW = ("raw", "SELECT url AS link, title AS headline, subtitle AS short_description, category FROM articles")


def huffpo_frame(spark, sf):
    """The articles in the columns of the huffpo dataset."""
    return arts(spark, sf).select(F.col("url").alias("link"), F.col("title").alias("headline"),
                                  F.col("subtitle").alias("short_description"), "category")


def huffpo_articles(spark, sf):
    return L.load_articles(huffpo_frame(spark, sf), "huffpo", suffix_rules=T.suffix_rules(spark))


@query("load_huffpo", with_views(f"""
, {suffix_sql("(SELECT link AS url, * FROM raw)")}
SELECT u.url, headline AS title, short_description AS subtitle, short_description AS summary, category,
       CASE WHEN registered_domain IS NOT NULL THEN host END AS publisher, 'huffpo' AS dataset, 'en' AS language
FROM u LEFT JOIN sfx USING (host) WHERE regexp_matches({S.clean(S.path('u.url'))}, '\\w')
""".replace("\n, ", ", ", 1), HUFFPO_VIEW))
def q_load_huffpo(spark, sf):
    """Another dataset in the canonical schema, its publisher from the URL."""
    return huffpo_articles(spark, sf).select("url", "title", "subtitle", "summary", "category", "publisher",
                                             "dataset", "language")


@query("feature_snippet", with_views(f"""
SELECT link AS url, coalesce(short_description, '') AS snippet FROM raw
WHERE regexp_matches({S.clean(S.path('link'))}, '\\w')""", HUFFPO_VIEW))
def q_feature_snippet(spark, sf):
    """P33c."""
    return huffpo_articles(spark, sf).select("url", TX.feature_text("snippet_description", "huffpo").alias("snippet"))


CODES = {"PROMO": 0, "LARGE": 1, "SMALL": 2, "ECONOMY": 3, "STANDARD": 4, "MEDIUM": 5}


@query("category_codes", with_views("""
SELECT article_id, CASE WHEN noise = 1 THEN NULL ELSE CASE prediction WHEN 'PROMO' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'SMALL' THEN 2
  WHEN 'ECONOMY' THEN 3 WHEN 'STANDARD' THEN 4 WHEN 'MEDIUM' THEN 5 END END AS code
FROM predictions JOIN (SELECT article_id, noise FROM articles) USING (article_id)""", views=("articles", "predictions")))
def q_category_codes(spark, sf):
    """The code in the first line of an answer; some answers have no such line."""
    a = arts(spark, sf).select("article_id", "noise")
    answers = preds(spark, sf).join(a, "article_id").select("article_id", F.when(
        F.col("noise") == 1, F.lit("I don't know\nCategory: PROMO")).otherwise(
        F.concat(F.lit("Category: "), "prediction", F.lit("\nbecause of the title"))).alias("answer"))
    return answers.select("article_id", TX.parse_category_line("answer", CODES).alias("code"))


@query("display_names", with_views("""
SELECT article_id, CASE language WHEN 'en' THEN 'English' WHEN 'pt' THEN 'Português' ELSE language END AS language_name,
       replace(title, 'small', 'little') AS title_name,
       coalesce(CASE WHEN noise < 5 THEN 'netloc_path' END, 'cleaned_path') AS variant
FROM articles"""))
def q_display_names(spark, sf):
    """P39, P42, P47."""
    a = arts(spark, sf)
    return a.select("article_id", TX.relabel("language", {"en": "English", "pt": "Português"}).alias("language_name"),
                    TX.replace_text("title", "small", "little").alias("title_name"),
                    TX.variant_name(F.when(F.col("noise") < 5, "netloc_path")).alias("variant"))


@query("http_short_pages", """
SELECT page_id, length(html) AS n_chars FROM pages WHERE url IS NOT NULL AND contains(url, 'https') AND length(html) < 2500""")
def q_http_short_pages(spark, sf):
    """F4, F8."""
    p = FL.url_contains(T.read_table(spark, sf, "pages"), "https", "url")
    return FL.text_shorter_than(p, "html", 2500).select("page_id", F.length("html").cast("long").alias("n_chars"))


@query("category_mix_per_domain", with_views("""
SELECT publisher, category, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY publisher) AS share
FROM articles WHERE publisher IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2"""))
def q_category_mix_per_domain(spark, sf):
    """A12's counts and shares of every category of a publisher."""
    return D.crosstab_shares(arts(spark, sf), "publisher", "category")


@query("result_files", with_views("""
SELECT language AS dataset, 'a' AS model, count(*) AS n, CAST(NULL AS DOUBLE) AS share,
       CASE WHEN language = 'es' THEN 'n/a' ELSE CAST(count(*) AS VARCHAR) END AS note FROM articles GROUP BY 1
UNION ALL
SELECT language, 'b', count(*), CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), NULL FROM articles GROUP BY 1"""))
def q_result_files(spark, sf):
    """Two result files with other columns and types, written, read back as one
    table and selected from."""
    from linklens.session import ensure_checkpoint_dir
    from linklens.sources import sinks as SK
    n = arts(spark, sf).groupBy(F.col("language").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    n = materialize(n)
    one = n.select("dataset", F.lit("a").alias("model"), "n", F.when(F.col("dataset") == "es", "n/a").otherwise(
        F.col("n").cast("string")).alias("note"))
    two = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select(
        F.lit("b").alias("model"), "dataset", (F.col("n") / F.col("t")).alias("share"), "n")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/linklens-tables/results-{uuid.uuid4().hex}"
    SK.write_table(one, f"{root}/one", "csv")
    SK.write_table(two.unionByName(two.withColumn("model", F.lit("dropped"))), f"{root}/two", "csv")
    found = L.read_result_tables(spark, f"{root}/*/*.csv")
    return FL.select_results(found, model="a").unionByName(FL.select_results(found, model="b")).select(
        "dataset", "model", "n", "share", "note")
