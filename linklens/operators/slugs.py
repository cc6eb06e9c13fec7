"""Slug mapping, URL-section labels and weak-label training sets
(S15, J4-J7, D4-D5, M10, A32-A36, U6).

A lookup (J6, J7) turns the mapping into an index of slugs, and a URL into the
runs of path segments that a slug could be. The runs meet the index by an
equi-join, which Spark broadcasts while the index passes its size check, and
each article takes its first hit. The article's columns travel with its first
run only, and runs without a hit go before the regrouping, so that shuffle
moves each article once, by a number of its own: rows may repeat an id. The
mapping may hold millions of slugs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.functions import urls as U
from linklens.session import bounded_broadcast, broadcast_if_small, materialize

UNKNOWN = "unknown"


def usable_mapping(mapping: DataFrame) -> DataFrame:
    """Rows with a non-blank slug and category (S5 rules)."""
    m = mapping.select("slug_rank", F.trim("slug").alias("slug"), F.trim("category").alias("category"))
    return m.where(F.col("slug").isNotNull() & (F.col("slug") != "") &
                   F.col("category").isNotNull() & (F.col("category") != "") &
                   (F.col("category") != "nan"))


def slug_template(df: DataFrame, url: str = "url", top: int = 250) -> DataFrame:
    """The most frequent first URL sections with a blank category,
    ready to be filled in by hand (count desc, section asc)."""
    sec = df.where(F.col(url).isNotNull()).select(U.first_section(url).alias("slug"))
    cnt = sec.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    return (cnt.orderBy(F.col("n").desc(), "slug").limit(top)
               .select("slug", "n", F.lit("").alias("category")))


def valid_categories(mapping: DataFrame) -> DataFrame:
    """Distinct mapped categories, sorted."""
    return usable_mapping(mapping).select("category").distinct().orderBy("category")


def _first_hits(df: DataFrame, runs: Column, index: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_hit``, the struct (order, slug, category) of the first of its runs in
    ``index`` (slug, slug_rank, category), null without one; ``order`` is ``_pos``, the place
    of the run, or ``slug_rank``."""
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*df.columns).alias("_all"),
                     runs.alias("_runs"))
    # an article without runs keeps one row
    runs_of = rows.select("_row", "_all", F.posexplode_outer("_runs").alias("_pos", "_run")).select(
        "_row", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_all")).alias("_all"), "_pos", "_run")
    known = broadcast_if_small(index.withColumnRenamed("slug", "_slug"))
    met = runs_of.join(known, F.col("_run") == F.col("_slug"), "left").where(
        F.col("_all").isNotNull() | F.col("_slug").isNotNull())
    hit = F.when(F.col("_slug").isNotNull(), F.struct(order, F.col("_slug").alias("slug"), "category"))
    return (met.groupBy("_row").agg(F.first("_all", ignorenulls=True).alias("_all"), F.min(hit).alias("_hit"))
            .select("_all.*", "_hit"))


def _last_rows(m: DataFrame) -> DataFrame:
    """(slug, slug_rank, category): of repeated slugs the last row of the file counts."""
    return (m.groupBy("slug").agg(F.max(F.struct("slug_rank", "category")).alias("v"))
            .select("slug", "v.slug_rank", "v.category"))


def _folded(m: DataFrame) -> DataFrame:
    """(slug, slug_rank, category): lower-cased slugs with their first row of the file."""
    return (m.groupBy(F.lower("slug").alias("slug")).agg(F.min(F.struct("slug_rank", "category")).alias("v"))
            .select("slug", "v.slug_rank", "v.category"))


def component_runs(text: Column, longest: int) -> Column:
    """All texts s of up to ``longest`` '/'-separated segments for which ``text`` holds '/s/',
    '/s?' or '/s#', ends with '/s' or starts with 's/'."""
    segments = F.split(text, "/")
    n = F.size(segments)

    def ended(x: Column) -> Column:
        """x up to each of its '?' and '#', and the whole of it."""
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))),
                          lambda p: F.substr(x, p, F.lit(1)).isin("?", "#"))
        cut = F.transform(places, lambda p: F.substr(x, F.lit(1), p - 1))
        return F.when(x.rlike("[?#]"), F.concat(cut, F.array(x))).otherwise(F.array(x))

    def runs_of(size: int) -> Column:
        def run(i: Column) -> Column:
            before = F.concat_ws("/", F.slice(segments, i + 1, F.lit(size - 1)), F.array(F.lit("")))
            return F.transform(ended(F.get(segments, i + (size - 1))), lambda x: F.concat(before, x) if size > 1 else x)

        later = F.flatten(F.transform(F.sequence(F.lit(1), n - size), run))
        start = F.array(F.array_join(F.slice(segments, F.lit(1), F.lit(size)), "/"))
        return F.when(n > size, F.concat(start, later)).otherwise(F.array().cast("array<string>"))

    found = F.concat(*[runs_of(size) for size in range(1, longest + 1)])
    return F.array_distinct(found)


def section_label_join(df: DataFrame, mapping: DataFrame, url: str = "url",
                       text: str = "title") -> DataFrame:
    """Training pairs (x = text, y = category) for articles whose first
    URL section equals a mapped slug."""
    m = usable_mapping(mapping).select(F.col("slug").alias("_section"), F.col("category").alias("_y"))
    return (df.withColumn("_section", U.first_section(url))
              .join(broadcast_if_small(m), "_section")
              .select("article_id", F.col(text).alias("x"), F.col("_y").alias("y")))


def derive_labels(df: DataFrame, mapping: DataFrame, url: str = "url") -> DataFrame:
    """Every article keeps its row; derived_label is the mapped category of
    its first URL section, NULL when unmapped."""
    m = usable_mapping(mapping).select(F.col("slug").alias("_section"),
                                       F.col("category").alias("derived_label"))
    return (df.withColumn("_section", U.first_section(url))
              .join(broadcast_if_small(m), "_section", "left").drop("_section"))


def weak_labels(df: DataFrame, mapping: DataFrame, url: str = "url") -> DataFrame:
    """First candidate slug (path order, case-sensitive) found in the
    mapping -> distant_label ('unknown' when none), url_category, matched_slug."""
    hits = _first_hits(df, U.candidate_slugs(U.url_path(url)), _last_rows(usable_mapping(mapping)), "_pos")
    return hits.select(*df.columns, F.col("_hit.slug").alias("matched_slug"),
                       F.col("_hit.category").alias("url_category"),
                       F.coalesce("_hit.category", F.lit(UNKNOWN)).alias("distant_label"))


def mapped_category(df: DataFrame, mapping: DataFrame, text: str = "text",
                    out: str = "mapped_category") -> DataFrame:
    """The category of the first mapping row (file order) whose slug
    appears in the lower-cased text as a path component ('/s/', ends '/s',
    starts 's/', '/s?', '/s#'); NULL when none. A slug may hold '/' itself."""
    index = _folded(usable_mapping(mapping))
    longest = index.agg(F.max(F.size(F.split("slug", "/")))).first()[0] or 1
    t = F.col(text) if isinstance(text, str) else text
    hits = _first_hits(df, component_runs(F.lower(t), longest), index, "slug_rank")
    return hits.select(*df.columns, F.col("_hit.category").alias(out))


def hash_sample(df: DataFrame, key: str = "article_id", n: int = 1000, seed: int = 42) -> DataFrame:
    """Deterministic sample of min(n, rows): the n smallest md5(seed|key)
    (a TakeOrdered: each task keeps its n best before the merge)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def url_tagging_check(df: DataFrame, mapping: DataFrame, url: str = "url", n: int = 1000,
                      seed: int = 42, min_ratio: float = 0.10, min_sample: int = 50) -> DataFrame:
    """Share of a hash sample whose URL has a mapped candidate slug; the
    dataset uses URL tagging when the share >= min_ratio on > min_sample URLs."""
    s = weak_labels(hash_sample(df, "article_id", n, seed), mapping, url)
    return s.agg(F.count(F.lit(1)).alias("sample_size"),
                 F.count("matched_slug").alias("matches")).select(
        "sample_size", "matches", (F.col("matches") / F.col("sample_size")).alias("ratio"),
        ((F.col("sample_size") > min_sample) &
         (F.col("matches") / F.col("sample_size") >= min_ratio)).alias("uses_url_tagging"))


def weak_training_set(df: DataFrame, mapping: DataFrame, url: str = "url", **check) -> DataFrame:
    """D5 gate -> J6 -> known labels -> non-null label. When the gate
    fails no row is labelled (all stay unlabelled)."""
    # the gate is a one-row decision over a sample: decide it once
    gate = materialize(url_tagging_check(df, mapping, url, **check).select("uses_url_tagging"))
    lab = weak_labels(df, mapping, url).crossJoin(bounded_broadcast(gate))
    return (lab.where(F.col("uses_url_tagging") & (F.col("distant_label") != UNKNOWN))
               .withColumn("category_label", F.col("distant_label"))
               .dropna(subset=["category_label"]).drop("uses_url_tagging"))


def weak_label_counts(labelled: DataFrame, min_examples: int = 10) -> DataFrame:
    """Examples per weak label, with the smallest class and a warning flag."""
    cnt = labelled.groupBy("category_label").agg(F.count(F.lit(1)).alias("n"))
    mn = cnt.agg(F.min("n").alias("min_examples"))
    return (cnt.crossJoin(bounded_broadcast(mn))
               .withColumn("few_examples", F.col("min_examples") < min_examples))


def label_breakdown(derived: DataFrame, col: str = "derived_label") -> DataFrame:
    """Percent per derived label, NULL kept as its own group."""
    cnt = derived.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    tot = cnt.agg(F.sum("n").alias("_t"))
    return (cnt.crossJoin(bounded_broadcast(tot))
               .select(col, "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct")))


def label_agreement(derived: DataFrame, col: str = "derived_label", truth: str = "category") -> DataFrame:
    """Per derived label, agreement with the true label."""
    d = derived.where(F.col(col).isNotNull() & F.col(truth).isNotNull())
    eq = (F.col(col) == F.col(truth)).cast("long")
    return d.groupBy(col).agg(F.avg(eq).alias("accuracy"), F.sum(eq).alias("matches"),
                              F.count(F.lit(1)).alias("total"))


def label_cross_view(derived: DataFrame, value: str, col: str = "derived_label",
                     truth: str = "category") -> DataFrame:
    """True-label counts among rows with one derived label."""
    return (derived.where(F.col(col) == value).groupBy(truth)
                   .agg(F.count(F.lit(1)).alias("n")))
