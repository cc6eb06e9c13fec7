"""URL structure analysis and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.functions import urls as U
from linklens.operators.ranks import exact_quantiles
from linklens.session import bounded_broadcast

STRUCT_MEASURES = ["path_length", "num_segments", "avg_segment_length"]
STRUCT_FLAGS = ["has_numbers", "is_semantic", "is_id_heavy", "has_category_indicators"]
QUALITY = ["accuracy", "precision", "recall", "f1"]


def url_structure(df: DataFrame, url: str = "url", keep=("article_id", "category",
                                                        "publisher")) -> DataFrame:
    """One row per URL with every flag, lengths, URL type and the host."""
    base = df.select(*[c for c in keep if c in df.columns], F.col(url).alias("url"),
                     U.url_netloc(url).alias("domain"), U.url_path(url).alias("_path"))
    base = base.withColumn("_segs", U.path_segments("_path"))
    cols = U.structure_columns("_path", "_segs")
    return base.select(*[c for c in keep if c in df.columns], "url", "domain",
                       *[v.alias(k) for k, v in cols.items()])


def structure_summary(struct: DataFrame) -> DataFrame:
    """One row of totals, means, percents and standard deviations."""
    pct = lambda c: F.avg(F.col(c).cast("double")) * 100
    return struct.agg(
        F.count(F.lit(1)).alias("total_urls"), F.countDistinct("domain").alias("unique_domains"),
        F.avg("path_length").alias("avg_path_length"), F.avg("num_segments").alias("avg_segments"),
        pct("has_numbers").alias("pct_with_numbers"), pct("is_semantic").alias("pct_semantic"),
        pct("is_id_heavy").alias("pct_id_heavy"),
        pct("has_category_indicators").alias("pct_with_categories"),
        F.stddev_samp("path_length").alias("path_length_std"),
        F.stddev_samp("num_segments").alias("segments_std"),
        F.stddev_samp("avg_segment_length").alias("avg_segment_length_std"))


def url_type_distribution(struct: DataFrame) -> DataFrame:
    """A23 (type part) / W13: count per URL type."""
    return struct.groupBy("url_type").agg(F.count(F.lit(1)).alias("n"))


def publisher_profile(struct: DataFrame, publisher: str = "publisher") -> DataFrame:
    """A24 + W6 in one pass: group by (publisher, url_type) keeping counts,
    sums and sums of squares, then fold to per-publisher mean and sample std
    of the three lengths, mean of four flags, and the dominant URL type
    (count desc, type asc). One shuffle of partially aggregated rows."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in STRUCT_MEASURES:
        x = F.col(c).cast("double")
        aggs += [F.sum(x).alias(f"_s_{c}"), F.sum(x * x).alias(f"_q_{c}")]
    aggs += [F.sum(F.col(c).cast("long")).alias(f"_s_{c}") for c in STRUCT_FLAGS]
    g = struct.where(F.col(publisher).isNotNull()).groupBy(publisher, "url_type").agg(*aggs)
    sums = [F.sum(f"_s_{c}").alias(f"_s_{c}") for c in STRUCT_MEASURES + STRUCT_FLAGS]
    sums += [F.sum(f"_q_{c}").alias(f"_q_{c}") for c in STRUCT_MEASURES]
    p = g.groupBy(publisher).agg(
        F.sum("_n").alias("_n"), *sums,
        F.min_by("url_type", F.struct(-F.col("_n"), F.col("url_type"))).alias("dominant_url_type"))
    n = F.col("_n").cast("double")
    out = []
    for c in STRUCT_MEASURES:
        mean = F.col(f"_s_{c}") / n
        var = F.greatest((F.col(f"_q_{c}") - F.col(f"_s_{c}") * F.col(f"_s_{c}") / n) / (n - 1), F.lit(0.0))
        std = F.when(n > 1, F.sqrt(var))
        if c == "avg_segment_length":
            # a mean of per-URL ratios: fixed at 9 decimals so the value does
            # not depend on the summation order across tasks
            mean, std = F.round(mean, 9), F.round(std, 9)
        out += [mean.alias(f"{c}_mean"), std.alias(f"{c}_std")]
    out += [(F.col(f"_s_{c}") / n).alias(f"{c}_mean") for c in STRUCT_FLAGS]
    return p.select(publisher, *out, "dominant_url_type")


def structure_by_publisher(struct: DataFrame, publisher: str = "publisher") -> DataFrame:
    """Mean and sample std of the three lengths, mean of four flags."""
    return publisher_profile(struct, publisher).drop("dominant_url_type")


def dominant_url_type(struct: DataFrame, publisher: str = "publisher") -> DataFrame:
    """Most frequent URL type per publisher (count desc, type asc)."""
    cnt = (struct.where(F.col(publisher).isNotNull()).groupBy(publisher, "url_type")
                 .agg(F.count(F.lit(1)).alias("n")))
    return cnt.groupBy(publisher).agg(
        F.min_by("url_type", F.struct(-F.col("n"), F.col("url_type"))).alias("dominant_url_type"))


def structure_performance(struct: DataFrame, domain_metrics: DataFrame,
                          publisher: str = "publisher") -> DataFrame:
    """Per-publisher quality joined with structure stats and the
    dominant URL type; both come from one pass over the structure rows, and
    the join is between two per-publisher aggregates."""
    perf = domain_metrics.select(F.col("domain").alias(publisher), *QUALITY, "support")
    return perf.join(publisher_profile(struct, publisher), publisher)


def publisher_overlap(perf: DataFrame, struct: DataFrame, publisher: str = "publisher") -> DataFrame:
    """Sizes of the two publisher sets and of their intersection."""
    a = perf.select(F.col("domain").alias(publisher)).distinct()
    b = struct.select(publisher).where(F.col(publisher).isNotNull()).distinct()
    both = a.intersect(b)
    return (a.agg(F.count(F.lit(1)).alias("performance_publishers"))
             .crossJoin(b.agg(F.count(F.lit(1)).alias("structure_publishers")))
             .crossJoin(both.agg(F.count(F.lit(1)).alias("overlap"))))


def performance_by_url_type(combined: DataFrame, decimals: int | None = None) -> DataFrame:
    """mean/std/count of accuracy and f1 and total support per dominant
    type; ``decimals`` rounds half-even like the reference's round(4)."""
    out = combined.groupBy("dominant_url_type").agg(
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"),
        F.count("accuracy").alias("accuracy_count"),
        F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"),
        F.count("f1").alias("f1_count"), F.sum("support").alias("support_sum"))
    if decimals is not None:
        for c in ["accuracy_mean", "accuracy_std", "f1_mean", "f1_std"]:
            out = out.withColumn(c, F.bround(c, decimals))
    return out


def structure_columns_of(combined: DataFrame) -> list[str]:
    keys = STRUCT_MEASURES + ["has_", "is_"]
    return [c for c in combined.columns if any(k in c for k in keys)
            and c != "dominant_url_type" and dict(combined.dtypes)[c] in ("double", "bigint", "int")]


def structure_correlations(combined: DataFrame) -> DataFrame:
    """Pearson r of every structure metric with each quality metric, as
    (quality_metric, structure_metric, r); undefined values dropped."""
    scols = structure_columns_of(combined)
    aggs = [F.corr(q, s).alias(f"{q}|{s}") for q in QUALITY for s in scols]
    wide = combined.agg(*aggs)
    stack = "stack({}, {}) as (quality_metric, structure_metric, r)".format(
        len(aggs), ", ".join(f"'{q}', '{s}', `{q}|{s}`" for q in QUALITY for s in scols))
    return wide.selectExpr(stack).where(F.col("r").isNotNull() & ~F.isnan("r"))


def strongest_correlations(corrs: DataFrame, k: int = 5) -> DataFrame:
    """The k correlations largest in absolute value."""
    return corrs.orderBy(F.abs("r").desc(), "quality_metric", "structure_metric").limit(k)


def high_low_comparison(combined: DataFrame) -> DataFrame:
    """Split at the median f1 (>= high, < low): mean of each structure
    metric in both halves and the difference."""
    scols = structure_columns_of(combined)
    med = exact_quantiles(combined, "f1", [0.5], ["_med"])
    j = combined.crossJoin(bounded_broadcast(med))
    hi = F.col("f1") >= F.col("_med")
    aggs = []
    for s in scols:
        aggs += [F.avg(F.when(hi, F.col(s))).alias(f"h|{s}"), F.avg(F.when(~hi, F.col(s))).alias(f"l|{s}")]
    wide = j.agg(*aggs)
    stack = "stack({}, {}) as (metric, high_performance_mean, low_performance_mean)".format(
        len(scols), ", ".join(f"'{s}', `h|{s}`, `l|{s}`" for s in scols))
    return (wide.selectExpr(stack)
                .withColumn("difference", F.col("high_performance_mean") - F.col("low_performance_mean")))


def f1_by_semantic_share(combined: DataFrame) -> DataFrame:
    """Five-number summary of f1 for semantic share > .5 and <= .5."""
    names = ["min", "q25", "median", "q75", "max"]
    rows = combined.select((F.col("is_semantic_mean") > 0.5).alias("mostly_semantic"), "f1")
    n = rows.groupBy("mostly_semantic").agg(F.count(F.lit(1)).alias("n"))
    # at most three groups
    q = exact_quantiles(rows, "f1", [0.0, 0.25, 0.5, 0.75, 1.0], names, ["mostly_semantic"])
    q = q.withColumnRenamed("mostly_semantic", "_g")
    return (n.join(bounded_broadcast(q), F.col("mostly_semantic").eqNullSafe(F.col("_g")), "left")
             .select("mostly_semantic", "n", *names))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise Pearson r of the given columns, long form."""
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    stack = "stack({}, {}) as (col_a, col_b, r)".format(
        len(pairs), ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs))
    return wide.selectExpr(stack)


def mean_f1_by_type(combined: DataFrame) -> DataFrame:
    """Mean f1 per dominant type, ascending."""
    return (combined.groupBy("dominant_url_type").agg(F.avg("f1").alias("f1_mean"))
                    .orderBy("f1_mean", "dominant_url_type"))


# ---- URL audit (A28-A31) ----------------------------------------------------

def skeleton_counts(df: DataFrame, url: str = "url", top_n: int | None = None) -> DataFrame:
    """(skeleton, n); top_n keeps the most common (count desc, key asc)."""
    sk = df.select(U.url_skeleton(U.url_path(url)).alias("skeleton"))
    out = sk.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n"))
    if top_n:
        out = out.orderBy(F.col("n").desc(), "skeleton").limit(top_n)
    return out


def rule_counts(df: DataFrame, url: str = "url", rules=None) -> DataFrame:
    """URLs per first-matching rule, with zero rows for unmatched rules."""
    rules = rules or U.DEFAULT_RULES
    names = list(rules) + ["other"]
    lab = df.select(U.rule_label(U.url_path(url), rules).alias("rule"))
    # fixed small aggregate over the rule names: pivot with the known list
    wide = lab.groupBy().pivot("rule", names).agg(F.count(F.lit(1)))
    stack = "stack({}, {}) as (rule, n)".format(
        len(names), ", ".join(f"'{n}', coalesce(`{n}`, 0L)" for n in names))
    return wide.selectExpr(stack)


def depth_stats(df: DataFrame, url: str = "url") -> DataFrame:
    """min/mean/max of depth and of the segment counts before the last
    segment; percent of URLs whose last segment has a digit."""
    base = df.select(U.url_path(url).alias("_path"))
    base = base.withColumn("_segs", U.path_segments("_path"))
    cols = U.depth_columns("_path", "_segs")
    d = base.select(*[v.alias(k) for k, v in cols.items()])
    aggs = []
    for k in ["depth", "other_segments", "other_numeric_segments", "other_text_segments"]:
        aggs += [F.min(k).alias(f"{k}_min"), F.avg(k).alias(f"{k}_mean"), F.max(k).alias(f"{k}_max")]
    aggs.append((F.avg(F.col("last_has_number").cast("double")) * 100)
                .alias("last_segment_contains_number_percent"))
    return d.agg(*aggs)


def url_audit(df: DataFrame, url: str = "url", top_skeletons: int = 10) -> dict:
    """The three audit frames."""
    return {"skeletons": skeleton_counts(df, url, top_skeletons),
            "regex_counts": rule_counts(df, url), "depth_stats": depth_stats(df, url)}


def path_length_hist(struct: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of path length over [min, max] (numpy
    rules: last bin closed, +-0.5 range when min == max), all bins listed."""
    rng = struct.agg(F.min("path_length").cast("double").alias("lo0"),
                     F.max("path_length").cast("double").alias("hi0"))
    rng = rng.select(F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
                     F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col("path_length") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = (struct.select("path_length").crossJoin(bounded_broadcast(rng))
                    .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    grid = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return (grid.join(counts, "bin", "left")
                .select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
                        (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_end"),
                        F.coalesce("n", F.lit(0)).alias("n")))


def describe_column(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max of one column."""
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    one = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                 F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"))
    return one.crossJoin(bounded_broadcast(q)).select("count", "mean", "std", "min", "q25", "q50", "q75", "max")
