"""Result tables: evaluation runs, top-k, best-per-group, pivots and the
tidy statistics report (W1-W13, R1-R9, U3, U5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linklens.operators import distribution as D
from linklens.functions import urls as U
from linklens.operators.runs import FEATURES
from linklens.session import materialize

def topn_per_group(df: DataFrame, by, order: str = "f1", k: int = 5,
                   tiebreak=("model", "feature", "condition")) -> DataFrame:
    """The k best rows per group (order desc, tie-break keys asc), with
    their rank. The literal limit lets Spark cut each task's rows to k per
    group before the shuffle (WindowGroupLimit)."""
    by = [by] if isinstance(by, str) else list(by)
    tb = [c for c in tiebreak if c in df.columns and c not in by]
    w = Window.partitionBy(*by).orderBy(F.col(order).desc(), *tb)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, order: str = "f1", k: int = 10, ascending: bool = False,
          tiebreak=()) -> DataFrame:
    """Global top-k (TakeOrdered: per-task top-k then merge)."""
    o = F.col(order).asc() if ascending else F.col(order).desc()
    return df.orderBy(o, *tiebreak).limit(k)


def f1_pivot(results: DataFrame, features=None, metric: str = "f1") -> DataFrame:
    """Mean metric, (dataset, model) x feature, over a known feature list."""
    features = features or FEATURES
    return results.groupBy("dataset", "model").pivot("feature", features).agg(F.avg(metric))


def model_summary(results: DataFrame) -> DataFrame:
    """Per model mean accuracy/precision/recall/f1, std and
    median of f1, mean/std throughput where it was measured."""
    speed = [F.avg("throughput").alias("throughput_mean"), F.stddev_samp("throughput").alias("throughput_std")]
    return results.groupBy("model").agg(
        F.avg("accuracy").alias("accuracy_mean"), F.avg("precision").alias("precision_mean"),
        F.avg("recall").alias("recall_mean"), F.avg("f1").alias("f1_mean"),
        F.stddev_samp("f1").alias("f1_std"), F.percentile("f1", 0.5).alias("f1_median"),
        *(speed if "throughput" in results.columns else []))


def model_perf_summary(results: DataFrame, decimals: int | None = 4) -> DataFrame:
    """f1, accuracy and throughput mean/std per model, rounded half-even
    like the reference's round(4)."""
    out = results.groupBy("model").agg(
        F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"),
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"),
        F.avg("throughput").alias("throughput_mean"), F.stddev_samp("throughput").alias("throughput_std"))
    if decimals is not None:
        for c in out.columns[1:]:
            out = out.withColumn(c, F.bround(c, decimals))
    return out


def feature_summary(results: DataFrame) -> DataFrame:
    """f1 mean/std per feature, best first."""
    return (results.groupBy("feature").agg(F.avg("f1").alias("f1_mean"),
                                           F.stddev_samp("f1").alias("f1_std"))
                   .orderBy(F.col("f1_mean").desc(), "feature"))


def throughput_pivot(results: DataFrame, datasets=("en", "es", "pt")) -> DataFrame:
    """Mean throughput model x dataset."""
    return results.groupBy("model").pivot("dataset", list(datasets)).agg(F.avg("throughput"))


def success_pivot(results: DataFrame, datasets=("en", "es", "pt")) -> DataFrame:
    """Mean success rate feature x dataset."""
    return results.groupBy("feature").pivot("dataset", list(datasets)).agg(F.avg("success_rate"))


def overall_means(results: DataFrame) -> DataFrame:
    """Number of runs, mean success rate, f1 and, where it was measured, throughput."""
    speed = [F.avg("throughput").alias("throughput_mean")] if "throughput" in results.columns else []
    return results.agg(F.count(F.lit(1)).alias("n_runs"), F.avg("success_rate").alias("success_rate_mean"),
                       F.avg("f1").alias("f1_mean"), *speed)


def mean_f1_by(results: DataFrame, keys=("dataset", "model")) -> DataFrame:
    """R8."""
    return results.groupBy(*keys).agg(F.avg("f1").alias("f1_mean"))


def _tidy(frame: DataFrame, by: str, section: str) -> DataFrame:
    cols = [c for c in frame.columns if c != by]
    stack = "stack({}, {}) as (metric, value)".format(
        len(cols), ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols))
    return frame.selectExpr(by, f"'{section}' AS section", stack)


def stats_report(df: DataFrame, by: str = "dataset", domain: str = "publisher",
                 y: str = "category", text: str = "title", url: str = "url", top: int = 10) -> DataFrame:
    """The descriptive statistics as a tidy (dataset, section, metric, value) table
    instead of formatted text: categories, text lengths, publishers (skew, distribution,
    categories, the ``top`` largest), the chi-square test of publisher and category, and URL
    types.

    One scan counts (by, publisher, category), (by, text length) and (by, URL type) as
    grouping sets; the counts are written once and every section rolls them up."""
    rows = df.select(by, F.col(domain).alias("_d"), F.col(y).alias("_y"), F.length(text).alias("_len"),
                     U.structure_columns(U.url_path(url))["url_type"].alias("_type"))
    sets = [[by, "_d", "_y"], [by, "_len"], [by, "_type"]]
    counts = materialize(rows.groupingSets(sets, by, "_d", "_y", "_len", "_type").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_set")))
    ids = {0b0011: "cells", 0b1101: "length", 0b1110: "type"}
    part = {name: counts.where(F.col("_set") == i) for i, name in ids.items()}
    cells = part["cells"].select(by, F.col("_d").alias(domain), F.col("_y").alias(y), "n")
    length = part["length"].where("_len IS NOT NULL")
    q = F.percentile("_len", [0.25, 0.5, 0.75], F.col("n"))
    n, total = F.sum("n"), F.sum(F.col("_len") * F.col("n"))
    square = F.sum(F.col("_len").cast("double") * F.col("_len") * F.col("n"))
    length = length.groupBy(by).agg((total / n).alias("mean"), q.alias("_q"),
                                    F.sqrt((square - total * (total / n)) / (n - 1)).alias("std"),
                                    F.min("_len").alias("min"), F.max("_len").alias("max"))
    length = length.select(by, "mean", F.col("_q")[1].alias("median"), "std", "min", "max",
                           F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"))
    out = _tidy(D.category_summary(cells, y, by, "n").drop("most_common", "least_common"), by, "categories")
    for name, frame in {"text_length": length, "domain_skew": D.domain_skew(cells, domain, by, "n"),
                        "category_per_domain": D.category_per_domain_summary(cells, domain, y, by, "n"),
                        "domain_distribution": D.domain_distribution(cells, domain, by, "n"),
                        "chi_square": D.chi2_by(cells, by, domain, y).drop("p_value")}.items():
        out = out.unionByName(_tidy(frame, by, name))
    all_rows = cells.groupBy(by).agg(F.sum("n").alias("_all"))      # one row per dataset
    largest = topn_per_group(D.domain_counts(cells, domain, by, "n"), by, "n", top, tiebreak=(domain,))
    largest = largest.select(by, F.lit("top_domains").alias("section"), F.col(domain).alias("metric"), "n")
    types = part["type"].select(by, F.lit("url_types").alias("section"), F.col("_type").alias("metric"), "n")
    shares = largest.unionByName(types).join(F.broadcast(all_rows), by).select(
        by, "section", "metric", (F.col("n") / F.col("_all")).alias("value"))
    return out.unionByName(shares)


def best_per_topic(topic_runs: DataFrame) -> DataFrame:
    """Best (model, feature, condition) per topic by f1 (ties by keys)."""
    return topn_per_group(topic_runs, "topic", "f1", 1).drop("rank")


def url_type_extremes(struct: DataFrame, combined: DataFrame) -> DataFrame:
    """The most common URL type and the dominant type with the best mean f1."""
    common = (struct.groupBy("url_type").agg(F.count(F.lit(1)).alias("n"))
                    .orderBy(F.col("n").desc(), "url_type").limit(1)
                    .select(F.lit("most_common").alias("kind"), F.col("url_type").alias("url_type"),
                            F.col("n").cast("double").alias("value")))
    best = (combined.groupBy("dominant_url_type").agg(F.avg("f1").alias("f1_mean"))
                    .orderBy(F.col("f1_mean").desc(), "dominant_url_type").limit(1)
                    .select(F.lit("best_mean_f1").alias("kind"), F.col("dominant_url_type").alias("url_type"),
                            F.col("f1_mean").alias("value")))
    return common.unionByName(best)
