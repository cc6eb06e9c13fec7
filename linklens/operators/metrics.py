"""Evaluation metrics as aggregations over a long confusion table.

Input is a prediction table (keys.., label, prediction). Everything after the
first partially-aggregated ``groupBy`` runs on (keys x labels x predictions)
cells, so per-domain metrics for millions of publishers need no driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys or [])


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (zero_division=0)."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(pred: DataFrame, keys=(), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(keys.., label, prediction, n)."""
    return (pred.groupBy(*_k(keys), F.col(label).alias("label"), F.col(prediction).alias("prediction"))
                .agg(F.count(F.lit(1)).alias("n")))


def _label_stats(conf: DataFrame, keys) -> DataFrame:
    """Per (keys, label) over labels of y_true union y_pred: tp, fp, fn, support."""
    keys = _k(keys)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    true = F.struct(F.col("label").alias("label"), F.col("n").alias("support"), hit.cast("long").alias("tp"),
                    zero.alias("predicted"))
    said = F.struct(F.col("prediction").alias("label"), zero.alias("support"), zero.alias("tp"),
                    F.col("n").alias("predicted"))
    # each cell counts for its true label and, if there is one, for the predicted label;
    # grouping (not joining) keeps rows with null keys together
    roles = F.filter(F.array(F.struct(F.lit(True).alias("use"), true.alias("r")),
                             F.struct(F.col("prediction").isNotNull().alias("use"), said.alias("r"))),
                     lambda x: x["use"])
    g = (conf.select(*keys, F.explode(roles).alias("x")).select(*keys, "x.r.*")
             .groupBy(*keys, "label")
             .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                  F.sum("predicted").alias("predicted")))
    return g.select(*keys, "label", "tp", (F.col("predicted") - F.col("tp")).alias("fp"),
                    (F.col("support") - F.col("tp")).alias("fn"), "support")


def _with_prf(stats: DataFrame) -> DataFrame:
    p = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    s = (stats.withColumn("precision", p).withColumn("recall", r))
    return s.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"),
                                   F.col("precision") + F.col("recall")))


def per_topic_metrics(conf: DataFrame, keys=()) -> DataFrame:
    """Per true label tp/fp/fn/support/precision/recall/f1. Predictions of
    labels that never occur as truth count as errors (fn) of the true label."""
    return _with_prf(_label_stats(conf, keys).where(F.col("support") > 0))


def macro_metrics(conf: DataFrame, keys=()) -> DataFrame:
    """Accuracy and macro precision/recall/f1 over y_true union y_pred."""
    keys = _k(keys)
    s = _with_prf(_label_stats(conf, keys))
    return s.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").alias("n_samples"),
        F.sum("tp").alias("n_correct"))


def micro_metrics(conf: DataFrame, keys=()) -> DataFrame:
    """Micro precision/recall/f1 from summed tp/fp/fn."""
    keys = _k(keys)
    s = _label_stats(conf, keys).groupBy(*keys).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(*keys, p.alias("micro_precision"), r.alias("micro_recall"),
                    _div(2 * p * r, p + r).alias("micro_f1"))


def per_domain_metrics(pred: DataFrame, domain: str = "publisher") -> DataFrame:
    """Per domain accuracy, macro P/R/F1 over that domain's label union,
    support and number correct. Rows without a domain are left out."""
    conf = confusion(pred.where(F.col(domain).isNotNull()), [domain])
    m = macro_metrics(conf, [domain])
    return m.select(F.col(domain).alias("domain"), "accuracy", "precision", "recall", "f1",
                    F.col("n_samples").alias("support"),
                    "n_correct")


def per_domain_topic_metrics(pred: DataFrame, domain: str = "publisher") -> DataFrame:
    """Per (domain, true topic). Inside such a group the truth is one
    label t, so with acc = correct/n and L = |{t} u predictions|:
    P = [correct > 0]/L, R = acc/L, F1 = 2 acc/(1+acc)/L."""
    conf = confusion(pred, [domain])
    g = conf.groupBy(domain, "label").agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("n_correct"),
        F.count("prediction").alias("_npred"))
    acc = F.col("n_correct") / F.col("support")
    L = F.col("_npred") + F.when(F.col("n_correct") == 0, 1).otherwise(0)
    return g.select(F.col(domain).alias("domain"), F.col("label").alias("topic"),
                    acc.alias("accuracy"),
                    (F.when(F.col("n_correct") > 0, 1.0).otherwise(0.0) / L).alias("precision"),
                    (acc / L).alias("recall"), (2 * acc / (1 + acc) / L).alias("f1"),
                    "support", "n_correct")


def success_rate(pred: DataFrame, prediction: str = "prediction", keys=()) -> DataFrame:
    """Share of submitted rows with a usable (non-null) prediction."""
    return pred.groupBy(*_k(keys)).agg(
        F.count(F.lit(1)).alias("submitted"), F.count(prediction).alias("valid"),
        F.avg(F.col(prediction).isNotNull().cast("double")).alias("success_rate"))


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """E10."""
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def stamp(df: DataFrame, **values) -> DataFrame:
    """Constant run columns (run_id, dataset, model, feature)."""
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df


def domain_lift(domain_metrics: DataFrame, topic_metrics: DataFrame) -> DataFrame:
    """Per domain normalised topic entropy (0 for one topic), majority
    topic baseline and accuracy lift over it."""
    tc = topic_metrics.groupBy("domain", "topic").agg(F.sum("support").alias("support"))
    g = tc.groupBy("domain").agg(
        F.count(F.lit(1)).alias("_k"), F.sum("support").alias("_t"), F.max("support").alias("_m"),
        F.sum(F.col("support") * F.log(2.0, "support")).alias("_nlogn"))
    ent = F.log(2.0, "_t") - F.col("_nlogn") / F.col("_t")
    g = g.select("domain", F.when(F.col("_k") > 1, ent / F.log(2.0, "_k")).otherwise(0.0)
                 .alias("entropy_norm"), (F.col("_m") / F.col("_t")).alias("baseline_acc"))
    return (domain_metrics.join(g, "domain")
                          .withColumn("accuracy_lift", F.col("accuracy") - F.col("baseline_acc")))


def lift_summary(lift: DataFrame) -> DataFrame:
    """Share of domains with lift > .05 and < -.05; Pearson
    r(log10 support, f1) and r(entropy_norm, lift)."""
    return lift.agg(
        F.corr(F.log10("support"), "f1").alias("r_log_support_f1"),
        F.corr("entropy_norm", "accuracy_lift").alias("r_entropy_lift"),
        F.avg((F.col("accuracy_lift") > 0.05).cast("double")).alias("share_lift_gt_5pp"),
        F.avg((F.col("accuracy_lift") < -0.05).cast("double")).alias("share_lift_lt_neg_5pp"))


def ablation_compare(results: DataFrame, keys=("dataset", "model", "feature"),
                     cond: str = "condition", base: str = "with_dates",
                     other: str = "no_dates", metric: str = "f1") -> DataFrame:
    """Groups with exactly two rows and both conditions: metric in each,
    delta (other - base) and percent change (0 when the base is 0)."""
    keys = _k(keys)
    g = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col(cond) == base, F.col(metric))).alias(f"{metric}_with_dates"),
        F.max(F.when(F.col(cond) == other, F.col(metric))).alias(f"{metric}_no_dates"),
        F.count_if(F.col(cond) == base).alias("_b"), F.count_if(F.col(cond) == other).alias("_o"))
    g = g.where((F.col("_n") == 2) & (F.col("_b") > 0) & (F.col("_o") > 0))
    d = F.col(f"{metric}_no_dates") - F.col(f"{metric}_with_dates")
    w = F.col(f"{metric}_with_dates")
    return g.select(*keys, f"{metric}_with_dates", f"{metric}_no_dates", d.alias(f"delta_{metric}"),
                    F.when(w > 0, d / w * 100).otherwise(0.0).alias("pct_change"))


def ablation_summary(cmp: DataFrame, col: str = "delta_f1") -> DataFrame:
    """Mean, sample std, max, min of the delta; improved/degraded/unchanged."""
    c = F.col(col)
    return cmp.agg(F.avg(c).alias("mean_delta"), F.stddev_samp(c).alias("std_delta"),
                   F.max(c).alias("max_delta"), F.min(c).alias("min_delta"),
                   F.count_if(c > 0).alias("improved"), F.count_if(c < 0).alias("degraded"),
                   F.count_if(c == 0).alias("unchanged"), F.count(F.lit(1)).alias("n"))
