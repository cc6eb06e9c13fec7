"""Deterministic splits and samples (D1-D3, D6 data part).

Assignment is a pure function of (seed, key): md5 of 'seed|key', first 8 hex
digits as an integer, bucket = value mod ``buckets``. It needs no shuffle,
does not change under repartitioning or executor loss, and has the same
value in SQL engines that have md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens.session import bounded_broadcast, broadcast_if_small, materialize

SEED = 20240823


def hash_bucket(key, seed: int = SEED, buckets: int = 100) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(buckets))


def assign_split(df: DataFrame, key: str = "article_id", seed: int = SEED,
                 cuts=(("train", 80), ("val", 90)), last: str = "test",
                 buckets: int = 100) -> DataFrame:
    """D1 (80/10/10) and D2 (cuts=(('train',700),('val',901)), buckets=1000):
    split name from the hash bucket; cut points are exclusive upper bounds."""
    b = hash_bucket(key, seed, buckets)
    expr = None
    for name, upper in cuts:
        expr = F.when(b < upper, name) if expr is None else expr.when(b < upper, name)
    return df.withColumn("split", expr.otherwise(last))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def stratified_subset(df: DataFrame, size: int, label: str = "label", key: str = "article_id",
                      seed: int = 42, mode: str = "reference") -> DataFrame:
    """D3: fixed-size training subset.

    Per class c with n_c of N rows the quota is min(n_c, max(1, floor(size*n_c/N)));
    rows inside a class are taken in hash order. mode='reference' keeps the
    reference's rule: when the quotas sum below ``size``, take a plain hash
    sample of min(size, N) rows instead. mode='largest_remainder' hands the
    missing rows to the classes with the largest fractional parts.

    Each class contributes at most ``size`` rows, so the per-class ranking is a
    window with a literal row limit, which Spark evaluates as a per-task top-k
    before the shuffle (WindowGroupLimit)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    d = df.withColumn("_h", h)
    counts = d.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_N"))
    q = counts.crossJoin(bounded_broadcast(tot))
    exact = F.lit(size) * F.col("_nc") / F.col("_N")
    q = q.withColumn("_quota", F.least(F.col("_nc"), F.greatest(F.lit(1), F.floor(exact))))
    if mode == "largest_remainder":
        short = F.lit(size) - F.sum("_quota").over(Window.partitionBy())
        r = F.row_number().over(Window.orderBy((exact - F.floor(exact)).desc(), F.col(label)))
        q = q.withColumn("_quota", F.col("_quota") + F.when(
            (r <= short) & (F.col("_quota") < F.col("_nc")), 1).otherwise(0))
    # the per-class quota table has one row per class: write it once and read
    # the one scalar that decides which plan to build
    q = materialize(q.select(label, "_quota"))
    cols = df.columns
    if mode == "reference":
        total_quota = q.agg(F.sum("_quota")).first()[0] or 0
        if total_quota < size:
            return d.orderBy("_h", key).limit(size).select(*cols)
    ranked = top_per_group(d, label, ["_h", key], size)
    return (ranked.join(broadcast_if_small(q), label)
                  .where(F.col("_rn") <= F.col("_quota")).select(*cols))


def top_per_group(df: DataFrame, group: str, order: list[str], k: int, salts: int = 64) -> DataFrame:
    """Rows ranked 1..k within each group (ascending ``order``), with the rank
    in ``_rn``. Up to spark.sql.optimizer.windowGroupLimitThreshold Spark cuts
    every task to k rows per group before the shuffle. Beyond it the group is
    first split into ``salts`` buckets by an independent hash and ranked per
    (group, bucket), so a group holding a third of all rows is spread over
    many tasks; the union of the buckets' top k holds the group's top k, and
    the final ranking runs on at most k * salts rows per group."""
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    w = Window.partitionBy(group).orderBy(*order)
    if k <= threshold:
        return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts))
    first = (df.withColumn("_salt", salt)
               .withColumn("_rs", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)))
               .where(F.col("_rs") <= k).drop("_salt", "_rs"))
    return first.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
