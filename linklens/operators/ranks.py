"""Exact order statistics by range partitions.

Rows are range partitioned and sorted by (group, value); a row's place in its
partition is its number there, and one row per (group, partition) holds how
many come before that partition. Prefix sums of a weight work the same way.
So no task sees all rows of a group, and no value map of a group is held in
one buffer: what a group gathers is one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linklens.session import broadcast_if_small, materialize


def _sorted_parts(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` sorted, with the number of its partition and its place there."""
    cols = [*by, *order]
    rows = materialize(df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                       .withColumn("_at", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_at", 33))


def _offsets(sums: DataFrame, by: list[str]) -> DataFrame:
    """(_part, by.., _w, ..) with ``_before``, the sum over earlier partitions, and ``_total``."""
    # rows here are (group, partition) pairs
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return (sums.withColumn("_total", F.sum("_w").over(group))
                .withColumn("_before", F.sum("_w").over(group.orderBy("_part")) - F.col("_w")))


def _attach(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    o = materialize(offsets).select(F.col("_part").alias("_o"), *[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)],
                                    *[c for c in offsets.columns if c not in by and c != "_part"])
    same = F.col("_part") == F.col("_o")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(broadcast_if_small(o), same).drop("_o", *[f"_g{i}" for i in range(len(by))])


def with_rank(df: DataFrame, order, by=()) -> DataFrame:
    """``df`` with ``_rank`` (from 0, in ``order`` within each group) and ``_total`` rows of the group."""
    by, order = list(by), [order] if isinstance(order, str) else list(order)
    rows = _sorted_parts(df, by, order)
    sums = rows.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_w"), F.min("_at").alias("_first"))
    out = _attach(rows, _offsets(sums, by), by)
    return (out.withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before"))
               .select(*df.columns, "_rank", "_total"))


def with_prefix_sum(df: DataFrame, weight: str, order, by=()) -> DataFrame:
    """``df`` with ``_before``, the weight of the rows earlier in ``order``, and ``_total``, of
    all rows of the group: a running sum in each partition on top of the partition's offset."""
    by, order = list(by), [order] if isinstance(order, str) else list(order)
    rows = _sorted_parts(df, by, order)
    sums = rows.groupBy("_part", *by).agg(F.sum(weight).alias("_w"))
    inside = F.sum(weight).over(Window.partitionBy("_part", *by).orderBy("_at")) - F.col(weight)
    out = _attach(rows.withColumn("_inside", inside), _offsets(sums, by), by)
    return (out.withColumn("_before", F.col("_before") + F.col("_inside"))
               .select(*df.columns, "_before", "_total"))


def exact_quantiles(df: DataFrame, value: str, quantiles: list[float], names: list[str], by=()) -> DataFrame:
    """Per group the quantiles of the non-null values, with linear interpolation between
    neighbouring ranks; a group without values has no row (without ``by``: one row of nulls)."""
    by = list(by)
    ranked = with_rank(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), "_v", by)
    aggs = []
    for i, q in enumerate(quantiles):
        place = F.lit(float(q)) * (F.col("_total") - 1)
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.max(F.when(F.col("_rank") == at, F.col("_v"))).alias(f"_{side}{i}"))
    out = ranked.groupBy(*by).agg(F.max("_total").alias("_n"), *aggs)
    parts = []
    for i, (q, name) in enumerate(zip(quantiles, names)):
        place = F.lit(float(q)) * (F.col("_n") - 1)
        up = place - F.floor(place)
        parts.append((F.col(f"_lo{i}") * (1 - up) + F.col(f"_hi{i}") * up).alias(name))
    return out.select(*by, *parts)
