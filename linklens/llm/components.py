"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm.steps import Steps


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one smaller neighbour or is the smaller end of all its edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("e"))
    ids = ends.groupBy("e.id").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
    return not ids.agg(F.sum(F.when((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0)), 1))).first()[0]


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """(id, component) of every id in links (a, b); component is its smallest id.

    Each round joins ids to the smallest neighbour found by a partially aggregated
    groupBy, so no id's neighbours are ever gathered in one row. Rounds stop when
    the edges are stars, after about log(n) of them."""
    edges = steps.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u != v").distinct(), "edges")
    while not _stars(edges):
        # large star: larger neighbours move to the smallest of the neighbourhood
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        least = steps.table(least, "least")
        moved = steps.table(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .filter("u != v").distinct(), "large")
        # small star: smaller neighbours and the id itself move to the smallest
        low = moved.groupBy("u").agg(F.min("v").alias("m"))
        small = (moved.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        small = steps.table(small, "small")
        steps.drop(edges, least, moved)
        edges = small
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())
