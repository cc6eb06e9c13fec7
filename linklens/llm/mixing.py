"""Mixing sources to target weights with a hypergeometric splitting tree.

Sources share the words of the whole corpus by weight; a source gives at most
``max_repeat`` times its own words, and what it can't give is shared again by
weight. Each source is cut into blocks of whole documents by a hash of their ids.
A source's quota is exact in blocks: full passes over all of its blocks, then a
prefix of its permuted blocks, and of the last of these the documents in hash
order that come nearest to the quota (a document is never cut).

The block draws are dealt to the output shards down a binary tree: at every node
half of the shards get half of the draws, and which sources these come from is
multivariate hypergeometric, since the node's draws are ranked by a hash and the
first half goes left. Every shard then holds its draws' documents in hash order.

Everything is DataFrame functions. Only counts per block are ever gathered: at
most ``max_blocks`` plus one per source, whatever the corpus; texts don't move
before the final repartition by shard.

Defined cases: a null text has size 0; null is a source of its own, last in
order; sources of size 0 have target 0; documents with equal ids (null too) and
source are taken together or not at all; an empty table gives an empty result;
other input columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens.llm.steps import Steps
from linklens.session import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"


def _hash(name: str, *parts: Column | str) -> Column:
    """md5 hex of a name and the parts, nulls told apart from any text."""
    texts = [F.lit(name)]
    for p in parts:
        c = (F.col(p) if isinstance(p, str) else p).cast("string")
        texts.append(F.coalesce(F.concat(F.lit("="), c), F.lit("")))
    return F.md5(F.concat_ws("|", *texts).cast("binary"))


def _number(hexes: Column) -> Column:
    """60 bits of a hash as a non-negative long."""
    return F.conv(F.substring(hexes, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water level by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = (sources.withColumn("rank", F.row_number().over(order))
            .withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeat))
    # level if this source is the first that stays below its cap
    rows = rows.withColumn("level", (
        F.sum("source_size").over(every)
        - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).cast("double") / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first source in this order that stays below its cap sets the level
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("source", "source_size", F.least(
        F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _in_block(nb: Column) -> tuple[Column, Column]:
    """(block of a document, its place inside the block) from a hash of its id."""
    h = _hash("mix", "doc_id")
    return F.pmod(_number(h), nb).cast("int"), F.substring(h, 16, 17)


class Mixture:
    """Quotas of one corpus: ``sources`` (source, source_size, target, blocks, passes, ...)
    and ``draws`` (source, block, whole, upto, shards)."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3,
                 max_blocks: int = 1 << 15, shard_words: int = 1 << 22, steps: Steps | None = None):
        steps = steps or Steps(docs.sparkSession, "mixing")
        sizes = steps.table(sized(docs), "sizes")
        totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        goal = targets(totals, weights, max_repeat)
        words = F.sum("source_size").over(Window.partitionBy())
        quota = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeat)
        full = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0)
        goal = (goal.withColumn("blocks", F.greatest(F.lit(1), F.ceil(
                    F.col("source_size") * max_blocks / F.greatest(words, F.lit(1)))).cast("int"))
                .withColumn("passes", full.cast("int"))
                .withColumn("rest", quota - F.col("passes") * F.col("source_size"))
                .withColumn("shards", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(
                    F.lit(1.0), words / F.lit(float(shard_words)))))).cast("int")))
        self.sources = steps.table(goal, "sources")
        self.max_shards = self.sources.agg(F.max("shards")).first()[0] or 1

        src = self.sources.select(F.col("source").alias("s_source"), "blocks", "passes", "rest")
        block, place = _in_block(F.col("blocks"))
        placed = (sizes.join(src, F.col("source").eqNullSafe(F.col("s_source")))
                  .select("doc_id", "source", "size", "passes", "rest", block.alias("block"),
                          place.alias("place")))
        per_block = steps.table(placed.groupBy("source", "block").agg(
            F.sum("size").alias("words"), F.first("passes").alias("passes"),
            F.first("rest").alias("rest")), "blocks")
        permuted = Window.partitionBy("source").orderBy(_hash("mixblock", "source", "block"))
        ahead = F.coalesce(F.sum("words").over(
            permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per_block = per_block.withColumn("left", F.col("rest") - ahead)
        per_block = (per_block.withColumn("whole", F.col("left") >= F.col("words"))
                     .withColumn("part", ~F.col("whole") & (F.col("left") > 0)))
        per_block = steps.table(per_block, "quotas")

        # one partly drawn block per source at most: its documents in hash order, as near as they go
        cut = per_block.filter("part").select(F.col("source").alias("c_source"),
                                              F.col("block").alias("c_block"), "left")
        inside = Window.partitionBy("source").orderBy("place", "doc_id")
        upto = (placed.join(cut, F.col("source").eqNullSafe(F.col("c_source"))
                            & (F.col("block") == F.col("c_block")))
                .withColumn("sum", F.sum("size").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
                .withColumn("prev", F.col("sum") - F.sum("size").over(inside.rangeBetween(0, 0)))
                .filter((F.col("sum") <= F.col("left")) | (F.col("prev") + F.col("sum") < 2 * F.col("left")))
                .groupBy("source", "block")
                .agg(F.max(F.struct("place", "doc_id")).alias("upto"))
                .select(F.col("source").alias("u_source"), F.col("block").alias("u_block"), "upto"))
        drawn = (per_block.join(upto, F.col("source").eqNullSafe(F.col("u_source"))
                                & (F.col("block") == F.col("u_block")), "left")
                 .select("source", "block", "passes", "whole", "upto"))
        self.draws = self._deal(steps.table(drawn, "drawn"), steps)

    def _deal(self, drawn: DataFrame, steps: Steps) -> DataFrame:
        """Send every draw of a block down the tree to a shard."""
        extra = F.when(F.col("whole") | F.col("upto").isNotNull(), 1).otherwise(0)
        slots = (drawn.withColumn("copies", F.col("passes") + extra).filter("copies > 0")
                 .select("source", "block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")))
        slots = slots.withColumn("node", F.lit(0))
        width, level = self.max_shards, 0
        while width > 1:
            rank = F.row_number().over(Window.partitionBy("node").orderBy(
                _hash(f"mixtree{level}", "source", "block", "copy"), "source", "block", "copy"))
            half = F.count(F.lit(1)).over(Window.partitionBy("node")) / 2
            slots = slots.withColumn("node", F.col("node") * 2 + F.when(rank <= half, 0).otherwise(1))
            width, level = width // 2, level + 1
        shards = (slots.groupBy("source", "block")
                  .agg(F.sort_array(F.collect_list(F.struct("copy", "node"))).alias("at"))
                  .select(F.col("source").alias("d_source"), F.col("block").alias("d_block"),
                          F.col("at.node").alias("shards")))
        return steps.table(
            drawn.join(shards, F.col("source").eqNullSafe(F.col("d_source"))
                       & (F.col("block") == F.col("d_block")), "left")
            .select("source", "block", "passes", "whole", "upto",
                    F.coalesce("shards", F.array().cast("array<int>")).alias("shards")), "draws")

    def assign(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, source, ...) with ``draws``, the shards of the copies taken;
        ``source_size`` and ``target`` of their source."""
        src = self.sources.select(F.col("source").alias("s_source"), "blocks", "source_size", "target")
        draws = self.draws.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"),
                                  "passes", "whole", "upto", "shards")
        block, place = _in_block(F.col("blocks"))
        # bounded tables: one row per source, and one per block; beyond the size check they shuffle
        out = (rows.join(broadcast_if_small(src), F.col("source").eqNullSafe(F.col("s_source")))
               .withColumn("block", block).withColumn("place", place)
               .join(broadcast_if_small(draws), F.col("source").eqNullSafe(F.col("b_source"))
                     & (F.col("block") == F.col("b_block"))))
        last = F.col("whole") | F.coalesce(
            F.struct("place", "doc_id") <= F.col("upto"), F.lit(False))
        return (out.withColumn("draws", F.slice("shards", 1, F.col("passes") + F.when(last, 1).otherwise(0)))
                .drop("s_source", "blocks", "block", "place", "b_source", "b_block", "passes", "whole",
                      "upto", "shards"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every taken copy of every document, with the input's columns,
    dealt to the shards and in hash order inside each."""
    mixture = Mixture(docs, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("source"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    copies = mixture.assign(rows).select("row", F.posexplode("draws").alias("copy", "shard"))
    return (copies.repartition("shard")
            .sortWithinPartitions("shard", _hash("mixorder", F.col("row.doc_id"), F.col("copy")))
            .select("row.*"))


def op2_source_mixing(docs: DataFrame) -> DataFrame:
    """The contract's digest: what the mix takes of every document."""
    mixture = Mixture(docs)
    return (mixture.assign(sized(docs))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.size("draws")).alias("taken")))


# One engine's SQL for the same rows: sizes, water level, hashed blocks, exact quotas.
OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id::BIGINT AS doc_id, source::VARCHAR AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', 'mix', coalesce('=' || doc_id::VARCHAR, ''))) AS h
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM totals),
weighted AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS words
  FROM ranked),
levels AS (
  SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
goal AS (
  SELECT source, source_size, words,
         least(cap::DOUBLE, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (
           ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
           * weight) AS target
  FROM levels),
quota AS (
  SELECT *, least(round(target)::BIGINT, 3 * source_size) AS q,
         greatest(1, ceil(source_size * 32768 / greatest(words, 1)))::INT AS blocks
  FROM goal),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN q // source_size ELSE 0 END AS passes FROM quota),
placed AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.passes,
         p.q - p.passes * p.source_size AS rest,
         ('0x' || substr(h, 1, 15))::BIGINT % p.blocks AS block, substr(h, 16, 17) AS place
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
blocks AS (
  SELECT source, block, sum(size) AS words, any_value(rest) AS rest FROM placed GROUP BY source, block),
quotas AS (
  SELECT *, rest - coalesce(sum(words) OVER (PARTITION BY source
             ORDER BY md5(concat_ws('|', 'mixblock', coalesce('=' || source, ''), '=' || block::VARCHAR))
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM blocks),
sums AS (
  SELECT p.*, q.words, q.room,
         sum(p.size) OVER (PARTITION BY p.source, p.block ORDER BY p.place, p.doc_id
                           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(p.size) OVER (PARTITION BY p.source, p.block, p.place, p.doc_id) AS peers
  FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source AND p.block = q.block)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN room >= words OR (room > 0 AND (upto <= room OR 2 * upto - peers < 2 * room)) THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM sums
"""
