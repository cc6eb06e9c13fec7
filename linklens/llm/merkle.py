"""Merkle manifest of a table with pointer-jumping proofs.

Each row is a leaf; the leaves of a source, in ascending doc_id order, are hashed
in runs of three up to the source's subroot, and the subroots, in source order,
likewise up to the root.

``positions`` numbers the leaves without gathering a source: rows are range
partitioned and sorted, and the counts of each (source, partition) give the
offsets. ``climb`` hashes three levels in one shuffle, in groups of at most 27
nodes. A node's pointer is (ancestor, segment): the siblings met on the way to it,
first those of its own run. Joining the pointers to themselves doubles the
ancestor distance and concatenates the segments; a round keeps only the nodes that
a leaf can land on, and the rounds end when every leaf points at the root.

Digests are 32 bytes in the tables and lower-case hex text where they are hashed.

Defined cases: a null field is ``-``; rows without a source form a tree of their
own, which comes first; null ids come first in their source and are never tampered
with; rows with one id are ordered by their leaf (so equal rows are interchangeable);
an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linklens.llm.steps import Steps
from linklens.session import broadcast_if_small

FAN = 3                     # nodes of a run
STRIDE = 3                  # levels that one step climbs
BROADCAST_BYTES = 16 << 20
TOP = "^"                   # the tree of the subroots; the others' names are "" or begin with "="
_POWERS = ",".join(f"{FAN ** k}L" for k in range(40))


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return _digest(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))))


def _depth(n: str) -> Column:
    """Levels above n leaves; n names a column."""
    return F.expr(f"size(filter(array({_POWERS}), x -> x < {n}))")


def positions(rows: DataFrame, order: list[str], steps: Steps) -> DataFrame:
    """``rows`` with pos (from 0, in ``order`` within each src) and n, the rows of the src.

    Offsets are one row per (src, range partition); a hot src has one per partition."""
    cols = ["src", *order]
    at = steps.table(rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
                     .withColumn("at", F.monotonically_increasing_id()), "sorted")
    at = (at.withColumn("part", F.shiftright("at", 33))
          .withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))))
    mine = Window.partitionBy("src")
    offsets = steps.table(
        at.groupBy("src", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
        .select("src", "part", "first", F.sum("c").over(mine).alias("n"),
                (F.sum("c").over(mine.orderBy("part")) - F.col("c")).alias("before")), "offsets")
    return (at.join(broadcast_if_small(offsets, BROADCAST_BYTES), ["src", "part"])
            .withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
            .drop("at", "part", "first", "before"))


def _above(nodes: Column, n: Column) -> Column:
    """Parents of a group's nodes; null where its level is the last."""
    def one(i: Column) -> Column:
        return _digest(F.array_join(F.transform(F.slice(nodes, i * FAN + 1, F.lit(FAN)), _hex), ""))
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), one))


def _up(n: Column) -> Column:
    return F.floor((n + (FAN - 1)) / FAN).cast("long")


def climb(leaves: DataFrame, steps: Steps) -> list[tuple[int, DataFrame]]:
    """(level, groups) per step over leaves (src, pos, n, h, payload).

    A row of groups (src, g, n, items, a0, a1, a2, a3) holds the nodes of up to 27 places of a
    level and their ancestors three levels up; n counts the level's nodes."""
    out, level = [], 0
    nodes = leaves
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 0:
        width = FAN ** STRIDE
        packed = (nodes.groupBy("src", "n", F.floor(F.col("pos") / width).cast("long").alias("g"))
                  .agg(F.sort_array(F.collect_list(F.struct("pos", "h", "payload"))).alias("items"))
                  .withColumn("a0", F.col("items.h")))
        n = F.col("n")
        for k in range(STRIDE):
            packed = packed.withColumn(f"a{k + 1}", _above(F.col(f"a{k}"), n))
            n = _up(n)
        packed = steps.table(packed, "groups")
        out.append((level, packed))
        level += STRIDE
        for _ in range(STRIDE):
            most = -(-most // FAN)
        nodes = packed.filter(n > 1).select("src", F.col("g").alias("pos"), n.alias("n"),
                                            F.col(f"a{STRIDE}")[0].alias("h"), F.lit(None).alias("payload"))
        if most <= 1:
            break
    return out


def tops(groups: list[tuple[int, DataFrame]]) -> DataFrame:
    """(src, h) of the last node of each tree."""
    found = None
    for _, packed in groups:
        n, h = F.col("n"), None
        for k in range(STRIDE + 1):
            here = F.when(n == 1, F.col(f"a{k}")[0])
            h = here if h is None else F.coalesce(h, here)
            n = _up(n)
        one = packed.filter("g = 0").select("src", h.alias("h")).filter("h IS NOT NULL")
        found = one if found is None else found.unionByName(one)
    return found


def _segment(nodes: Column, j: Column) -> Column:
    """The digests of j's run without its own."""
    run = F.slice(nodes, F.floor(j / FAN).cast("int") * FAN + 1, F.lit(FAN))
    others = F.filter(run, lambda _, i: i != j % FAN)
    return F.aggregate(others, F.lit(b""), lambda a, x: F.concat(a, x))


def _pointers(level: int, packed: DataFrame, k: int, *extra: Column) -> DataFrame:
    """(src, level, pos, n, a_src, a_level, a_pos, seg): each node of level + k, its parent
    and the siblings; the last node of a tree has none and a null parent."""
    n = F.col("n")
    for _ in range(k):
        n = _up(n)
    j = F.col("j")
    last = n == 1
    pos = F.col("g") * (FAN ** (STRIDE - k)) + j
    return (packed.filter(F.col(f"a{k}").isNotNull())
            .select("*", F.explode(F.sequence(F.lit(0), F.size(f"a{k}") - 1)).alias("j"))
            .select("src", F.lit(level + k).alias("level"), pos.alias("pos"), n.alias("n"),
                    F.when(~last, F.col("src")).alias("a_src"),
                    F.when(~last, F.lit(level + k + 1)).alias("a_level"),
                    F.when(~last, F.floor(pos / FAN).cast("long")).alias("a_pos"),
                    _segment(F.col(f"a{k}"), j).alias("seg"), *extra))


def _inner(groups: list[tuple[int, DataFrame]], lowest: int) -> DataFrame | None:
    """Pointers of all nodes from ``lowest`` up, but for the last of each tree."""
    found = None
    for level, packed in groups:
        for k in range(STRIDE):
            if level + k >= lowest:
                one = _pointers(level, packed, k).filter("a_src IS NOT NULL").drop("n")
                found = one if found is None else found.unionByName(one)
    return found


def _jump(rows: DataFrame, pointers: DataFrame) -> DataFrame:
    """Rows moved to their ancestor's ancestor, segments concatenated."""
    to = pointers.select(*[F.col(c).alias(f"to_{c}") for c in ("src", "level", "pos", "a_src", "a_level", "a_pos", "seg")])
    same = ((F.col("a_src") == F.col("to_src")) & (F.col("a_level") == F.col("to_level"))
            & (F.col("a_pos") == F.col("to_pos")))
    moved = rows.join(broadcast_if_small(to, BROADCAST_BYTES), same, "left")
    new = {c: F.coalesce(f"to_{c}", c) for c in ("a_src", "a_level", "a_pos")}
    new["seg"] = F.concat("seg", F.coalesce("to_seg", F.lit(b"")))
    return moved.withColumns(new).drop(*to.columns)


def _fold(h: Column, proof: Column, trees: list[tuple[str, str]]) -> Column:
    """The root from a leaf's hex digest and its proof, by the columns (position, size)
    of each tree on the way."""
    state = F.struct(h.alias("h"), F.lit(0).alias("used"))
    for place, size_name in trees:
        size = F.col(size_name)
        start = F.struct(state["h"].alias("h"), state["used"].alias("used"),
                         F.col(place).alias("p"), size.alias("m"))

        def step(s: Column, _: Column) -> Column:
            r = (s["p"] % FAN).cast("int")
            run = F.least(F.lit(FAN).cast("long"), s["m"] - (s["p"] - r)).cast("int")
            left = F.substr(proof, s["used"] * 64 + 1, r * 64)
            right = F.substr(proof, (s["used"] + r) * 64 + 1, (run - 1 - r) * 64)
            return F.struct(F.sha2(F.concat(left, s["h"], right), 256).alias("h"),
                            (s["used"] + run - 1).alias("used"),
                            F.floor(s["p"] / FAN).cast("long").alias("p"), _up(s["m"]).alias("m"))

        levels = F.when(size > 1, F.sequence(F.lit(1), _depth(size_name))).otherwise(F.array().cast("array<int>"))
        state = F.aggregate(levels, start, step)
    return state["h"]


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, src, leaf, tampered, subroot, root, proof, pos, n, top_pos, top_n): per
    document its leaf and that of its tampered text, and the siblings up to the root as one
    hex text, left to right and level by level. ``src`` is empty for rows without a source,
    and otherwise ``=`` and the source."""
    spark = docs.sparkSession
    steps = Steps(spark, "merkle")
    doc_id = docs["doc_id"].cast("long")
    fields = doc_id, docs["source"], docs["lang"], docs["n_chars"]
    cut = F.crc32(doc_id.cast("string")) % 2 == 0
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("")).alias("src"), doc_id.alias("doc_id"),
        leaf_digest(*fields, docs["text"]).alias("h"),
        F.when(cut, leaf_digest(*fields, F.replace(docs["text"], F.lit("\n"), F.lit("")))).alias("t"))
    leaves = positions(steps.table(leaves, "leaves"), ["doc_id", "h"], steps)
    groups = climb(leaves.select("src", "pos", "n", "h", F.struct("doc_id", "t").alias("payload")), steps)
    if not groups:
        empty = ("doc_id long, src string, leaf string, tampered string, subroot string, root string, proof string, "
                 "pos long, n long, top_pos long, top_n long")
        return spark.createDataFrame([], empty)
    subroots = steps.table(positions(
        tops(groups).select(F.lit(TOP).alias("src"), F.col("src").alias("payload"), "h"), ["payload"], steps),
        "subroots")
    above = climb(subroots, steps)
    root = bytes(tops(above).first()["h"])

    # a tree's last node is a leaf of the tree of subroots
    joint = subroots.select(F.col("payload").alias("src"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"),
                            F.col("h").alias("sub"))
    joint = broadcast_if_small(joint, BROADCAST_BYTES)

    def linked(rows: DataFrame, top_level: Column) -> DataFrame:
        """Pointers at a subroot turned to its leaf in the tree above."""
        at_top = (F.col("a_src").isNull() | (F.col("a_level") == top_level))
        return rows.join(joint, "src").withColumns({
            "a_src": F.when(at_top, F.lit(TOP)).otherwise(F.col("a_src")),
            "a_pos": F.when(at_top, F.col("top_pos")).otherwise(F.col("a_pos")),
            "a_level": F.when(at_top, F.lit(0)).otherwise(F.col("a_level"))})

    level0, first = groups[0]
    leaf = _pointers(level0, first, 0, F.col("items")[F.col("j")]["h"].alias("h"),
                     F.col("items")[F.col("j")]["payload"].alias("payload"))
    leaf = linked(leaf, _depth("n"))
    high = _inner(above, 0).withColumn("tree", F.lit(True))
    sizes = leaves.select("src", "n").distinct()
    inner = _inner(groups, 1)
    below = linked(inner.join(broadcast_if_small(steps.table(sizes, "sizes"), BROADCAST_BYTES), "src"),
                   _depth("n"))
    pointers = steps.table(high.unionByName(below.select(*inner.columns).withColumn("tree", F.lit(False))), "pointers")

    def most(groups: list[tuple[int, DataFrame]]) -> int:
        return groups[0][1].agg(F.max(_depth("n"))).first()[0]

    # a lone leaf starts at its subroot, one step behind the others
    deepest = max(most(groups), 1) + most(above)
    distance = 1
    while distance < deepest:
        leaf = _jump(leaf, pointers)
        distance *= 2
        if distance < deepest:
            # a leaf lands on levels that the distance divides; trees differ in height below the top one
            kept = pointers.filter(F.col("tree") | (F.col("level") % distance == 0))
            pointers = steps.table(_jump(kept, pointers), "pointers")
    return leaf.select(
        F.col("payload.doc_id").alias("doc_id"), "src", _hex(F.col("h")).alias("leaf"),
        _hex(F.coalesce("payload.t", "h")).alias("tampered"), _hex(F.col("sub")).alias("subroot"),
        F.lit(root.hex()).alias("root"), _hex(F.col("seg")).alias("proof"), "pos", "n", "top_pos", "top_n")


def op12_merkle_manifest(docs: DataFrame) -> DataFrame:
    """The contract's digest: proofs by their hash, and the root folded from each
    document's tampered leaf, else its own, and its proof."""
    rows = manifest(docs)
    folded = _fold(F.col("tampered"), F.col("proof"),
                   [("pos", "n"), ("top_pos", "top_n")])
    return (rows.withColumn("folded_root", folded)
            .select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


# The trees level by level; crc32 bit by bit over the digits of doc_id.
OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(
             list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
             lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT) % 2 = 0
           THEN replace(text, chr(10), '') ELSE text END AS cut
  FROM documents),
pre AS (
  SELECT doc_id, source, text, cut,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM d),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, h AS leaf, t,
         row_number() OVER (PARTITION BY coalesce('=' || source, '') ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
         count(*) OVER (PARTITION BY coalesce('=' || source, '')) AS n
  FROM (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
               sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS t FROM pre)),
nodes(src, level, pos, n, h) AS (
  SELECT src, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT src, any_value(level) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY src, pos // 3),
subs AS (
  SELECT src, h, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subs
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY pos // 3),
runs AS (
  SELECT src, level, pos // 3 AS run, list(h ORDER BY pos) AS hs
  FROM (SELECT src, level, pos, n, h FROM nodes UNION ALL SELECT '^', level, pos, n, h FROM tops)
  WHERE n > 1 GROUP BY ALL),
low(src, pos, level, p, h, proof) AS (
  SELECT src, pos, 0, pos, t, '' FROM leaves
  UNION ALL
  SELECT f.src, f.pos, f.level + 1, f.p // 3,
         sha256(array_to_string(list_transform(hs, lambda x, i: CASE WHEN i = f.p % 3 + 1 THEN f.h ELSE x END), '')),
         f.proof || array_to_string(list_filter(hs, lambda x, i: i <> f.p % 3 + 1), '')
  FROM low f JOIN runs r ON r.src = f.src AND r.level = f.level AND r.run = f.p // 3),
high(src, pos, level, p, h, proof) AS (
  SELECT l.src, l.pos, 0, s.pos, l.h, l.proof
  FROM (SELECT src, pos, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM low GROUP BY src, pos) l
  JOIN subs s ON s.src = l.src
  UNION ALL
  SELECT f.src, f.pos, f.level + 1, f.p // 3,
         sha256(array_to_string(list_transform(hs, lambda x, i: CASE WHEN i = f.p % 3 + 1 THEN f.h ELSE x END), '')),
         f.proof || array_to_string(list_filter(hs, lambda x, i: i <> f.p % 3 + 1), '')
  FROM high f JOIN runs r ON r.src = '^' AND r.level = f.level AND r.run = f.p // 3),
folded AS (SELECT src, pos, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM high GROUP BY src, pos)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN folded f USING (src, pos) JOIN subs s ON s.src = l.src JOIN tops t ON t.n = 1
"""
