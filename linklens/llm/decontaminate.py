"""Benchmark decontamination over a distributed positional inverted index.

A test item is cut into windows of ``window`` consecutive words. The index holds
the postings (term, document, position) of the training text for the terms that
the search needs: the ``rarest`` terms of every window, by their counts over the
whole corpus. A search starts from the postings of a window's rarest term; each
posting says where the window would begin. The lists of its next rarest terms
are intersected after subtracting their offsets in the window, and what is left
is compared word by word with the document. Windows with a term that the corpus
lacks are out at once.

Everything is DataFrame functions. Postings go to the search by equi-joins, so a
hot term is split by adaptive execution; the test side is broadcast only below a
checked size. Candidates are gathered per document (at most one per window and
place), never per term.

Defined cases: a null or empty text has no words and no hits; an item without
words has no windows, one with fewer words than a window is a window; a null
item id reads as an empty string; repeated rows and null ids keep their own
texts (rows are known by id and text hash); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.steps import Steps
from linklens.session import broadcast_if_small

# runs of the contract's word characters before and after A-Z are lower-cased are the same runs
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def raw_words(text: Column) -> Column:
    # split at the gaps: regexp_extract_all copies the text for every match
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def exact(words: Column) -> Column:
    """The words with A-Z lower-cased and nothing else."""
    return F.transform(words, lambda w: F.translate(w, UPPER, UPPER.lower()))


def training(docs: DataFrame) -> DataFrame:
    """(doc_id, th, words) of the training documents, words as written. The index compares
    terms in full lower case, which is coarser and quicker; matches are confirmed exactly."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.hash(F.coalesce("text", F.lit(""))).alias("th"),
                       raw_words(F.col("text")).alias("words"))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, no, words): different windows of every item with words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             exact(raw_words(F.col("text"))).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    return (items.select("item_id", "all", F.explode(starts).alias("no"))
            .select("item_id", F.slice("all", F.col("no") + 1, window).alias("words"))
            .distinct().withColumn("no", F.xxhash64("item_id", "words")))


class PositionalIndex:
    """Postings of a corpus for the rarest terms of given windows."""

    def __init__(self, docs: DataFrame, windows: DataFrame, window: int = 13, rarest: int = 3,
                 steps: Steps | None = None):
        self.window = window
        self.steps = steps or Steps(docs.sparkSession, "postings")
        table = self.steps.table
        terms = table(windows.select(F.explode("words").alias("term"))
                      .select(F.lower("term").alias("term")).distinct(), "terms")
        found = (docs.transform(training).select(F.explode("words").alias("term"))
                 .select(F.lower("term").alias("term")).join(broadcast_if_small(terms), "term"))
        counts = table(found.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")

        # terms of each window, rarest first, with their offset (the first, if repeated)
        placed = (windows.select("item_id", "no", "words", F.posexplode("words").alias("at", "term"))
                  .withColumn("term", F.lower("term")).join(counts, "term", "left"))
        ranked = (placed.groupBy("item_id", "no", "words")
                  .agg(F.sort_array(F.collect_list(F.struct("n", "term", "at"))).alias("order"))
                  .filter(F.col("order")[0]["n"].isNotNull()))
        distinct = F.filter("order", lambda x, i: (i == 0) | (
            x["term"] != F.col("order")[F.greatest(i - 1, F.lit(0))]["term"]))
        self.windows = table(ranked.select("item_id", "no", "words",
                                           F.slice(distinct, 1, rarest).alias("rare")), "windows")
        wanted = table(self.windows.select(F.explode("rare.term").alias("term")).distinct(), "wanted")
        self.postings = table(
            docs.transform(training).select("doc_id", "th", F.posexplode("words").alias("pos", "term"))
            .withColumn("term", F.lower("term")).join(broadcast_if_small(wanted), "term"), "postings")
        self.rarest = rarest

    def candidates(self) -> DataFrame:
        """(doc_id, th, item_id, no, words, start): places where all rare terms of a window stand."""
        first = self.windows.withColumn("term", F.col("rare")[0]["term"])
        rows = (self.postings.join(broadcast_if_small(first), "term")
                .withColumn("start", F.col("pos") - F.col("rare")[0]["at"]).filter("start >= 0")
                .drop("term", "pos"))
        lists = self.postings.select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"),
                                     F.col("term").alias("p_term"), F.col("pos").alias("p_pos"))
        for i in range(1, self.rarest):
            nxt = F.try_element_at("rare", F.lit(i + 1))
            at = rows.withColumn("t", nxt["term"]).withColumn("p", F.col("start") + nxt["at"])
            short = at.filter("t IS NULL")
            met = at.filter("t IS NOT NULL").join(
                lists, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th"))
                & (F.col("t") == F.col("p_term")) & (F.col("p") == F.col("p_pos")), "left_semi")
            rows = met.unionByName(short).drop("t", "p")
        # repeated rows have the same postings twice
        return rows.drop("rare").distinct()

    def proximity(self, slop: int) -> DataFrame:
        """(doc_id, item_id, no, start, end): places where the rare terms of a window stand in
        any order within its length plus ``slop`` words."""
        first = self.windows.withColumn("term", F.col("rare")[0]["term"])
        reach = F.size("words") + slop
        rows = (self.postings.join(broadcast_if_small(first), "term")
                .select("doc_id", "th", "item_id", "no", "rare", reach.alias("reach"),
                        F.col("pos").alias("start"), F.col("pos").alias("end")))
        for i in range(1, self.rarest):
            nxt = F.try_element_at("rare", F.lit(i + 1))["term"]
            at = rows.withColumn("t", nxt)
            short = at.filter("t IS NULL")
            # positions are compared within cells as wide as the longest reach and their neighbours
            width = self.window + slop
            cell = F.floor(F.col("start") / width)
            near = at.filter("t IS NOT NULL").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
            lists = self.postings.select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"),
                                         F.col("term").alias("p_term"), F.col("pos").alias("p_pos"),
                                         F.floor(F.col("pos") / width).alias("p_cell"))
            met = near.join(lists, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th"))
                            & (F.col("t") == F.col("p_term")) & (F.col("cell") == F.col("p_cell")))
            met = (met.withColumn("start", F.least("start", "p_pos")).withColumn("end", F.greatest("end", "p_pos"))
                   .filter(F.col("end") - F.col("start") < F.col("reach"))
                   .select("doc_id", "th", "item_id", "no", "rare", "reach", "t", "start", "end"))
            rows = met.unionByName(short).drop("t").distinct()
        return rows.select("doc_id", "item_id", "no", "start", "end").distinct()


def phrase_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Every document with ``row`` (its columns), n_words and ``hits``, the exact occurrences
    of item windows as structs (item_id, start, length)."""
    steps = Steps(docs.sparkSession, "phrases")
    windows = steps.table(item_windows(benchmark, window), "items")
    index = PositionalIndex(docs, windows, window, steps=steps)
    places = steps.table(
        index.candidates().groupBy("doc_id", "th")
        .agg(F.collect_list(F.struct("item_id", "words", "start")).alias("places"))
        .select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "places"), "places")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       F.hash(F.coalesce(docs["text"], F.lit(""))).alias("th"),
                       raw_words(docs["text"]).alias("words"))
    joined = rows.join(broadcast_if_small(places), F.col("doc_id").eqNullSafe(F.col("c_id"))
                       & (F.col("th") == F.col("c_th")), "left")
    real = F.filter("places", lambda c: exact(F.slice(
        F.col("all"), c["start"] + 1, F.size(c["words"]))) == c["words"])
    hits = F.transform(real, lambda c: F.struct(
        c["item_id"].alias("item_id"), c["start"].alias("start"), F.size(c["words"]).alias("length")))
    return (joined.withColumnRenamed("words", "all")
            .select("row", F.size("all").cast("long").alias("n_words"),
                    F.coalesce(hits, F.array().cast("array<struct<item_id:string,start:int,length:int>>"))
                    .alias("hits")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(row, n_words, n_hit, items, contaminated): words inside hits, and the items found."""
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(
        h["start"], h["start"] + h["length"] - 1))))
    n_hit = F.size(covered).cast("long")
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return (phrase_hits(docs, benchmark, window)
            .withColumn("n_hit", n_hit).withColumn("items", items)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
            .drop("hits"))


def op10_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of the 13-word contamination."""
    return (contamination(docs.select("doc_id", "text"), benchmark)
            .select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit",
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                    "contaminated"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT l FROM windows),
grams AS (
  SELECT r, s, l, array_to_string(w[s:s + l - 1], ' ') AS g
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lengths WHERE len(w) >= l)),
hits AS (SELECT r, s, grams.l, item_id FROM grams JOIN windows USING (l, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(s, s + l)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
