"""Spelling variant grouping with a bit-sliced position index.

The vocabulary is counted over all whole texts (``vocabulary``). Two words are near
if they differ by exactly one inserted, deleted or replaced code point.

The index of a block of words of one length has, per (position, letter), a bitset of
the words with that letter there. For a query word, a recurrence over its letters
keeps two bitsets at a time, each one word of 64 vocabulary entries per operation:
the words that agree so far (zero errors) and those one error away. The error's kind
follows from the lengths: replaced (equal lengths, no shift), left out of the query
(the block's words are one longer, positions shift up) or too much in it (one
shorter, positions shift down). Queries run through a block in batches.

Only words that can be near meet. The error of a near pair lies in one half of the
shorter word, so the pair shares the first or the last half (rounded down) of either
word. Index words are dealt by (side, length, hash of that half), and a query looks up
its three possible lengths on both sides. A tile with more words than a block holds,
as a frequent beginning makes, is split, and its queries go to every part; longer
words make smaller blocks, so an index stays within some megabytes. A pair counts at
the side it shares first, so it counts once.

``roots`` follows forms by pointer jumping: n at least doubles from a word to its form,
so chains end and rounds are few.

Defined cases: null texts have no words; a null doc_id counts as an empty string where
runs are dropped a letter; a text may be one very long run; repeated rows count each;
ties go to the smallest word; empty tables have no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm.steps import Steps
from linklens.session import broadcast_if_small

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FLUSH = 400_000            # words a counting task holds before it hands them on
BLOCK_WORDS = 4096         # words of an index
BLOCK_LETTERS = 1 << 19    # letters of an index, so that long words make small ones
BATCH_CELLS = 1 << 15      # 64-word cells of one operation


def typos(doc_id: str, run: str, one_in: int) -> str:
    """The run, less one code point for one in ``one_in`` (document, run)."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, one_in: int = 97) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points and ``min_count`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_buffer()
                if raw is None or not raw.size:
                    continue
                mine = Counter(RUN.findall(raw.to_pybytes().translate(LOWER).decode()))
                for word, n in mine.items():
                    word = typos(doc_id, word, one_in)
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")).alias("doc_id"),
                       docs["text"].alias("text"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


class Index:
    """Bit-sliced positions of words of one length: a bitset per (position, letter)."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), self.length)
        self.cells = -(-len(words) // 64)
        place = np.arange(self.length, dtype=np.int64)
        slot = (place << 32) | code.astype(np.int64)
        self.slots, row = np.unique(slot, return_inverse=True)
        row = row.reshape(slot.shape)
        # the last row is the empty set, for letters that no word has at a place
        self.bits = np.zeros((len(self.slots) + 1, self.cells), dtype=np.uint64)
        at = np.arange(len(words))
        bit = np.uint64(1) << (at % 64).astype(np.uint64)
        for p in range(self.length):
            np.bitwise_or.at(self.bits, (row[:, p], at // 64), bit)
        self.all = np.full(self.cells, ~np.uint64(0))
        if len(words) % 64:
            self.all[-1] = (np.uint64(1) << np.uint64(len(words) % 64)) - np.uint64(1)

    def _have(self, place: int, code: np.ndarray) -> np.ndarray:
        """Bitsets of the words with each query's letter at a place."""
        if not 0 <= place < self.length:
            return np.zeros((len(code), self.cells), dtype=np.uint64)
        slot = (np.int64(place) << 32) | code
        row = np.searchsorted(self.slots, slot)
        row[row == len(self.slots)] = 0
        row = np.where(self.slots[row] == slot, row, len(self.slots))
        return self.bits[row]

    def near(self, queries: list[str]) -> Iterator[tuple[int, int]]:
        """(query, word) that are one error apart, for queries of one length."""
        m = len(queries[0])
        code = np.frombuffer("".join(queries).encode("utf-32-le"), dtype="<u4").reshape(len(queries), m).astype(np.int64)
        shift = self.length - m
        zero = np.broadcast_to(self.all, (len(queries), self.cells)).copy()
        one = np.zeros_like(zero)
        for j in range(m):
            same = self._have(j, code[:, j])
            if shift == 0:       # replaced: later letters stand at their own place
                one = (one & same) | (zero & ~same)
            elif shift == 1:     # a letter of the word is not in the query: one place on
                one = (one | zero) & self._have(j + 1, code[:, j])
            else:                # a letter of the query is not in the word: one place back
                one = (one & self._have(j - 1, code[:, j])) | zero
            zero &= same
            if not one.any() and not zero.any():
                return
        if shift == 1:           # the last letter of the word is left
            one |= zero
        query, cell = np.nonzero(one)
        for q, c in zip(query.tolist(), cell.tolist()):
            left = int(one[q, c])
            while left:
                low = left & -left
                yield q, 64 * c + low.bit_length() - 1
                left ^= low


def _matches(rows: DataFrame) -> DataFrame:
    """(word, n_near, best): per query and block, how many words are near and the first of
    them by (-n, word), from rows (side, length, tile, part, query, word, n) of a block's words
    and, after them, its queries."""

    def pairs(index: Index, counts: list[int], side: int, asked: list[str]) -> Iterator[tuple[str, int, int, str]]:
        half = index.length // 2
        found: dict[str, list] = {}
        for q, w in index.near(asked):
            mine, other = asked[q], index.words[w]
            begins = mine[:half] == other[:half]
            # what meets by chance in a tile belongs to another one; shared beginnings go first
            if not (begins if side == 0 else not begins and mine[-half:] == other[-half:]):
                continue
            key = (-counts[w], other)
            if mine not in found:
                found[mine] = [1, key]
            else:
                found[mine][0] += 1
                found[mine][1] = min(found[mine][1], key)
        for word, (n, (less, other)) in found.items():
            yield word, n, -less, other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, counts, index = None, [], [], None
        asked: list[str] = []

        def search() -> Iterator[pa.RecordBatch]:
            nonlocal index
            if not asked or not words:
                asked.clear()
                return
            if index is None:
                index = Index(words)
            out = list(pairs(index, counts, block[0], asked))
            asked.clear()
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()),
                     pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.string())],
                    names=["word", "n_near", "near_n", "near"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(7)]
            for side, length, tile, part, query, word, n in zip(*cols):
                if (side, length, tile, part) != block:
                    yield from search()
                    block, words, counts, index = (side, length, tile, part), [], [], None
                if not query:
                    words.append(word)
                    counts.append(n)
                    continue
                width = max(1, BATCH_CELLS // (len(words) // 64 + 1))
                if asked and (len(asked) >= width or len(asked[0]) != len(word)):
                    yield from search()
                asked.append(word)
        yield from search()

    keys = ["side", "length", "tile", "part"]
    return (rows.repartition(*keys).sortWithinPartitions(*keys, "query", F.length("word"))
            .select(*keys, "query", "word", "n")
            .mapInArrow(run, "word string, n_near long, near_n long, near string"))


def _half(side: str, length: str) -> str:
    """The half of a word that a word of ``length`` shares with it at a side."""
    return f"if({side} = 0, substr(word, 1, {length} div 2), substr(word, -({length} div 2)))"


def neighbours(words: DataFrame, steps: Steps, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, near, near_n) of the words (word, n) that have near words: how many, and
    the one of the largest n, by ties the smallest."""
    words = words.withColumn("size", F.length("word"))
    limit = F.expr(f"greatest(1, least({block_words}, {BLOCK_LETTERS} div length))")
    lengths = words.groupBy(F.col("size").alias("length")).agg(F.count(F.lit(1)).alias("c"))
    lengths = steps.table(lengths.withColumn("tiles", F.ceil(F.col("c") / limit)), "lengths")
    lengths = broadcast_if_small(lengths)
    tile = f"pmod(xxhash64(length, {_half('side', 'length')}), tiles)"
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    entry = (words.select("word", "n", F.col("size").alias("length"), sides).join(lengths, "length")
             .withColumn("tile", F.expr(tile)))
    entry = steps.table(entry.select("side", "length", "tile", "word", "n"), "entries")
    parts = (entry.groupBy("side", "length", "tile").agg(F.count(F.lit(1)).alias("c"))
             .withColumn("parts", F.ceil(F.col("c") / limit)).drop("c"))
    parts = broadcast_if_small(steps.table(parts, "parts"))
    entry = (entry.join(parts, ["side", "length", "tile"])
             .withColumn("part", F.expr("pmod(xxhash64(word, 7), parts)")).withColumn("query", F.lit(False)))
    asked = (words.select("word", F.explode(F.expr("array(size - 1, size, size + 1)")).alias("length"))
             .select("*", sides).join(lengths, "length").withColumn("tile", F.expr(tile))
             .join(parts, ["side", "length", "tile"])
             .select("side", "length", "tile", "word", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"),
                     F.lit(0).cast("long").alias("n"), F.lit(True).alias("query")))
    cols = ["side", "length", "tile", "part", "query", "word", "n"]
    met = _matches(entry.select(*cols).unionByName(asked.select(*cols)))
    return (met.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
            .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")))


def roots(forms: DataFrame, steps: Steps) -> DataFrame:
    """(word, root): where following the forms (word, form) ends, for words that have one."""
    now = steps.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(broadcast_if_small(on), "root", "left")
        moved = steps.table(moved.select("word", F.coalesce("next", "root").alias("root"),
                                         F.col("next").isNotNull().alias("moved")), "roots")
        if not moved.filter("moved").limit(1).count():
            return moved.select("word", "root")
        steps.drop(now)
        now = moved.select("word", "root")
        now._step_path = moved._step_path


def variants(docs: DataFrame, factor: int = 2, min_length: int = 5, min_count: int = 3, one_in: int = 97,
             block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its most frequent near word, if
    that has at least ``factor`` times its occurrences."""
    steps = Steps(docs.sparkSession, "spelling")
    words = steps.table(vocabulary(docs, min_length, min_count, one_in), "words")
    near = steps.table(words.join(neighbours(words, steps, block_words), "word", "left")
                       .withColumn("more", F.coalesce(F.col("near_n") >= factor * F.col("n"), F.lit(False)))
                       .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(F.col("more"), F.col("near")).alias("form"),
                               F.when(F.col("more"), F.col("near_n")).alias("form_n")), "near")
    ends = roots(near.filter("form IS NOT NULL"), steps)
    return (near.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op13_spelling_variants(docs: DataFrame) -> DataFrame:
    """The contract's digest: words of 5 code points, 3 occurrences, forms twice as frequent."""
    return variants(docs)


# Near pairs by equal patterns: a place replaced, or a place left out; crc32 bit by bit.
OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT w, c, xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(
             flatten(list_transform(string_split(id || ':' || w, ''), lambda x:
               CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)),
             lambda x: [x::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT)::BIGINT AS h
  FROM runs),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n
  FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
  FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk(word, last, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN forms f ON f.word = k.last WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(last, step) FROM walk k WHERE k.word = f.word) AS root, n, n_near, form_n
FROM forms f
"""
