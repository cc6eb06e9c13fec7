"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its ``shingle``-word sequences. Documents with equal
sets are one class from the start; only classes are joined. Independent trees
branch the classes: a node picks one or two coordinates of the minhash signature
(1/similarity on average, so a linked pair is expected to stay together in one
child) and sends each class to the child of its value there. Nodes of at most
``leaf`` classes are compared exhaustively: first each member with two others, and
when these links have made components, all pairs between different ones. Larger
nodes branch on, to ``depth``; what is still large then is a crowd of near copies,
whose members are first compared to the node's smallest class, and then those
outside its component to ``heads`` members spread over the node. These members only join most of a crowd
cheaply: what still lies in different components is joined exactly, by the
shingles that two linked sets must share among their first in an order common to
all sets, rare ones first (``_exact_rest``).

Tree and crowd candidates are dropped only by set sizes and by 8-bit samples of the
64 signature values that agree in fewer than 31 places (chance under 1e-7 for a
linked pair); those of the exact rest by sizes and positions alone.
Every link is confirmed on the full shingle sets: first each class with two
partners, then whatever lies between components, then the exact rest.
Candidates inside a component need no confirmation, which keeps crowds linear.

Hot nodes are never gathered: sizes come from partially aggregated counts and go
back by equi-joins that adaptive execution splits.

Defined cases: a null or empty text has no shingles and links with nothing;
fewer words than a shingle make one shingle; repeated rows and null ids keep
their own texts (rows are known by id and text hash); a component of null ids
only has a null id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm import texts as X
from linklens.llm.components import components
from linklens.llm.repeats import keyed
from linklens.llm.steps import Steps

T = 64                  # signature values
AGREE = 31              # of their 8-bit samples, how many must agree
HOT = 1 << 18           # shingles whose counts every task holds; the others come first in the order
CELLS = 1 << 18         # shingles are first counted by cells of their hash, CELLS // BLOCK rows a task
BLOCK = 1 << 12
MARKS = 1 << 26         # bits of the filter of texts to compare
CACHE_BYTES = 1 << 25   # shingle sets that a confirming task holds at most, besides one pair
ODD = X.mix((np.arange(T, dtype=X.U) + X.U(77)) * X.U(0x9E3779B97F4A7C15)) | X.U(1)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text) of the distinct shingles of lower-cased texts, ordered by text."""
    low = X.LOWER_BYTE[data]
    starts, ends, uo = X.word_spans(low, off)
    sp = X.Spans(X.word_hashes(low, starts, ends))
    n = np.diff(uo)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = X.ranges(uo[:-1], count)
    text = np.repeat(np.arange(len(n)), count)
    sh = sp.hash(begin, np.minimum(begin + size, uo[text + 1]))
    order = np.lexsort((sh, text))
    sh, text = sh[order], text[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])
    return sh[new], text[new]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, n, a, b, sig): set size, 128-bit set identity, minhash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in X.pieces(batch.column(2)):
                sh, text = shingles(data, off, size)
                rows = len(off) - 1
                n = np.bincount(text, minlength=rows)
                a, b = np.zeros(rows, X.U), np.zeros(rows, X.U)
                sig = np.zeros((rows, T), np.uint32)
                some = np.flatnonzero(n)
                if len(some):
                    at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    a[some] = np.add.reduceat(X.mix(sh ^ X.U(0xA5A5A5A5)), at)
                    b[some] = np.add.reduceat(X.mix(sh * X.U(0xC2B2AE3D27D4EB4F)), at)
                    for j in range(T):
                        sig[some, j] = np.minimum.reduceat(((sh * ODD[j]) >> X.U(32)).astype(np.uint32), at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, rows), batch.column(1).slice(row, rows),
                     pa.array(n.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     pa.array([r.tobytes() for r in sig], type=pa.binary())],
                    names=["doc_id", "th", "n", "a", "b", "sig"])

    return docs.mapInArrow(run, "doc_id long, th long, n int, a long, b long, sig binary")


def _fixed(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _branch(rows: DataFrame, trees: int, similarity: float) -> DataFrame:
    """Children (node, sid, n, sample) of rows (sid, n, sig, node); a null node is
    the root of every tree."""
    second = int((1 / similarity - 1) * 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = X.mix(np.arange(trees, dtype=X.U) + X.U(1))
        for whole in batches:
            for lo in range(0, len(whole), 4096):
                b = whole.slice(lo, 4096)
                sid, n = b.column(0), b.column(1)
                sig = _fixed(b.column(2), np.uint32, T)
                if b.column(3).null_count:
                    at = np.repeat(np.arange(len(b)), trees)
                    node = np.tile(roots, len(b))
                else:
                    at = np.arange(len(b))
                    node = b.column(3).to_numpy().view(X.U)
                more = np.flatnonzero(X.mix(node ^ X.U(0x51)) < X.U(second))
                pick = np.concatenate([X.mix(node ^ X.U(0x52)), X.mix(node[more] ^ X.U(0x53))]) % X.U(T)
                at, node = np.concatenate([at, at[more]]), np.concatenate([node, node[more]])
                value = sig[at, pick.astype(np.int64)].astype(X.U)
                child = X.mix(node * X.U(3) + X.mix((pick << X.U(32)) | value))
                sample = (sig & 0xFF).astype(np.uint8)
                raw = [r.tobytes() for r in sample]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), sid.take(pa.array(at)), n.take(pa.array(at)),
                     pa.array(raw, type=pa.binary()).take(pa.array(at))],
                    names=["node", "sid", "n", "sample"])

    return (rows.mapInArrow(run, "node long, sid long, n int, sample binary"))


def _maybe(n1: np.ndarray, n2: np.ndarray, s1: np.ndarray, s2: np.ndarray, percent: int) -> np.ndarray:
    """Positions of the pairs that sizes and samples leave possible."""
    fits = np.flatnonzero(100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
    return fits[(s1[fits] == s2[fits]).sum(axis=1) >= AGREE]


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) with a < b of pairs (a, an, asample, b, bn, bsample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            n1, n2 = (b.column(c).to_numpy().astype(np.int64) for c in (1, 4))
            ok = _maybe(n1, n2, _fixed(b.column(2), np.uint8, T), _fixed(b.column(5), np.uint8, T), percent)
            p, q = b.column(0).to_numpy()[ok], b.column(3).to_numpy()[ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    return (pairs.select("a", "an", "asample", "b", "bn", "bsample")
            .mapInArrow(run, "a long, b long").distinct())


def _picks(p: np.ndarray, q: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (p, q) each member's partner of the smallest sid and one by hash."""
    me, other = np.concatenate([p, q]), np.concatenate([q, p])
    chosen = []
    for key in (sid[other].view(X.U), X.mix(sid[me].view(X.U) ^ (sid[other].view(X.U) * X.U(3)))):
        order = np.lexsort((key, me))
        at = order[np.concatenate([[True], me[order][1:] != me[order][:-1]])] if len(order) else order
        chosen.append(at)
    at = np.concatenate(chosen)
    return me[at], other[at]


def _leaf_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) with a < b among the classes that share a small node. Rows are
    (node, sid, n, sample), of which each member gets two partners, or have a component as
    well, and then all pairs of different components are candidates."""
    known = "component" in rows.columns

    def pairs(node, sid, n, sample, component=None):
        cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
        first, size = cut[:-1], np.diff(cut)
        for c in np.unique(size[size > 1]):
            i, j = np.triu_indices(c, 1)
            at = first[size == c][:, None]
            for part in np.array_split(at, max(1, len(at) * len(i) // 200_000)):
                p, q = (part + i).ravel(), (part + j).ravel()
                ok = component[p] != component[q] if known else sid[p] != sid[q]
                p, q = p[ok], q[ok]
                ok = _maybe(n[p], n[q], sample[p], sample[q], percent)
                p, q = p[ok], q[ok]
                if not known:
                    p, q = _picks(p, q, sid)
                p, q = sid[p], sid[q]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = (b.column(0).to_numpy(), b.column(1).to_numpy(),
                   b.column(2).to_numpy().astype(np.int64), _fixed(b.column(3), np.uint8, T),
                   *(b.column(k).to_numpy() for k in range(4, b.num_columns)))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # its node may go on in the next batch
            if last:
                yield from pairs(*(x[:last] for x in now))
            held = tuple(x[last:] for x in now)
        if held is not None and len(held[0]):
            yield from pairs(*held)

    return (rows.repartition("node").sortWithinPartitions("node")
            .mapInArrow(run, "a long, b long").distinct())


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of ``rows`` (doc_id, th, text) that may be among ``keys`` (doc_id, th): a filter of
    MARKS bits, the same size whatever the input, that spares most other texts the shuffle."""
    place = F.pmod(F.xxhash64("doc_id", "th"), F.lit(MARKS))
    cells = (keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow())
    marks = np.zeros(MARKS // 64, np.int64)
    marks[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(marks.view(X.U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(3).to_numpy()
            hit = (held.value[p // 64] >> (p % 64).astype(X.U)) & X.U(1)
            yield b.filter(pa.array(hit.astype(bool))).select(["doc_id", "th", "text"])

    return (rows.select("doc_id", "th", "text", place.alias("p"))
            .mapInArrow(run, "doc_id long, th long, text string"))


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    one = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
    two = (one.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
           .select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = {}, 0
        for b in batches:
            linked = np.zeros(len(b), dtype=bool)
            for k in range(len(b)):
                found = []
                for side in (0, 1):
                    sid = b.column(side)[k].as_py()
                    one = sets.get(sid)
                    if one is None:
                        raw = np.frombuffer(b.column(2 + side)[k].as_buffer(), dtype=np.uint8)
                        one = shingles(raw, np.array([0, len(raw)]), size)[0]
                        if held + one.nbytes > CACHE_BYTES:
                            sets, held = {}, 0
                        sets[sid] = one
                        held += one.nbytes
                    found.append(one)
                common = len(np.intersect1d(*found, assume_unique=True))
                linked[k] = 100 * common >= percent * (len(found[0]) + len(found[1]) - common)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)],
                                             names=["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def _outliers(large: DataFrame, member: DataFrame, heads: int, percent: int, steps: Steps) -> DataFrame:
    """Second candidates of crowds: members outside the component of their node's smallest
    class, with ``heads`` spread members of the node (the smallest of each hash class). What
    they leave apart is joined exactly afterwards."""
    rows = steps.table(large.join(member, "sid", "left")
                       .withColumn("component", F.coalesce("component", "sid"))
                       .select("node", "sid", "n", "sample", "component"), "crowds")
    first = (rows.groupBy("node").agg(F.min(F.struct("sid", "component")).alias("h"))
             .select("node", F.col("h.component").alias("main")))
    some = (rows.groupBy("node", F.pmod(F.hash("sid"), F.lit(heads)).alias("part"))
            .agg(F.min(F.struct("sid", "n", "sample", "component")).alias("h"))
            .select("node", F.col("h.sid").alias("a"), F.col("h.n").alias("an"), F.col("h.sample").alias("asample"),
                    F.col("h.component").alias("head")))
    # a member meets the heads of two of its nodes, the same two for most members of a crowd
    ends = rows.groupBy("sid").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    out = (rows.join(ends, "sid").filter("node IN (low, high)").join(first, "node").filter("component != main")
           .select("node", F.col("sid").alias("b"), F.col("n").alias("bn"), F.col("sample").alias("bsample"),
                   "component"))
    # sizes decide in the join, samples right after it
    near = (out.join(steps.table(some, "heads"), "node")
            .filter(F.col("head") != F.col("component"))
            .filter(100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")))
    return _possible(near, percent)


def _cell(sh: np.ndarray) -> np.ndarray:
    return (X.mix(sh) % X.U(CELLS)).astype(np.int64)


def _often(texts: DataFrame, size: int, rare: int) -> np.ndarray:
    """Which cells have more than ``rare`` shingles of the texts (sid, text), and so all cells of
    shingles in more than ``rare`` texts. A task gives its counts in blocks, whatever it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, data, off in X.pieces(batch.column(1)):
                total += np.bincount(_cell(shingles(data, off, size)[0]), minlength=CELLS)
        counts = np.minimum(total, rare + 1).astype(np.int32).reshape(-1, BLOCK)
        some = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([counts[k].tobytes() for k in some], type=pa.binary())],
                                         names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int64()),
                                          pa.array([(c > rare).tobytes() for c in total.values()], type=pa.binary())],
                                         names=["block", "often"])

    rows = (texts.select("sid", "text").mapInArrow(run, "block long, counts binary").repartition("block")
            .mapInArrow(add, "block long, often binary").toArrow())
    often = np.zeros((CELLS // BLOCK, BLOCK), dtype=bool)
    for k, raw in zip(rows.column("block").to_pylist(), rows.column("often").to_pylist()):
        often[k] = np.frombuffer(raw, dtype=bool)
    return often.ravel()


def _counts(texts: DataFrame, size: int, often: np.ndarray) -> DataFrame:
    """(shingle, c): in how many of the texts (sid, text) a shingle of the cells ``often`` is."""
    known = texts.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in X.pieces(batch.column(1)):
                sh = shingles(data, off, size)[0]
                sh, c = np.unique(sh[known.value[_cell(sh)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(c)], names=["shingle", "c"])

    return (texts.select("sid", "text").mapInArrow(run, "shingle long, c long")
            .groupBy("shingle").agg(F.sum("c").alias("c")))


def _prefixes(texts: DataFrame, size: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, sid, n, pos, component) of the first shingles of each text (sid, text, component), as
    many as a partner of the smallest possible size needs; ordered by the count of hot ones and the shingle."""
    known = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count = known.value
        for batch in batches:
            for row, data, off in X.pieces(batch.column(1)):
                sh, text = shingles(data, off, size)
                c = np.zeros(len(sh), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, sh), len(keys) - 1)
                    c = np.where(keys[at] == sh, count[at], 0)
                order = np.lexsort((sh, c, text))
                sh, text = sh[order], text[order]
                n = np.bincount(text, minlength=len(off) - 1)
                pos = np.arange(len(sh)) - (np.cumsum(n) - n)[text]
                keep = np.flatnonzero(pos <= n[text] - -(-percent * n[text] // 100))
                sh, text, pos = sh[keep], text[keep], pos[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sh.view(np.int64)), batch.column(0).slice(row).take(pa.array(text)),
                     pa.array(n[text].astype(np.int32)), pa.array(pos.astype(np.int32)),
                     batch.column(2).slice(row).take(pa.array(text))],
                    names=["shingle", "sid", "n", "pos", "component"])

    return (texts.select("sid", "text", "component")
            .mapInArrow(run, "shingle long, sid long, n int, pos int, component long"))


def _exact_rest(crowd: DataFrame, texts: DataFrame, size: int, percent: int, rare: int, steps: Steps) -> DataFrame:
    """Candidates (a, b) with a < b: every linked pair of crowd classes (sid, component) in
    different components is one of them.

    Linked sets of m <= n shingles share o = percent (m + n) / (100 + percent) of them, so their
    first common one in any common order is at most at place m - o of the one and n - o of the other.
    The smaller set is looked up by its first m - 2 percent m / (100 + percent) places only, which is
    what a crowd below the threshold differs in. At a shingle, the rows of its largest component
    meet only those of others."""
    # components go with the texts: a join of the shingles' rows would be one of every text's first ones
    texts = steps.table(texts.join(crowd, "sid"), "crowd_texts")
    # the order decides only how many candidates there are
    top = (_counts(texts, size, _often(texts, size, rare)).filter(F.col("c") > rare).orderBy(F.desc("c"), "shingle").limit(HOT)
           .toPandas().to_numpy(dtype=np.int64).reshape(-1, 2))
    keys = top[:, 0].copy().view(X.U)
    order = np.argsort(keys)
    rows = steps.table(_prefixes(texts, size, percent, (keys[order], top[order, 1].copy())), "prefixes")
    steps.drop(texts)
    parts = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"))
    main = (parts.groupBy("shingle").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("k"))
            .filter("k > 1").select("shingle", F.col("m.component").alias("main")))
    rows = steps.table(rows.join(main, "shingle").withColumn("out", F.col("component") != F.col("main"))
                       .drop("main"), "meeting")
    probe = rows.select("shingle", *[F.col(c).alias(f"p_{c}") for c in ("sid", "n", "pos", "component", "out")])
    index = rows.filter(f"pos <= n - ceil({2 * percent} * n / {100 + percent})")
    least = f"ceil({percent} * (n + p_n) / {100 + percent})"
    fits = F.expr(f"""component != p_component AND (n < p_n OR n = p_n AND sid != p_sid)
        AND 100 * n >= {percent} * p_n AND pos <= n - {least} AND p_pos <= p_n - {least}""")
    met = (index.filter("out").join(probe, "shingle").filter(fits)
           .unionByName(index.filter("NOT out").join(probe.filter("p_out"), "shingle").filter(fits)))
    return met.select(F.least("sid", "p_sid").alias("a"), F.greatest("sid", "p_sid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, trees: int = 12,
                    leaf: int = 32, depth: int = 3, heads: int = 32) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, component_th): documents linked, directly or
    not, by shingle sets of at least ``percent`` % similarity; component_id is their smallest
    doc_id and component_th the text hash of the row that stands for them."""
    steps = Steps(docs.sparkSession, "near")
    # null ids are known by the hash alone, for which 32 bits are few
    rows = keyed(docs).withColumn("th", F.xxhash64("text"))
    signed = steps.table(signatures(rows, shingle), "signatures")
    classes = (signed.filter("n > 0").groupBy("n", "a", "b")
               .agg(F.min(F.struct("doc_id", "th", "sig")).alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("low"))
               .select("n", "a", "b", "low", "rep.*").withColumn("sid", F.monotonically_increasing_id()))
    classes = steps.table(classes, "classes")

    found, level = [], 0
    active = classes.select("sid", "n", "sig", F.lit(None).cast("long").alias("node"))
    large = None
    while True:
        level += 1
        children = steps.table(_branch(active, trees, percent / 100).distinct() if level > 1
                               else _branch(active, trees, percent / 100), "children")
        counts = steps.table(children.groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "counts")
        shared = steps.table(children.join(counts, "node"), "shared")
        steps.drop(children, counts)
        found.append(shared.filter(F.col("c") <= leaf).select("node", "sid", "n", "sample"))
        large = shared.filter(F.col("c") > leaf).select("node", "sid", "n", "sample")
        if level == depth or large.isEmpty():
            break
        active = large.select("sid", "n", "node").join(classes.select("sid", "sig"), "sid").select(
            "sid", "n", "sig", "node")

    small = found[0]
    for f in found[1:]:
        small = small.unionByName(f)
    pairs = steps.table(_leaf_pairs(small, percent), "pairs")
    crowd = (large.groupBy("node").agg(F.min(F.struct("sid", "n", "sample")).alias("h"))
             .select("node", F.col("h.sid").alias("a"), F.col("h.n").alias("an"), F.col("h.sample").alias("asample")))
    stars = (large.join(crowd, "node").filter("sid != a")
             .withColumnsRenamed({"sid": "b", "n": "bn", "sample": "bsample"}))
    stars = steps.table(_possible(stars, percent), "stars")

    # first the smallest and one other partner of each class, which connect much of a component
    nearest = (pairs.unionByName(stars).groupBy("b")
               .agg(F.min("a").alias("a1"), F.max_by("a", F.xxhash64("a", "b")).alias("a2")))
    first = nearest.select(F.explode(F.array_distinct(F.array("a1", "a2"))).alias("a"), "b")
    first = steps.table(first, "first")
    ids = (pairs.unionByName(stars).select(F.explode(F.array("a", "b")).alias("sid"))
           .unionByName(large.select("sid")).distinct()
           .join(classes.select("sid", "doc_id", "th"), "sid"))
    ids = steps.table(ids.dropDuplicates(["sid"]), "ids")
    texts = _marked(rows, ids)
    texts = (texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]) & (texts["th"] == ids["th"]))
             .select("sid", "text"))
    texts = steps.table(texts.groupBy("sid").agg(F.first("text").alias("text")), "texts")
    links = steps.table(_confirm(first, texts, shingle, percent), "links")
    member = steps.table(components(links, steps).withColumnRenamed("id", "sid"), "member")

    # then all pairs of a node that still lie in different components; nodes whose members
    # are in one component give none
    side = member.select(F.col("sid").alias("a"), F.col("component").alias("ca"))
    other = member.select(F.col("sid").alias("b"), F.col("component").alias("cb"))
    placed = small.join(member, "sid", "left").select(
        "node", "sid", "n", "sample", F.coalesce("component", "sid").alias("component"))
    between = _leaf_pairs(placed, percent)
    # the smallest class of a crowd's node is one of its spread members
    rest = between.unionByName(_outliers(large, member, heads, percent, steps))
    rest = rest.select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    rest = steps.table(rest, "rest")
    more = steps.table(_confirm(rest, texts, shingle, percent), "more")
    # these links connect whole components, so only components are joined again
    merged = (more.join(side, "a", "left").join(other, "b", "left")
              .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))

    def joined(edges: DataFrame) -> DataFrame:
        return components(edges, steps).select(F.col("id").alias("component"), F.col("component").alias("top"))

    top = joined(merged)
    # and last the links of crowds that neither trees nor spread members met
    crowd = (large.select("sid").distinct().join(member, "sid", "left")
             .withColumn("component", F.coalesce("component", "sid")).join(top, "component", "left")
             .select("sid", F.coalesce("top", "component").alias("component")))
    crowd = steps.table(crowd, "crowd")
    if crowd.select("component").distinct().limit(2).count() > 1:
        last = steps.table(_exact_rest(crowd, texts, shingle, percent, leaf, steps), "last")
        last = steps.table(_confirm(last, texts, shingle, percent), "late")
        late = (last.join(crowd.select(F.col("sid").alias("a"), F.col("component").alias("ca")), "a")
                .join(crowd.select(F.col("sid").alias("b"), F.col("component").alias("cb")), "b")
                .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        top = joined(merged.unionByName(late))

    labelled = steps.table(classes.select("n", "a", "b", "sid", "low").join(member, "sid", "left")
                           .withColumn("component", F.coalesce("component", "sid")).join(top, "component", "left")
                           .withColumn("component", F.coalesce("top", "component")).drop("top"), "labelled")
    lowest = steps.table(labelled.groupBy("component").agg(F.min("low").alias("low")), "lowest")
    by_set = steps.table(labelled.drop("low").join(lowest, "component").select(
        "n", "a", "b", F.col("low.doc_id").alias("component_id"), F.col("low.th").alias("component_th")), "by_set")
    full = (signed.filter("n > 0").select("doc_id", "th", "n", "a", "b").join(by_set, ["n", "a", "b"])
            .select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id",
                    "component_th"))
    empty = signed.filter("n = 0").select("doc_id", "th", F.lit(0).cast("long").alias("n_shingles"),
                                          F.col("doc_id").alias("component_id"), F.col("th").alias("component_th"))
    return full.unionByName(empty)


def op6_near_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest for 4-word shingles at 80 %."""
    return (near_duplicates(docs, shingle=4)
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
