import random
import re
from collections import defaultdict

import numpy as np
import pytest
from llmdata import DOC, SF01

from linklens.llm.chosen_path import _counts, _often, _prefixes, near_duplicates, op6_near_dedup
from linklens.llm.components import components
from linklens.llm.steps import Steps


def sets_of(docs, size):
    out = []
    for d, t, *_ in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size
                   else ({tuple(w)} if w else set()))
    return out


def brute(docs, size=4, percent=80):
    sets = sets_of(docs, size)
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(docs):
        r = find(i)
        if r not in low or low[r] is None or (d is not None and d < low[r]):
            low[r] = d
    return sorted(((d, len(sets[i]), low[find(i)], d == low[find(i)])
                   for i, (d, *_) in enumerate(docs)), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_small_docs(docs_df, small_docs):
    assert rows(op6_near_dedup(docs_df)) == brute(small_docs)


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert rows(op6_near_dedup(df)) == brute(docs)


def test_crowds_chains_and_small_leaves(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(150):                      # a crowd of near copies
        w = list(base)
        for _ in range(rng.choice([1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w), None, None, None))
    w = [f"c{i}" for i in range(100)]
    for i in range(150, 200):                 # a chain: neighbours are linked, ends are far apart
        w[(i * 7) % 100] = f"y{i}"
        docs.append((i, " ".join(w), None, None, None))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, DOC)
    want = {d: c for d, _, c, _ in brute(docs)}
    got = dict(rows(near_duplicates(df, shingle=4).select("doc_id", "component_id")))
    assert got == want
    # leaves far below the crowd: recall is that of the trees, and nothing false is linked
    got = dict(rows(near_duplicates(df, shingle=4, leaf=6, depth=3).select("doc_id", "component_id")))
    assert all(got[d] == want[d] or got[d] == d for d in want)
    assert sum(got[d] == want[d] for d in want) >= 0.98 * len(want)


def template_crowd(n, planted, slots, size):
    """Pages of one template with five filled slots, any two below 80 %; planted pairs share
    ``slots`` of them and are above."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(40 * size)]
    docs = []
    for i in range(n):
        w = list(base)
        for k in range(5):
            shared = i < 2 * planted and k < slots
            w[(2 + 8 * k) * size] = f"s{i // 2}k{k}" if shared else f"u{i}k{k}v{rng.randrange(10**6)}"
        docs.append((i, " ".join(w), "en", "src", 0))
    return docs


def crowd_brute(docs, size):
    """component_id of each doc: dense products for common shingles, lists for the others."""
    sets = sets_of(docs, size)
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    n = np.array([len(s) for s in sets], np.float32)
    dense = [v for v in where.values() if len(v) > 50]
    has = np.zeros((len(docs), len(dense)), np.float32)
    for k, v in enumerate(dense):
        has[v, k] = 1
    common = has @ has.T
    for v in where.values():
        if 1 < len(v) <= 50:
            common[np.ix_(v, v)] += 1
    linked = 100 * common >= 80 * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(linked, True)
    low = np.arange(len(docs))
    while True:
        new = np.where(linked, low[None, :], len(docs)).min(axis=1)
        if (new == low).all():
            return {docs[i][0]: docs[int(c)][0] for i, c in enumerate(low)}
        low = new


def test_pairs_inside_a_crowd_below_the_threshold(spark):
    docs = template_crowd(3000, planted=60, slots=1, size=4)
    want = crowd_brute(docs, 4)
    assert sum(d != c for d, c in want.items()) == 60
    got = near_duplicates(spark.createDataFrame(docs, DOC).repartition(8), shingle=4)
    assert dict(rows(got.select("doc_id", "component_id"))) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5), (400, 300), (7, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Steps(spark, "cc")).collect()
    want = {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100, 400: 100}
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("docs", [[], [(1, None, None, None, None), (2, "", None, None, None)]])
def test_no_shingles(spark, docs):
    got = op6_near_dedup(spark.createDataFrame(docs, DOC)).collect()
    assert sorted(tuple(r) for r in got) == [(d, 0, d, True) for d, *_ in docs]


def test_rare_shingles_of_a_crowd_give_no_count_rows(spark):
    common = " ".join(f"c{k}" for k in range(30))
    rare = [" ".join(f"r{i}x{k}" for k in range(40)) for i in range(80)]
    texts = spark.createDataFrame([(i, f"{common} {r}") for i, r in enumerate(rare)], "sid long, text string").repartition(3)
    counts = _counts(texts, 4, _often(texts, 4, 32)).collect()
    # a few rare ones may share a cell with a common one
    assert 27 <= len(counts) < 40 and sorted(r["c"] for r in counts)[-27:] == [80] * 27
    none = texts.filter("sid < 0")
    assert not _often(none, 4, 32).any() and _counts(none, 4, _often(none, 4, 32)).count() == 0


def test_first_shingles_carry_their_component(spark):
    texts = spark.createDataFrame([(7, "a b c d e f g h", 3), (9, "p q r", 9), (8, "a b c d e f g i", 3)],
                                  "sid long, text string, component long")
    hot = np.array([], np.uint64), np.array([], np.int64)
    got = _prefixes(texts, 4, 80, hot).select("sid", "n", "pos", "component").collect()
    assert sorted(map(tuple, got)) == [(7, 5, 0, 3), (7, 5, 1, 3), (8, 5, 0, 3), (8, 5, 1, 3), (9, 1, 0, 9)]
