import random
from collections import Counter, defaultdict

import duckdb
import pytest
from llmdata import DOC, SF01

from linklens.llm.spelling import OP13_SQL, RUN, Index, op13_spelling_variants, typos, variants


def near_pairs(words):
    """One error apart, by patterns: a place left out, or replaced."""
    by, out = defaultdict(set), set()
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                out |= {(w, w[:i] + w[i + 1:]), (w[:i] + w[i + 1:], w)}
    for same in by.values():
        out |= {(a, b) for a in same for b in same if a != b}
    return out


def brute(docs, one_in=97, factor=2):
    count = Counter()
    for doc_id, text, *_ in docs:
        for run in RUN.findall(text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            count[typos("" if doc_id is None else str(doc_id), low, one_in)] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = defaultdict(list)
    for a, b in near_pairs(set(n)):
        near[a].append((-n[b], b))
    form = {w: min(near[w])[1] if near[w] and -min(near[w])[0] >= factor * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_given_documents_and_sql(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    got = rows(op13_spelling_variants(df))
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    assert sorted(con.sql(OP13_SQL).fetchall()) == got


def variant_docs(rng, bases, per):
    docs, letters = [], "abcdeéÿ"
    for i in range(per):
        words = []
        for w in bases:
            for _ in range(rng.choice([1, 3, 6])):
                v, at = w, rng.randrange(len(w) + 1)
                kind = rng.randrange(5)
                if kind == 1:
                    v = v[:at] + rng.choice(letters) + v[at:]
                elif kind == 2:
                    v = v[:at] + v[at + 1:]
                elif kind == 3:
                    v = v[:at] + rng.choice(letters) + v[at + 1:]
                elif kind == 4:
                    v = v.upper()
                words += [v] * rng.choice([1, 2, 4])
        docs.append((i if i % 5 else None, rng.choice([" ", "\n", "1", "-"]).join(words), None, None, None))
    return docs


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_small_blocks_and_ties(spark, block):
    """A common beginning and a common end hold most words; blocks far below them."""
    rng = random.Random(block)
    bases = ["anfangs" + "".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 4]))) for _ in range(40)]
    bases += ["".join(rng.choice("abc") for _ in range(3)) + "ändlich" for _ in range(40)] + ["aaaaa", "aaaaaa", "àÀÿÿé"]
    docs = variant_docs(rng, bases, 12)
    want = brute(docs, one_in=5)
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != (r[1] or r[0]) for r in want)
    assert rows(variants(spark.createDataFrame(docs, DOC).repartition(5), one_in=5, block_words=block)) == want


def test_long_runs(spark):
    long = "ab" * 30_000
    docs = [(i, " ".join([long] * 3 + [long + "c"] * 7 + ["x" * 3000, "x" * 2999]), None, None, None) for i in range(4)]
    docs += [(9, "Q" * 1_500_000, None, None, None)]
    assert rows(op13_spelling_variants(spark.createDataFrame(docs, DOC))) == brute(docs)


def test_nulls_repeats_empty_and_other_columns(spark):
    docs = [(None, "Wörter Wörter wörter WÖRTER", None, None, None), (1, None, None, None, None), (2, "", None, None, None),
            (3, "abcde×÷ abcde×÷ abcde×÷", None, None, None), (4, "apples aples apples", None, None, None)] * 3
    docs.append((4, "apples aples apples", None, None, None))
    more = spark.createDataFrame([(*d, "w", 1) for d in docs], DOC + ", word string, n int")
    assert rows(op13_spelling_variants(more)) == brute(docs)
    assert rows(op13_spelling_variants(spark.createDataFrame([], DOC))) == []


def test_index_recurrence():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abz") for _ in range(n)) for n in (5, 6, 7) for _ in range(150)})
    want = near_pairs(set(words))
    got = set()
    for n in (5, 6, 7):
        index = Index([w for w in words if len(w) == n])
        for m in (n - 1, n, n + 1):
            asked = [w for w in words if len(w) == m]
            got |= {(asked[q], index.words[w]) for q, w in (index.near(asked) if asked else [])}
    assert got == want
