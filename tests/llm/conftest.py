import random

import pytest
from llmdata import DOC


def words(rng, n, vocab=400):
    return [f"w{int(rng.paretovariate(0.7)) % vocab}" for _ in range(n)]


@pytest.fixture(scope="session")
def small_docs():
    """Texts with shared passages, near copies, exact copies, ties and odd rows."""
    rng = random.Random(5)
    passages = [words(rng, 70) for _ in range(4)]
    docs = []
    base = words(rng, 220)
    for i in range(60):
        kind = i % 6
        w = words(rng, rng.choice([5, 60, 180, 400]))
        if kind == 1:
            w[3:3] = passages[i % 4]
        elif kind == 2:
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        elif kind == 3 and i > 6:
            w = docs[i - 6][1].split()
        elif kind == 4:
            w = w + passages[(i + 1) % 4][5:60] + words(rng, 30) + passages[i % 4]
        sep = rng.choice([" ", "  ", "\n", "\t "])
        docs.append((i, sep.join(w), "en", f"src{i % 3}" if i % 7 else None, 0))
    docs += [(60, None, None, None, None), (61, "", "en", "src1", 0), (62, " \n ", "en", "src1", 0),
             (63, "x" * 700, "en", "src0", 700), (64, "ab " * 400, "en", "src0", 1200),
             (65, "é" * 300 + " Ünï " + " ".join(base), "fr", "src0", 0),
             (2, docs[2][1], "en", "src2", 0), (2, docs[2][1], "en", "src2", 0),
             (None, docs[8][1], "en", "src2", 0)]
    return docs


@pytest.fixture(scope="session")
def docs_df(spark, small_docs):
    return spark.createDataFrame(small_docs, DOC).repartition(5).cache()
