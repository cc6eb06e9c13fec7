import math
from collections import Counter

from llmdata import DOC

from linklens.llm import lm_scoring as LM
from linklens.llm.lm_scoring import BackoffModel, op3_lm_scoring
from linklens.llm.repeats import keyed

LABEL = "doc_id long, quality int, toxic int"


def brute(docs, trusted):
    one, two = Counter(), Counter()
    for d, t, *_ in docs:
        if d in trusted:
            w = (t or "").encode().split()
            one.update(w)
            two.update(zip(w, w[1:]))
    total = max(sum(one.values()), 1)
    out = []
    for d, t, *_ in docs:
        w = (t or "").encode().split()
        s = 0.0
        for i, v in enumerate(w):
            if i and two[w[i - 1], v]:
                s += math.log(two[w[i - 1], v] / one[w[i - 1]])
            else:
                s += math.log(0.4 * one[v] / total) if one[v] else math.log(0.4 / (2 * total))
        out.append((d, len(w), s / len(w) if w else None))
    return sorted(out, key=str)


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        assert g[2] is None or abs(g[2] - w[2]) < 2e-4, (g, w)


def test_scores_equal_brute_force(spark, docs_df, small_docs):
    trusted = [i for i in range(66) if i % 3]
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(0, 0, 0), (3, None, None), (None, 1, 0)] * 2, LABEL)
    close([tuple(r) for r in op3_lm_scoring(docs_df, labels).collect()], brute(small_docs, set(trusted)))


def test_common_table_doesnt_change_scores(spark, docs_df, small_docs):
    rows = keyed(docs_df)
    for common in (1, 7, 100_000):
        model = BackoffModel(rows.filter("doc_id < 20"), common=common)
        got = [(r["doc_id"], r["n_words"], r["log_score"]) for r in model.score(rows).collect()]
        close(got, brute(small_docs, set(range(20))))


def test_no_trusted_documents_and_empty_table(spark, docs_df):
    none = spark.createDataFrame([], LABEL)
    got = op3_lm_scoring(docs_df, none).collect()
    assert {r["log_score"] for r in got if r["n_words"]} == {round(math.log(0.2), 4)}
    assert op3_lm_scoring(spark.createDataFrame([], DOC), none).count() == 0


def test_broadcast_words_are_few_and_scores_stay(spark, monkeypatch):
    """Only words with a large share go to the driver's broadcasts, whatever ``common`` is."""
    docs = [(i, " ".join(f"the w{i * 7 + k} and" for k in range(40)), "en", "a", 1) for i in range(20)]
    rows = keyed(spark.createDataFrame(docs, DOC))
    sizes = []
    real = LM.F.broadcast
    monkeypatch.setattr(LM.F, "broadcast", lambda df: sizes.append(df.count()) or real(df))
    monkeypatch.setattr(LM, "HOT", 8, raising=False)
    model = BackoffModel(rows.filter("doc_id < 12"))
    assert sizes and max(sizes) < 8
    got = [(r["doc_id"], r["n_words"], r["log_score"]) for r in model.score(rows).collect()]
    close(got, brute(docs, set(range(12))))


def test_split_takes_the_most_frequent(spark):
    grams = spark.createDataFrame([(i, n, 0.0) for i, n in enumerate([1] * 5 + [2] * 3 + [7, 5000, 5001])],
                                  "key long, n long, weight double")
    for most, want in ((0, set()), (1, set()), (2, {9, 10}), (5, {8, 9, 10}), (6, {5, 6, 7, 8, 9, 10}), (99, set(range(11)))):
        top, rest = LM._split(grams, most)
        assert {r["key"] for r in top.collect()} == want
        assert {r["key"] for r in rest.collect()} == set(range(11)) - want


def recursive(docs, trusted, order):
    """Stupid backoff word by word, straight from its definition."""
    counts = Counter()
    for d, t, *_ in docs:
        if d in trusted:
            w = (t or "").encode().split()
            counts.update(tuple(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = max(sum(n for g, n in counts.items() if len(g) == 1), 1)

    def s(w, i, k):
        if k == 1:
            return counts[w[i],] / total if counts[w[i],] else 1 / (2 * total)
        g = tuple(w[i - k + 1:i + 1]) if i >= k - 1 else ()
        return counts[g] / counts[g[:-1]] if g and counts[g] else 0.4 * s(w, i, k - 1)

    out = []
    for d, t, *_ in docs:
        w = (t or "").encode().split()
        out.append((d, len(w), sum(math.log(s(w, i, order)) for i in range(len(w))) / len(w) if w else None))
    return out


def test_longer_contexts_are_scored(spark, docs_df, small_docs, tmp_path):
    """n-grams beyond pairs count, and are backed off from one word at a time."""
    trusted = [i for i in range(66) if i % 3]
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], LABEL)
    for order in (1, 3, 4):
        got = [tuple(r) for r in op3_lm_scoring(docs_df, labels, order=order).collect()]
        close(got, recursive(small_docs, set(trusted), order))
    from linklens.llm.queries import QUERIES
    docs_df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = [tuple(r) for r in QUERIES["op3_lm_scoring"](spark, str(tmp_path)).collect()]
    close(got, recursive(small_docs, set(trusted), 3))


def test_batches_and_ranges_dont_change_scores(spark, docs_df, small_docs, monkeypatch):
    """Batches of a few texts, many ranges and rounds of them."""
    monkeypatch.setattr(LM, "BATCH_BYTES", 900)
    monkeypatch.setattr(LM, "CHUNK", 50)
    rows = keyed(docs_df)
    model = BackoffModel(rows.filter("doc_id < 20"), order=3, rounds=3, common=40)
    assert len(model.keys)
    got = [(r["doc_id"], r["n_words"], r["log_score"]) for r in model.score(rows).collect()]
    close(got, recursive(small_docs, set(range(20)), 3))
