import hashlib
import zlib

import duckdb
import pytest
from llmdata import DOC, SF01

from linklens.llm.merkle import OP12_SQL, manifest, op12_merkle_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level):
    levels = [level]
    while len(level) > 1:
        level = [H(*level[i:i + 3]) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def brute(docs):
    by = {}
    for doc_id, text, lang, source, n_chars in docs:
        head = "".join(map(field, (doc_id, source, lang, n_chars)))
        cut = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            cut = text.replace("\n", "")
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, H(head + field(text)), H(head + field(cut)), doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(by[s], key=lambda r: r[:3])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for pos, (_, _, leaf, cut, doc_id) in enumerate(sorted(by[s], key=lambda r: r[:3])):
            h, proof = cut, ""
            for levels, at in ((trees[s], pos), (top, place)):
                for level in levels[:-1]:
                    run, mine = level[at - at % 3:at - at % 3 + 3], at % 3
                    proof += "".join(run[:mine] + run[mine + 1:])
                    h = H(*run[:mine], h, *run[mine + 1:])
                    at //= 3
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], H(proof), h, h == top[-1][0]))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in op12_merkle_manifest(df).collect()), key=str)


def test_small_docs(docs_df, small_docs):
    got = rows(docs_df)
    assert got == brute(small_docs)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_given_documents_and_sql(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    got = rows(df)
    assert got == brute([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    assert sorted(con.sql(OP12_SQL).fetchall(), key=str) == got


@pytest.mark.parametrize("sizes", [[1], [1] * 10, [28, 27, 9, 4, 1], [82, 2]])
def test_tree_sizes(spark, sizes):
    """Lone leaves, last runs of one or two, trees of different heights."""
    docs, i = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            docs.append((i, f"a\nb{i}" if i % 3 else None, "en", f"s{k}é" if k else None, i))
            i += 1
    assert rows(spark.createDataFrame(docs, DOC).repartition(4)) == brute(docs)


def test_hot_source_over_many_partitions(spark):
    docs = [(7 * i % 3001, f"t\n{i}", "en", "hot" if i % 3 else f"s{i % 11}", i) for i in range(3001)]
    assert rows(spark.createDataFrame(docs, DOC).repartition(13)) == brute(docs)


def test_proofs_are_real(spark):
    docs = [(i, f"x{i}", "en", "s", 1) for i in range(10)]
    got = {r["doc_id"]: r for r in manifest(spark.createDataFrame(docs, DOC)).collect()}
    leaves = [got[i]["leaf"] for i in range(10)]
    up = [H(*leaves[i:i + 3]) for i in range(0, 10, 3)]
    assert got[4]["proof"] == "".join([leaves[3], leaves[5], up[0], up[2], H(up[3])])
    assert got[9]["proof"] == H(*up[:3])          # alone in two runs


def test_long_text_empty_table_and_other_columns(spark):
    docs = [(1, "é\n" * 700_000, "en", "s", None), (2, "", None, "s", 0), (2, "", None, "s", 0)]
    assert rows(spark.createDataFrame(docs, DOC)) == brute(docs)
    assert rows(spark.createDataFrame([], DOC)) == []
    more = spark.createDataFrame([(*d, 1, "p", 2, 3) for d in docs], DOC + ", pos long, src string, level int, n int")
    assert rows(more) == brute(docs)
