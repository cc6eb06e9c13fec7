import zlib
from array import array

import numpy as np
import pytest
from llmdata import DOC
from tokenizers import Tokenizer

from linklens.llm.token_counts import attribute, op5_token_counts, token_counts
from linklens.llm.token_orc import op4_token_orc, read_tokens, write_tokens
from linklens.llm.tokens import SegmentLengths, WordIds, default_path

ODD = ["", " ", "\n\n", "Don't we'll I'M x's", "a  b\tc\r\n d ", "ÀÉ ß Ünï ÿ 12 3a4", "İstanbul ΟΔΟΣ ΣΑΣ",
       "é ́x á", "x<|endoftext|>y <|startoftext|>", "a b   c 　d", "日本語 text 🙂🙃",
       "a\x1cb \x1d c", "﻿zero​width", "$$$ *** %%%% a,b;c", "A" * 300, "<|  |> < |", "a \n b\n\n\nc d",
       "ﬁ ½ ² Ⅷ", "tab\t\tend\n"]


def test_word_cache_equals_whole_text_encoding(small_docs):
    path = default_path("word_bpe_49k.json")
    words, whole = WordIds(path), Tokenizer.from_file(path)
    for text in ODD + [t or "" for _, t, *_ in small_docs]:
        want = whole.encode(text, add_special_tokens=False).ids
        assert list(array("I", words.encode(text.encode()))) == want, text


def test_segment_cache_equals_whole_text_encoding(small_docs):
    path = default_path("byte_bpe_50k.json")
    segments, whole = SegmentLengths(path), Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    for text in ODD + [t or "" for _, t, *_ in small_docs]:
        got = list(array("I", segments.lengths(text.encode())))
        assert len(got) == len(whole.encode(text, add_special_tokens=False).ids), text
        assert sum(got) == len(text.encode()), text


def test_files_round_trip_in_order(docs_df, small_docs):
    whole = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    got = sorted((r for r in op4_token_orc(docs_df).collect()), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    texts = {}
    for d, t, *_ in small_docs:
        texts.setdefault(d, []).append(t or "")
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        crcs = {zlib.crc32(np.array(whole.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes())
                for t in texts[r["doc_id"]]}
        assert r["ids_crc32"] in crcs
    assert len(got) == len(small_docs)


def test_no_token_array_is_shuffled(spark, docs_df):
    plan = op4_token_orc(docs_df)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "NestedLoop" not in plan and "Exchange hashpartitioning" not in plan
    assert plan.count("BroadcastExchange") >= 1


def test_many_files_and_repeated_ids_spread(spark, monkeypatch, tmp_path):
    from linklens.llm import token_orc
    monkeypatch.setattr(token_orc, "FILES_BLOCK", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(None if i % 2 else 7, f"word {i} " * (i % 5)) for i in range(400)], "doc_id long, text string")
        got = sorted(op4_token_orc(docs).collect(), key=lambda r: r["start"])
        path = str(tmp_path / "t")
        write_tokens(docs, path, default_path("word_bpe_49k.json"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "t").glob("*.orc"))) >= 6          # one id doesn't go to one file
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert len(got) == 400 and [r["doc_id"] for r in got] == [None] * 200 + [7] * 200


def test_bloom_filters_and_stripes(spark, docs_df, tmp_path):
    import pyarrow.orc as orc
    path = str(tmp_path / "t")
    write_tokens(docs_df, path, default_path("word_bpe_49k.json"), end_id=7)
    files = sorted(p for p in (tmp_path / "t").glob("*.orc"))
    assert files and all(orc.ORCFile(str(p)).row_index_stride == 1000 for p in files)
    one = read_tokens(spark, path).filter("doc_id = 5").collect()
    assert len(one) == 1 and one[0]["ids"][-1] == 7


def test_sections_add_up(docs_df, spark):
    whole = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    docs = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(99, None, None, None, None)]
    got = {}
    for r in op5_token_counts(spark.createDataFrame(docs, DOC)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in docs:
        rows = sorted(got[i], key=lambda r: r["section"])
        raw = (t or "").encode()
        assert sum(r["n_tokens"] for r in rows) == len(whole.encode(t or "", add_special_tokens=False).ids)
        assert [raw[r["start"]:r["end"]] for r in rows] == split_lines(raw)
        assert [r["section"] for r in rows] == list(range(len(rows)))


def split_lines(raw):
    parts = [p + b"\n" for p in raw.split(b"\n")]
    parts[-1] = parts[-1][:-1]
    return [p for i, p in enumerate(parts) if p or i == 0]


def test_boundary_rules():
    ends, starts = np.array([2, 7, 9]), np.array([0, 3, 5])
    assert attribute(ends, starts, "first")[0].tolist() == [0, 0, 2]
    assert attribute(ends, starts, "most")[0].tolist() == [0, 1, 2]
    assert attribute(ends, starts, "first")[1].tolist() == [False, True, False]


def test_empty_table_and_extra_columns(spark):
    assert op4_token_orc(spark.createDataFrame([], DOC)).count() == 0
    assert token_counts(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(1, "a", 5, 6)], "doc_id long, text string, ids int, pos int")
    assert op4_token_orc(df).count() == 1
    with pytest.raises(ValueError):
        token_counts(df, rule="half")


def test_workers_get_small_batches(spark, docs_df, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from linklens.llm import steps, token_orc
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    for name in ("orc", "save"):
        real = getattr(DataFrameWriter, name)
        monkeypatch.setattr(DataFrameWriter, name, lambda self, *a, _real=real, **k: seen.append(
            int(spark.conf.get(key))) or _real(self, *a, **k))
    token_orc.op4_token_orc(docs_df).count()
    assert seen.count(token_orc.BATCH_ROWS) == 2 and token_orc.BATCH_ROWS < 1000
    assert spark.conf.get(key) == before
    with steps.batches_of(spark, 100):
        sizes = spark.range(1000, numPartitions=1).mapInArrow(
            lambda it: (b.select(["id"]).slice(0, 1) for b in it), "id long").count()
    assert sizes == 10
