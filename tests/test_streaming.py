"""Row-level labelling on a stream gives the batch answer."""

import os

from linklens.operators import slugs as SL
from linklens.sources import tables as T
from linklens.streaming import labeling as S


def test_label_stream_matches_batch(spark, tmp_path):
    rows = [(str(i), u, "t", "c", "p") for i, u in enumerate(
        ["http://h/tech/latest/x", "http://h/a/sports/", "http://h/none/", "http://h/x?u=/m"])]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, S.ARTICLE_STREAM_SCHEMA).write.parquet(src)
    stream = S.read_article_stream(spark, src)
    q = S.write_labels(S.label_stream(stream, T.slug_map(spark)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r.article_id: (r.distant_label, r.mapped_category)
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = S.label_stream(spark.read.parquet(src), T.slug_map(spark))
    want = {r.article_id: (r.distant_label, r.mapped_category) for r in batch.collect()}
    assert got == want and got["0"] == ("SMALL", "SMALL") and got["3"] == ("unknown", "STANDARD")


def test_structure_counts_stream_complete_mode(spark, tmp_path):
    rows = [(str(i), u, "t", "c", "p") for i, u in enumerate(
        ["http://h/news/story", "http://h/1234567", "http://h/x", "http://h/a/b/c", "http://h/y"])]
    src = str(tmp_path / "in2")
    spark.createDataFrame(rows, S.ARTICLE_STREAM_SCHEMA).write.parquet(src)
    agg = S.structure_counts_stream(S.read_article_stream(spark, src))
    q = (agg.writeStream.format("memory").queryName("url_type_counts").outputMode("complete")
            .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.url_type: r.n for r in spark.sql("SELECT * FROM url_type_counts").collect()}
    assert got == {"semantic_structured": 1, "id_based": 1, "simple": 2, "mixed": 1}
