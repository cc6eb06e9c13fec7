"""Streaming use of the row-level operators.

The reference has no streaming operator; what carries over is that every
row-level operator (URL parsing, structure flags, feature text) is a pure
projection, which runs unchanged on ``readStream`` input. The slug lookups
(J6, J7) join the mapping and regroup, so they are applied to each
micro-batch; a batch is written to a folder of its own number, which a
replayed batch overwrites, so the output holds every article once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.functions import urls as U
from linklens.operators import slugs as SL
from linklens.operators import structure as ST

ARTICLE_STREAM_SCHEMA = T.StructType([
    T.StructField("article_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("publisher", T.StringType()),
])


def read_article_stream(spark: SparkSession, path: str, schema: T.StructType = ARTICLE_STREAM_SCHEMA,
                        fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


@dataclass(frozen=True)
class LabelledStream:
    """A stream whose micro-batches are to be labelled by ``mapping``."""
    stream: DataFrame
    mapping: DataFrame
    url: str


def label_articles(articles: DataFrame, mapping: DataFrame, url: str = "url") -> DataFrame:
    """URL parts, structure type, weak label (J6) and mapping match (J7) per article."""
    s = articles.withColumn("netloc", U.url_netloc(url)).withColumn("path", U.url_path(url))
    s = s.withColumn("url_type", U.structure_columns("path")["url_type"])
    s = SL.weak_labels(s, mapping, url)
    return SL.mapped_category(s, mapping, url, "mapped_category")


def label_stream(stream: DataFrame, mapping: DataFrame, url: str = "url") -> DataFrame | LabelledStream:
    """``label_articles`` of a table, or of each micro-batch of a stream when it is written."""
    if stream.isStreaming:
        return LabelledStream(stream, mapping, url)
    return label_articles(stream, mapping, url)


def write_labels(labelled: LabelledStream, path: str, checkpoint: str, trigger_once: bool = True):
    """Write the labelled micro-batches as parquet, one folder ``batch=N`` each."""
    def write(batch: DataFrame, number: int) -> None:
        (label_articles(batch, labelled.mapping, labelled.url)
         .write.mode("overwrite").parquet(f"{path}/batch={number}"))

    w = labelled.stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def structure_counts_stream(stream: DataFrame, url: str = "url") -> DataFrame:
    """Running count per URL type (a stateful aggregate, complete mode)."""
    s = ST.url_structure(stream, url, keep=())
    return s.groupBy("url_type").agg(F.count(F.lit(1)).alias("n"))
