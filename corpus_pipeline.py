"""The training-corpus pipeline: five stages over the documents, in order.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame; ``run`` writes every stage's rows as Parquet in the
shared folder of ``spark.checkpoint.dir`` and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm.chosen_path import near_duplicates
from linklens.llm.decontaminate import contamination
from linklens.llm.mixing import mix_documents
from linklens.llm.quality import fit_quality, score
from linklens.llm.steps import Steps
from linklens.llm.token_orc import op4_token_orc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    return score(docs, model).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 %): its
    smallest doc_id, by ties and without ids the smallest text hash. Rows that repeat that
    document leave one."""
    groups = near_duplicates(docs, shingle=5, percent=80)
    # equal keys on both sides, so that repeated rows meet in one partition
    def key(df: DataFrame, th) -> list:
        return [F.coalesce(df["doc_id"].cast("long"), F.lit(0)).alias("k"),
                df["doc_id"].isNull().alias("k_null"), th.alias("k_th")]

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       *key(docs, F.xxhash64(F.coalesce(docs["text"], F.lit("")))))
    drop = (groups.filter(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("component_th"))))
            .select(*key(groups, groups["th"])).distinct())
    keys = ["k", "k_null", "k_th"]
    return rows.join(drop, keys, "left_anti").dropDuplicates(keys).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage by the contamination rule."""
    return (contamination(docs, _table(spark, sf_dir, "benchmark"))
            .filter("NOT contaminated").select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every taken copy of every document."""
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixture written as ORC; per document its place, length and checksum."""
    return op4_token_orc(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("token_output", token_output)]

# Fitted rules, similarity components and a tokenizer: no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    steps = Steps(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs, before = steps.table(stage(spark, docs, sf_dir), name), docs
        steps.drop(before)
    return docs
