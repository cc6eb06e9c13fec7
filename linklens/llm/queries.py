"""Registered queries of the subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linklens.llm.chosen_path import op6_near_dedup
from linklens.llm.decontaminate import OP10_SQL, op10_decontaminate
from linklens.llm.html_extract import op7_html_extract
from linklens.llm.lm_scoring import op3_lm_scoring
from linklens.llm.merkle import OP12_SQL, op12_merkle_manifest
from linklens.llm.mixing import OP2_SQL, op2_source_mixing
from linklens.llm.quality import op9_quality_rules
from linklens.llm.spelling import OP13_SQL, op13_spelling_variants
from linklens.llm.substring_dedup import op1_substring_dedup
from linklens.llm.suffix_index import op8_suffix_dedup
from linklens.llm.token_counts import op5_token_counts
from linklens.llm.token_orc import op4_token_orc
from linklens.llm.topk_search import OP11_SQL, op11_exact_topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


QUERIES = {
    "op1_substring_dedup": lambda spark, d: op1_substring_dedup(_table(spark, d, "documents")),
    "op2_source_mixing": lambda spark, d: op2_source_mixing(_table(spark, d, "documents")),
    "op3_lm_scoring": lambda spark, d: op3_lm_scoring(
        _table(spark, d, "documents"), _table(spark, d, "labels"), order=3),
    "op4_token_orc": lambda spark, d: op4_token_orc(_table(spark, d, "documents")),
    "op5_token_counts": lambda spark, d: op5_token_counts(_table(spark, d, "documents")),
    "op6_near_dedup": lambda spark, d: op6_near_dedup(_table(spark, d, "documents")),
    "op7_html_extract": lambda spark, d: op7_html_extract(_table(spark, d, "pages")),
    "op8_suffix_dedup": lambda spark, d: op8_suffix_dedup(_table(spark, d, "documents")),
    "op9_quality_rules": lambda spark, d: op9_quality_rules(
        _table(spark, d, "documents"), _table(spark, d, "labels")),
    "op10_decontaminate": lambda spark, d: op10_decontaminate(
        _table(spark, d, "documents"), _table(spark, d, "benchmark")),
    "op11_exact_topk": lambda spark, d: op11_exact_topk(_table(spark, d, "embeddings")),
    "op12_merkle_manifest": lambda spark, d: op12_merkle_manifest(_table(spark, d, "documents")),
    "op13_spelling_variants": lambda spark, d: op13_spelling_variants(_table(spark, d, "documents")),
}
ORACLES = {
    "op2_source_mixing": OP2_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_exact_topk": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
