"""Writers (S11-S17). All are distributed writes; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Generic sink: parquet (default) or CSV with a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_split(df: DataFrame, path: str, split: str = "test", fmt: str = "csv") -> None:
    """One split of a split-assigned table."""
    write_table(df.where(F.col("split") == split).drop("split"), path, fmt)


def write_run_metrics(tables: dict[str, DataFrame], root: str, run_id: str,
                      fmt: str = "parquet") -> None:
    """The metric tables (macro, topic, domain, domain_topic) of one run, stamped
    with run_id, under root/<name>/run_id=<id>. A run written again replaces its own
    partition and leaves the others."""
    for name, df in tables.items():
        w = (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
               .option("partitionOverwriteMode", "dynamic").partitionBy("run_id"))
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(f"{root.rstrip('/')}/{name}")


def write_mapping_template(template: DataFrame, path: str) -> None:
    """Slug,category CSV for hand labelling (one file, ordered by count)."""
    (template.orderBy(F.col("n").desc(), "slug").select("slug", "category")
             .coalesce(1).write.mode("overwrite").option("header", True).csv(path))


def export_columns(df: DataFrame, path: str, columns: list[str], where=None, fmt: str = "csv") -> None:
    """A filtered column subset of a result table."""
    out = df.where(where) if where is not None else df
    write_table(out.select(*columns), path, fmt)
