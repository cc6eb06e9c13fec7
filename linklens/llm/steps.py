"""Step tables: intermediate results of a multi-step operator.

Each step is written once as Parquet under the folder named by
``spark.checkpoint.dir`` and read back. That cuts the lineage, survives lost
executors (the files are shared) and gives the next step real sizes. The write
also releases its own shuffle files when it ends, and a step that is no longer
needed can be dropped, so an operator's peak disk is that of its largest step.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from linklens.session import ensure_checkpoint_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, jobs send Python workers at most ``rows`` rows at once: Spark's default of
    10,000 is a whole partition of texts, held by the JVM and the worker several times over."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Steps:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self._paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
        """Write ``df`` and read it back."""
        path = self.path(name)
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.format(fmt).save(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).format(fmt).load(path)
        self._paths[id(out)] = path
        out._step_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_step_path", None)
            if path:
                p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                p.getFileSystem(conf).delete(p, True)
