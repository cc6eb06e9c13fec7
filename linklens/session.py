"""Session construction, checkpoint location and size-checked broadcasts."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Broadcast ceiling for sides whose size is only known from plan statistics.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
# Files above this size are measured before they are broadcast.
MEASURE_BYTES = 256 * 1024
# Of the size estimate, what one task of a spread table gets; smaller tables stay as they are.
SPREAD_BYTES = 2 * 1024 * 1024
NO_ESTIMATE = 1 << 50    # above it the estimate is Spark's default for a plan without one


def build_session(master: str | None = None, app: str = "linklens",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with what correctness needs. A local master also gets partitions and driver
    memory for one machine; with master=None whatever the job was submitted with stays."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        conf["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by spark.checkpoint.dir.

    A folder of our own is made only when the setting is unset and the
    master is local (tests, bench); on a cluster an unset value is an error,
    since a machine-local folder does not survive a lost executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="linklens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # core confs may be read-only at runtime; the context keeps it
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def plan_size_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (an upper bound for scans,
    filters and projections); None when it cannot be read."""
    try:
        v = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(v) if isinstance(v, int) else int(v.toString())
    except Exception:  # pragma: no cover - e.g. Spark Connect
        return None


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all cores, by ``keys`` or in turn, in as many parts as their size asks for.
    Parquet is split at its row groups only: a file of one group is read by one task, which
    would do all the work up to the next shuffle as well."""
    size = plan_size_bytes(df)
    if size is not None and size <= MEASURE_BYTES:
        return df
    parts = df.sparkSession.sparkContext.defaultParallelism
    if size is not None and size <= NO_ESTIMATE:
        parts = max(parts, math.ceil(size / SPREAD_BYTES))
    return df.repartition(parts, *keys)


def _reads_files_only(df: DataFrame) -> bool:
    """Whether the plan is a scan, projected and filtered, and so cheap to measure."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m.group(1) for m in (re.match(r"[\s:+\-]*([A-Z]\w+)", line) for line in plan.splitlines()) if m}
    return nodes <= {"Project", "Filter", "Relation", "RelationV2"}


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows in memory, by one aggregate: files are smaller, by their encoding and
    compression, often tenfold where values repeat."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            size = 24 + 8 * F.coalesce(F.size(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = 24 + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = 16 + F.coalesce(F.octet_length(c), F.lit(0))
        else:
            size = F.lit(8)
        width = width + size.cast("long")
    return df.agg(F.sum(width + F.lit(16))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the plan's size estimate is below ``max_bytes``, and for a
    table in files, whose estimate is their compressed size, its measured rows too.

    Beyond it the join stays a shuffle join, which AQE may still turn into a
    broadcast from runtime statistics or split when a key is skewed.
    """
    size = plan_size_bytes(df)
    if size is None or size > max_bytes:
        return df
    if size > MEASURE_BYTES and _reads_files_only(df) and measured_bytes(df) > max_bytes:
        return df
    return F.broadcast(df)


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a side whose row count has a proven bound that does not grow
    with the data (one-row totals, top-k lists, shares above a threshold,
    fixed parameter tables). Callers state the bound at the call site."""
    return F.broadcast(df)


def materialize(df: DataFrame) -> DataFrame:
    """Write a shared sub-result (e.g. a small aggregate read by several
    branches of one query, or a fitted model's statistics) once as a parquet
    table in the shared folder named by spark.checkpoint.dir, and read it
    back. One computation (an eager RDD checkpoint of an unpersisted plan
    computes it twice), the lineage is cut, the files survive lost executors,
    and the read-back carries exact size statistics for broadcast checks."""
    root = ensure_checkpoint_dir(df.sparkSession)
    path = f"{root.rstrip('/')}/linklens-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._table_path = path
    return out


def table_path(table: DataFrame) -> str:
    """Where materialize() wrote a table."""
    return table._table_path


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_materialized(spark: SparkSession) -> None:
    """Remove the tables written by materialize() (end of a job)."""
    root = ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/linklens-tables")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)
