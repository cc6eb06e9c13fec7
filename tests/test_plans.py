"""Plan properties the scale design relies on."""

from pyspark.sql import functions as F

from linklens.session import broadcast_if_small, plan_size_bytes
from linklens.sources import loaders as L
from linklens.sources import tables as T


def test_url_prefix_pushed_to_parquet_and_share_filter_sees_all_rows(spark, tmp_path):
    rows = [("http://a.com/x/%d" % i, "t", "s", "y", "c%d" % (i % 3), "p") for i in range(30)]
    rows += [("ftp://a.com/x/%d" % i, "t", "s", "y", "c0", "p") for i in range(30)]
    path = str(tmp_path / "raw")
    spark.createDataFrame(rows, "URL string, Titulo string, Subtitulo string, Sumario string, "
                                "Categoria string, PUBLISHER string").write.parquet(path)
    out = L.load_articles(spark.read.parquet(path), "recognasumm", min_share=0.2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(URL,http)" in plan
    # c0 holds 40 of 60 rows (ftp rows count in the total), c1/c2 10 each (< 20 %)
    assert {r.category for r in out.collect()} == {"c0"} and out.count() == 10


def test_broadcast_only_when_small(spark):
    small = T.slug_map(spark)
    assert plan_size_bytes(small) < 10_000
    left = spark.range(100).withColumn("slug", F.when(F.col("id") % 2 == 0, "tech").otherwise("m"))
    joined = left.join(broadcast_if_small(small), "slug")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastExchange" in plan
    big = spark.range(10).withColumn("slug", F.lit("x"))
    assert broadcast_if_small(big, max_bytes=1) is big


def test_materialize_roundtrip_and_cleanup(spark):
    from linklens.session import drop_materialized, ensure_checkpoint_dir, materialize
    import os
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and plan_size_bytes(df) < 100_000
    root = ensure_checkpoint_dir(spark)
    drop_materialized(spark)
    assert not os.path.exists(os.path.join(root, "linklens-tables"))


def test_compressed_table_is_measured_before_a_broadcast(spark):
    from linklens.session import materialize, measured_bytes
    same = F.array(*[F.lit(0.5)] * 12).alias("logp")
    table = materialize(spark.range(200_000).select("id", same))
    size = plan_size_bytes(table)
    assert 256 * 1024 < size < 8 << 20 and measured_bytes(table) > 16 << 20
    assert broadcast_if_small(table, 8 << 20) is table
    assert broadcast_if_small(table, 64 << 20) is not table


def test_articles_of_a_file_of_one_row_group_are_made_by_many_tasks(spark, tmp_path):
    n = 60_000
    (spark.range(n, numPartitions=1).select(
        "id", F.xxhash64("id").alias("l_orderkey"), (F.col("id") % 10).alias("l_partkey"),
        (F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
        F.lit("2024-01-02").cast("date").alias("l_shipdate")).drop("id")
     .write.parquet(str(tmp_path / "lineitem.parquet")))
    spark.range(7).select(F.col("id").alias("s_suppkey"), F.lit("Supplier#1").alias("s_name")).write.parquet(
        str(tmp_path / "supplier.parquet"))
    spark.range(10).select(F.col("id").alias("p_partkey"), F.lit("red tin").alias("p_name"), F.lit("b").alias("p_brand"),
                           F.lit("PROMO").alias("p_type")).write.parquet(str(tmp_path / "part.parquet"))
    scan = T.read_table(spark, str(tmp_path), "lineitem")
    assert scan.rdd.getNumPartitions() == 1
    a = T.articles(spark, str(tmp_path))
    assert a.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert a.count() == n and a.select("article_id").distinct().count() == n
