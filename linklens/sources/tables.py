"""Scans of the driver tables and the test views built from them.

The views follow FIXTURES.md section 2: ``articles`` turns each lineitem row
into a news-article link (publisher from supplier, category and title from
part), ``predictions`` adds a noisy prediction, ``slug_map`` is the small
slug -> category parameter table. Dimension joins carry no hint: Catalyst
broadcasts supplier/part only while their file-size estimate is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles them otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.session import spread_rows

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# Fixed values of the test view (FIXTURES.md section 2): part type -> URL section.
TYPE_SECTION = {"PROMO": "business", "LARGE": "sports", "SMALL": "tech",
                "ECONOMY": "politics"}


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles(article_id, url, title, subtitle, category, publisher, language, noise)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    # narrow rows, before the URLs are made and parsed
    li = spread_rows(li, "l_orderkey", "l_partkey", "l_suppkey")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    j = (li.join(sup, li.l_suppkey == sup.s_suppkey)
           .join(part, li.l_partkey == part.p_partkey))

    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    ship = F.col("l_shipdate").cast("date").cast("string")
    name_dash = F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))
    section = F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v)) for k, v in TYPE_SECTION.items()],
                         F.lit("misc"))
    path = (F.when(ok % 8 == 0, F.concat(F.lit("/"), section, F.lit("/"),
                                         F.replace(F.substring(ship, 1, 10), F.lit("-"), F.lit("/")),
                                         F.lit("/"), name_dash, F.lit("-"), _s(pk), F.lit(".html")))
             .when(ok % 8 == 1, F.concat(F.lit("/news/"), _s(ok)))
             .when(ok % 8 == 2, F.concat(F.lit("/article/"), name_dash))
             .when(ok % 8 == 3, F.concat(F.lit("/"), _s(ok + 1000000)))
             .when(ok % 8 == 4, F.concat(F.lit("/"), F.substring(ship, 1, 4), F.lit("/"),
                                         F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))))
             .when(ok % 8 == 5, F.concat(F.lit("/m/"), F.substring(F.md5(_s(pk)), 1, 12), F.lit("/")))
             .when(ok % 8 == 6, F.concat(F.lit("/tech/latest/"), name_dash, F.lit("?page="),
                                         _s("l_linenumber")))
             .otherwise(F.lit("/")))
    scheme = F.when(ok % 97 == 0, "ftp").when(ok % 2 == 0, "https").otherwise("http")
    url = F.concat(scheme, F.lit("://www."), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit(""))),
                   F.lit(".example.com"), path)
    return j.select(
        F.concat_ws("-", _s(ok), _s("l_linenumber"), _s(pk), _s("l_suppkey")).alias("article_id"),
        url.alias("url"),
        F.col("p_name").alias("title"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("p_brand")).alias("subtitle"),
        F.col("p_type").alias("category"),
        F.col("s_name").alias("publisher"),
        F.when(ok % 3 == 0, "en").when(ok % 3 == 1, "pt").otherwise("es").alias("language"),
        ((ok * 7 + pk * 13 + F.col("l_linenumber")) % 10).alias("noise"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predictions(article_id, publisher, label, prediction); 'UNSEEN' is never a label."""
    a = articles(spark, sf_dir)
    n = F.col("noise")
    pred = (F.when(n < 7, F.col("category")).when(n == 7, "PROMO")
             .when(n == 8, "LARGE").otherwise("UNSEEN"))
    return a.select("article_id", "publisher", F.col("category").alias("label"),
                    pred.alias("prediction"))


# Fixed values (FIXTURES.md section 2): the test slug mapping in file order.
SLUG_MAP_ROWS = [(0, "news", ""), (1, "business", "PROMO"), (2, "sports", "LARGE"),
                 (3, "tech", "SMALL"), (4, "politics", "ECONOMY"), (5, "latest", "PROMO"),
                 (6, "m", "STANDARD"), (7, "Tech", "MEDIUM")]

SLUG_MAP_SCHEMA = T.StructType([
    T.StructField("slug_rank", T.IntegerType(), False),
    T.StructField("slug", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
])


def inline_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small parameter table as an inline VALUES relation: unlike an
    RDD-backed frame it carries exact size statistics, so size checks and
    broadcast decisions see its real size."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(v)
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    names = ", ".join(f.name for f in schema.fields)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def slug_map(spark: SparkSession) -> DataFrame:
    return inline_table(spark, SLUG_MAP_ROWS, SLUG_MAP_SCHEMA)


# The test view's suffix rules, one of each kind; hosts under .org have none.
SUFFIX_RULE_ROWS = [("com",), ("net",), ("org.uk",), ("example.com",), ("*.example.net",), ("!ththan.example.net",)]


def suffix_rules(spark: SparkSession) -> DataFrame:
    return inline_table(spark, SUFFIX_RULE_ROWS, T.StructType([T.StructField("rule", T.StringType(), False)]))
