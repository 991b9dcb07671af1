"""A relation with dirt made from a key, the same way in Spark and in SQL: the given tables hold no missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 13 == 0, "N/A").when(k % 11 == 0, "").when(k % 7 == 0, None).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        status.alias("status"),
        F.when(k % 97 == 0, "N/A").otherwise(F.col("o_custkey").cast("string")).alias("custkey_raw"),
        F.when(k % 89 == 0, "not a date").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("orderdate_raw"),
        F.when(k % 83 == 0, "1,000").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("price_raw"),
    )


DIRTY_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("custkey_raw", T.LongType()),
    T.StructField("orderdate_raw", T.DateType()),
    T.StructField("price_raw", T.DecimalType(12, 2)),
])

DIRTY_SQL = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 97 = 0 THEN 'N/A' ELSE CAST(o_custkey AS VARCHAR) END AS custkey_raw,
  CASE WHEN o_orderkey % 89 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS orderdate_raw,
  CASE WHEN o_orderkey % 83 = 0 THEN '1,000' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS price_raw
FROM orders
"""


def bad_sql(name: str, kind: str) -> str:
    return f"({name} IS NOT NULL AND trim({name}) <> '' AND TRY_CAST({name} AS {kind}) IS NULL)"


BAD_SQL = {"custkey_raw": bad_sql("custkey_raw", "BIGINT"), "orderdate_raw": bad_sql("orderdate_raw", "DATE"), "price_raw": bad_sql("price_raw", "DECIMAL(12,2)")}
ANY_BAD_SQL = "(" + " OR ".join(BAD_SQL.values()) + ")"
