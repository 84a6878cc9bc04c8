"""Inputs of the engine's queries, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(k: Column) -> Column:
    """A made code: 7 to 11 hex digits, some with a bad character."""
    text = F.substring(F.md5(k.cast("string").cast("binary")), F.lit(1), (F.lit(7) + k % 5).cast("int"))
    return F.concat(text, F.when(k % 11 == 0, "-").otherwise(""))


def coded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(code, src)`` of three sources, with repeats within a source."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).where("k % 3 <> 0").withColumn("src", F.lit(0))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).where("k % 2 = 0").withColumn("src", F.lit(1))
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).where("k % 5 <> 0").withColumn("src", F.lit(2))
    return a.unionByName(b).unionByName(c).select(code_of(F.col("k")).alias("code"), "src")


LINES = """lines AS (
  SELECT substr(md5(CAST(k AS VARCHAR)), 1, CAST(7 + k % 5 AS INTEGER)) || CASE WHEN k % 11 = 0 THEN '-' ELSE '' END AS code, src FROM (
    SELECT o_custkey AS k, 0 AS src FROM orders WHERE o_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT user_id, 2 FROM events WHERE user_id % 5 <> 0))"""
VALID = LINES + """, valid AS (
  SELECT code FROM lines WHERE regexp_full_match(code, '[0-9A-Za-z]{8,10}') GROUP BY code HAVING count(DISTINCT src) >= 2)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, price)`` in cents."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"))


_ROW = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def order_requests(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    """Nested order requests. ``broken`` shifts quantities and ids into the invalid."""
    k, q = F.col("l_partkey"), F.col("l_quantity").cast("int")
    product, quantity = k.cast("string"), q
    if broken:
        product = F.when(k % 17 == 0, "").when(k % 13 == 0, (k + 1_000_000).cast("string")).otherwise(k.cast("string"))
        quantity = q * 3 - 10
    # the sort key is the whole row, so that repeated line numbers don't matter
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*_ROW).alias("o"), F.struct(product.alias("productId"), quantity.alias("quantity")).alias("item"))
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("o", "item"))).alias("s")).select("l_orderkey", F.transform("s", lambda x: x["item"]).alias("items"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_custkey") % 4 != 0, code_of(F.col("o_custkey"))).alias("couponCode"))
    return orders.join(items, F.col("order_id") == F.col("l_orderkey"), "left").select("order_id", "couponCode", "items")


_ORDER = ", ".join(_ROW)


def requests_sql(broken: bool) -> str:
    """The same requests, one row per line, and one per order, for DuckDB."""
    product = "CASE WHEN l_partkey % 17 = 0 THEN '' WHEN l_partkey % 13 = 0 THEN CAST(l_partkey + 1000000 AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END" if broken else "CAST(l_partkey AS VARCHAR)"
    quantity = "CAST(l_quantity AS INTEGER) * 3 - 10" if broken else "CAST(l_quantity AS INTEGER)"
    return f"""items AS (
  SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS i, {product} AS pid, {quantity} AS q FROM lineitem),
products AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM part),
codes AS (
  SELECT o_orderkey AS order_id, CASE WHEN o_custkey % 4 <> 0 THEN substr(md5(CAST(o_custkey AS VARCHAR)), 1, CAST(7 + o_custkey % 5 AS INTEGER)) || CASE WHEN o_custkey % 11 = 0 THEN '-' ELSE '' END ELSE '' END AS code
  FROM orders)"""
