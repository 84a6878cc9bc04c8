"""Placed orders as a Parquet table: appended, read by id, the last write of an id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_orders(orders: DataFrame, path: str, version: int) -> None:
    """Append a batch of orders. ``version`` grows from batch to batch."""
    orders.withColumn("_version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """The current row of every order."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("order_id", "_version")]
    return rows.groupBy("order_id").agg(F.max_by(F.struct(*rest), "_version").alias("r")).select("order_id", "r.*")


def get_order(spark: SparkSession, path: str, order_id: object) -> DataFrame:
    """One order; the id is pushed down to the files."""
    rows = spark.read.parquet(path).where(F.col("order_id") == order_id)
    return rows.orderBy(F.desc("_version")).limit(1).drop("_version")
