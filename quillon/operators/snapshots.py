"""Comparison of folder snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change)`` of files added, removed or changed between ``(path, size, mod_ns)`` tables."""
    b, a = (df.select("path", F.struct("size", "mod_ns").alias(name)) for df, name in ((before, "b"), (after, "a")))
    both = b.join(a, "path", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def same_snapshot(before: DataFrame, after: DataFrame) -> bool:
    return snapshot_diff(before, after).isEmpty()


def stable_loads(polls: DataFrame) -> DataFrame:
    """``polls(poll, fp)`` with ``load``: a fingerprint seen twice in a row that isn't the one loaded last.

    The last loaded fingerprint before a poll is that of the latest earlier pair of
    equal polls.  One row per poll: a single ordered pass.
    """
    from pyspark.sql import Window

    order = Window.orderBy("poll")
    twice = polls.withColumn("twice", F.lag("fp").over(order) == F.col("fp"))
    loaded = F.last(F.when(F.col("twice"), F.col("fp")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return twice.withColumn("load", F.coalesce("twice", F.lit(False)) & ~F.coalesce(loaded == F.col("fp"), F.lit(False))).drop("twice")
