"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each end of an edge paired with the least vertex near its start."""
    return edges.join(stored(least, "least"), "u")


@settled("components")
def smallest_reachable(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of non-null longs to ``(vertex, component)``, the smallest vertex reachable.

    Alternates large-star and small-star steps until nothing changes; the number
    of rounds grows with the logarithm of the largest component.  Every step is
    an aggregation and an equi-join, and each round's edges are a stored table.
    Loops and repeated edges are ignored.  Vertices without edges are absent.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    now = stored(clean, "edges")
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large star: larger neighbours of u move to the least of u's neighbourhood
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("least"))
        large = _star(both, least).where("w > u").select(F.col("w").alias("v"), F.col("least").alias("m")).distinct()
        large = stored(large, "large-star")
        # small star: smaller neighbours of u, and u, move to the least of them
        down = large.select(F.col("v").alias("u"), F.col("m").alias("w"))
        least = down.groupBy("u").agg(F.min("w").alias("least"))
        small = _star(down, least).select(F.explode(F.array("u", "w")).alias("v"), F.col("least").alias("m")).where("v <> m").distinct()
        now = stored(small, "small-star")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("m").alias("vertex"), F.col("m").alias("component")).distinct()
    return now.select(F.col("v").alias("vertex"), F.col("m").alias("component")).unionByName(roots)
