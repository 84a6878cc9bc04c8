"""Keys that occur in at least N of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import well_formed


def source_counts(rows: DataFrame, key: str, source: str, sources: int | None = None) -> DataFrame:
    """``(key, n_sources)``: in how many distinct sources each key occurs.

    ``source`` is a dense number from 0.  Up to 63 sources are one bit each of a long:
    one shuffle of (key, bits) after partial aggregation on the map side, whatever the
    number of repeats.  Beyond that, distinct (key, source) pairs are counted.
    """
    if sources is not None and sources <= 63:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(source).cast("int"))
        return rows.groupBy(key).agg(F.bit_count(F.bit_or(bit)).cast("long").alias("n_sources"))
    return rows.select(key, source).distinct().groupBy(key).agg(F.count("*").alias("n_sources"))


def in_at_least(rows: DataFrame, key: str, source: str, least: int, sources: int | None = None, accept: Column | None = None) -> DataFrame:
    """The keys accepted by ``accept`` that occur in ``least`` sources or more."""
    kept = rows if accept is None else rows.where(accept)
    return source_counts(kept, key, source, sources).where(F.col("n_sources") >= least).select(key)


def valid_codes(lines: DataFrame, least: int = 2, sources: int | None = None) -> DataFrame:
    """The sorted codes of ``lines(code, src)`` that are well formed and in ``least`` sources."""
    return in_at_least(lines, "code", "src", least, sources, well_formed(F.col("code"))).orderBy("code")


def source_duplicates(lines: DataFrame) -> DataFrame:
    """Per source: lines, distinct lines, and the repeats among them."""
    once = lines.groupBy("src", "code").agg(F.count("*").alias("n"))
    out = once.groupBy("src").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_distinct"))
    return out.withColumn("n_repeats", F.col("n_lines") - F.col("n_distinct"))
