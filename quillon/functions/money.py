"""Money in integer cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apply_percent(cents: Column, percent: Column | int) -> Column:
    """A share of an amount, half cents up."""
    p = F.lit(percent) if isinstance(percent, int) else percent
    return _div(cents.cast("long") * p.cast("long") + F.lit(50))


def _div(value: Column) -> Column:
    """Integer division by 100, towards zero, without a detour over doubles."""
    return ((value - value % 100).cast("decimal(20,0)") / 100).cast("long")


def amount(cents: Column) -> Column:
    """Cents as a double, for output only."""
    return cents / F.lit(100.0)


def render(cents: Column) -> Column:
    """The shortest decimal text: 700 is 7, 650 is 6.5, 1999 is 19.99."""
    whole = (cents.cast("decimal(20,0)") / F.lit(100)).cast("decimal(20,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(whole, r"0+\z", ""), r"\.\z", "")
