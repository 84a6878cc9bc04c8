"""Promo-code expressions: format, rejection reason, and a packed 60-bit form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code format, and the symbols in packed order (1 to 62; 0 pads).
MIN_LENGTH, MAX_LENGTH = 8, 10
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PATTERN = rf"\A[0-9A-Za-z]{{{MIN_LENGTH},{MAX_LENGTH}}}\z"


def well_formed(code: Column) -> Column:
    """Whether a code has 8 to 10 ASCII letters or digits. Null is not well formed."""
    return F.coalesce(code.rlike(PATTERN), F.lit(False))


def reject_reason(code: Column) -> Column:
    """Why a code is rejected, or null: by length in bytes first, then by character."""
    size = F.octet_length(F.coalesce(code, F.lit("")))
    return (
        F.when(size < MIN_LENGTH, F.lit("short")).when(size > MAX_LENGTH, F.lit("long")).when(~F.coalesce(code, F.lit("")).rlike(r"\A[0-9A-Za-z]*\z"), F.lit("character"))
    )


def pack(code: Column) -> Column:
    """Six bits per symbol, left-aligned in 60: equal order as numbers and as bytes. Null if ill formed."""
    digits = F.transform(F.split(F.rpad(code, MAX_LENGTH, " "), ""), lambda c: F.instr(F.lit(SYMBOLS), c).cast("long"))
    value = F.aggregate(F.slice(digits, 1, MAX_LENGTH), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 6).bitwiseOR(x))
    return F.when(well_formed(code), value)


def unpack(value: Column) -> Column:
    """The code of a packed value."""
    places = F.array(*[F.lit(6 * i) for i in range(MAX_LENGTH - 1, -1, -1)])
    symbol = F.transform(places, lambda s: F.call_function("shiftright", value, s).bitwiseAND(F.lit(63)).cast("int"))
    return F.array_join(F.transform(symbol, lambda i: F.when(i > 0, F.substring(F.lit(SYMBOLS), i, F.lit(1))).otherwise(F.lit(""))), "")
