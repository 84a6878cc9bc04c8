"""Code lookups with the outcomes valid, invalid and unavailable."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import well_formed


def coupon_outcomes(requests: DataFrame, valid: DataFrame, code: str = "code", percent: int = 10, ready: bool = True) -> DataFrame:
    """``requests`` with ``status`` and ``discount_percent``.

    An ill-formed code is invalid without a lookup.  Before the valid set is ready, a
    well-formed one is unavailable.  The join is left to the optimiser: the valid set
    is broadcast if it is small, else both sides are shuffled by code.
    """
    good = well_formed(F.col(code))
    if not ready:
        status = F.when(good, F.lit("unavailable")).otherwise(F.lit("invalid"))
        return requests.withColumn("status", status).withColumn("discount_percent", F.lit(None).cast("int"))
    known = valid.select(F.col("code").alias("_valid")).distinct()
    joined = requests.join(known, good & (F.col(code) == F.col("_valid")), "left")
    found = F.col("_valid").isNotNull()
    out = joined.withColumn("status", F.when(found, F.lit("valid")).otherwise(F.lit("invalid")))
    return out.withColumn("discount_percent", F.when(found, F.lit(percent))).drop("_valid")


#: Bytes of an answer that are read.
MAX_ANSWER = 4 << 10


def base_url(url: str) -> str:
    """A code service's address without a slash at its end. ValueError unless it is an absolute http(s) URL."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError(f"coupons URL {url!r} must be an absolute http(s) URL")
    return url.removesuffix("/")


def recorded_outcomes(answers: DataFrame, code: str = "code") -> DataFrame:
    """``answers(code, http_status, body)`` of a code service with ``status`` and ``discount_percent``.

    An ill-formed code is invalid whatever is recorded; 200 with a readable body is
    valid, 404 invalid, and anything else, a null status included, unavailable.
    """
    schema = "code string, discountPercent long"
    read = F.from_json(F.when(F.octet_length("body") <= MAX_ANSWER, F.col("body")), schema + ", bad string", {"columnNameOfCorruptRecord": "bad"})
    found = answers.withColumn("_read", read)
    fine = F.col("_read").isNotNull() & F.col("_read.bad").isNull()
    status = F.when(~F.coalesce(well_formed(F.col(code)), F.lit(False)), "invalid").when((F.col("http_status") == 200) & fine, "valid").when(F.col("http_status") == 404, "invalid").otherwise("unavailable")
    percent = F.when(F.col("status") == "valid", F.coalesce(F.col("_read.discountPercent"), F.lit(0)))
    return found.withColumn("status", status).withColumn("discount_percent", percent.cast("int")).drop("_read")


def valid_only(requests: DataFrame, valid: DataFrame, code: str = "code") -> DataFrame:
    """The requests whose code is in the valid set."""
    return requests.join(valid.select(F.col("code").alias("_valid")), F.col(code) == F.col("_valid"), "left_semi")


def coupon_response(status: Column, code: Column, percent: Column) -> Column:
    """The answer as JSON; ``discountPercent`` is left out if not valid or 0, and all of it if unavailable."""
    shown = F.when((status == "valid") & (percent != 0), percent)
    body = F.to_json(F.struct(code.alias("couponCode"), (status == "valid").alias("valid"), shown.alias("discountPercent")))
    return F.when(status != "unavailable", body)
