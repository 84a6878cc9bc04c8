"""Classification of request records: bodies, keys, ids, statuses."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.text import media_type

MAX_BODY = 64 << 10
#: Error types and texts by status.
ERROR_TYPES = {
    400: "bad_request", 401: "unauthorized", 403: "forbidden", 404: "not_found", 405: "method_not_allowed", 422: "validation_error", 429: "rate_limited", 500: "internal_error", 503: "unavailable",
}
STATUS_TEXTS = {
    200: "ok", 201: "created", 204: "no content", 400: "bad request", 401: "unauthorized", 403: "forbidden", 404: "not found", 405: "method not allowed", 409: "conflict", 413: "request entity too large", 415: "unsupported media type", 422: "unprocessable entity", 429: "too many requests", 500: "internal server error", 502: "bad gateway", 503: "service unavailable", 504: "gateway timeout",
}
QUIET_PATHS = ("/health", "/ready")
REQUEST_ID = r"\A[A-Za-z0-9._-]{1,64}\z"


def _table(values: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def error_type(status: Column) -> Column:
    return F.coalesce(_table(ERROR_TYPES)[status], F.lit("error"))


def error_body(status: Column, message: Column) -> Column:
    """``(code, type, message)``; an unknown failure is a 500 that tells nothing."""
    hidden = status.isNull() | (status == 0) | (status == 500)
    code = F.when(hidden, F.lit(500)).otherwise(status)
    text = F.when(hidden, F.lit("internal server error")).when(F.coalesce(message, F.lit("")) != "", message).otherwise(F.coalesce(_table(STATUS_TEXTS)[code], F.lit("")))
    return F.struct(code.alias("code"), error_type(code).alias("type"), text.alias("message"))


def log_level(path: Column, status: Column) -> Column:
    return F.when(path.isin(*QUIET_PATHS), "debug").when(status == 503, "warn").when(status >= 500, "error").otherwise("info")


def request_id(value: Column) -> Column:
    """The given id if it is safe to repeat, else null."""
    return F.when(value.rlike(REQUEST_ID), value)


def product_id_status(value: Column, known: Column) -> Column:
    """``(id, status)``: 400 unless a 64-bit integer, 404 unless ``known``, else 200."""
    number = F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value.try_cast("bigint"))
    return F.struct(number.cast("string").alias("id"), F.when(number.isNull(), 400).when(known, 200).otherwise(404).alias("status"))


def authorise(requests: DataFrame, keys: DataFrame, scope: str, key: str = "api_key") -> DataFrame:
    """``requests`` with ``status`` and ``message``; ``keys`` has ``(key_sha256, scopes)``.

    Keys are compared by their SHA-256.  No key or an unknown one is a 401, a key
    without the scope a 403.
    """
    given = F.coalesce(F.col(key), F.lit("")) != ""
    joined = requests.withColumn("_sha", F.when(given, F.sha2(F.col(key), 256))).join(keys.select(F.col("key_sha256").alias("_sha"), F.col("scopes").alias("_scopes")), "_sha", "left")
    status = F.when(~given | F.col("_scopes").isNull(), 401).when(~F.array_contains("_scopes", scope), 403).otherwise(200)
    message = F.when(~given, "missing api_key header").when(F.col("_scopes").isNull(), "invalid api key").when(status == 403, f"api key lacks the {scope} scope")
    return joined.withColumn("status", status).withColumn("message", message).drop("_sha", "_scopes")


_ORDER_FIELDS = {"couponCode": (str, "string"), "items": (list, "[]order.Item")}
_ITEM_FIELDS = {"productId": (str, "string"), "quantity": (int, "int")}
_COUPON_FIELDS = {"couponCode": (str, "string")}
_BLANK = " \t\r\n"
#: Deeper nesting is refused as invalid.
MAX_DEPTH = 10_000
_JSON_TOKEN = re.compile(r'''[ \t\r\n]*+(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)|(true|false|null))''')

#: Equal brackets, a string (an open one with all that follows), or what has neither.
_JSON_RUN = re.compile(r'''\[++|\{++|\]++|\}++|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\Z)|[^"\[\]{}]++''', re.DOTALL)


class Pairs(list):
    """The members of a JSON object in order, repeats included."""


class Invalid(ValueError):
    """Text that no more text could make valid JSON."""


class Incomplete(ValueError):
    """Text that ends within a JSON value."""


def _refuse(name: str) -> None:
    raise Invalid(name)


def _int(text: str) -> int:
    return int(text) if len(text) < 25 else 1 << 80  # any number beyond 64 bits


_DECODER = json.JSONDecoder(object_pairs_hook=Pairs, parse_constant=_refuse, parse_int=_int)


def _scan(text: str) -> tuple[object, int]:
    """The first JSON value of a text and its end, without recursion."""
    at, stack, root = 0, [], None
    want = "value"  # or: first (value or end), key, first key, colon, next (comma or end)
    while True:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            rest = text[at:].lstrip(_BLANK)
            literal = any(x.startswith(rest) for x in ("true", "false", "null", "-"))
            raise (Incomplete if not rest or literal or re.fullmatch(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+(?:\\(?:u[0-9a-fA-F]{0,3})?)?', rest) else Invalid)(text[at : at + 20])
        at = m.end()
        mark, string, number, literal = m.groups()
        if mark in ("]", "}"):
            if not stack or isinstance(stack[-1][0], Pairs) != (mark == "}") or want not in ("next", "first", "first key"):
                raise Invalid(mark)
            value = stack.pop()[0]
        elif mark == ",":
            if want != "next":
                raise Invalid(mark)
            want = "key" if isinstance(stack[-1][0], Pairs) else "value"
            continue
        elif mark == ":":
            if want != "colon":
                raise Invalid(mark)
            want = "value"
            continue
        elif want in ("key", "first key"):
            if string is None:
                raise Invalid(m[0])
            stack[-1][1], want = json.loads(string), "colon"
            continue
        elif want not in ("value", "first"):
            raise Invalid(m[0])
        elif mark:
            if len(stack) >= MAX_DEPTH:
                raise Invalid("depth")
            stack.append([Pairs() if mark == "{" else [], None])
            want = "first key" if mark == "{" else "first"
            continue
        else:
            value = json.loads(string) if string else {"true": True, "false": False, "null": None}[literal] if literal else _int(number) if re.fullmatch("-?[0-9]+", number) else float(number)
        if not stack:
            return value, at
        holder, key = stack[-1]
        holder.append((key, value) if isinstance(holder, Pairs) else value)
        want = "next"


def _too_deep(text: str) -> bool:
    """Whether brackets alone show that ``_scan`` finds the first value invalid: one opens below ``MAX_DEPTH`` others.

    Up to the scanner's first error the depths are its own, and behind one the text is
    invalid anyway.
    """
    if len(text) <= MAX_DEPTH or text.count("[") + text.count("{") <= MAX_DEPTH:
        return False
    depth = 0
    for m in _JSON_RUN.finditer(text):
        run = m[0]
        if run[0] in "[{":
            depth += len(run)
            if depth > MAX_DEPTH:
                return True
        elif run[0] in "]}":
            depth -= len(run)
        if depth <= 0:
            return False
    return False


def _first_value(text: str, cut: bool) -> tuple[object, int]:
    """The first JSON value of a text and its end; only of a ``cut`` one does it matter whether more text could mend it."""
    if _too_deep(text):
        raise Invalid("depth")
    try:
        return _DECODER.raw_decode(text)
    except RecursionError:
        return _scan(text)
    except ValueError as e:
        if cut:
            return _scan(text)
        raise Invalid(text[:20]) from e


def _clean(text: str) -> str:
    """A decoded string; halves of surrogate pairs become U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _assign(fields: dict, record: Pairs, prefix: str, out: dict) -> str | None:
    """Set the fields that a JSON object names, in any case; the first of a wrong type is what is returned."""
    named: dict = {}
    for key, value in record:
        if key in fields:
            name = key
        else:
            named = named or {k.casefold(): k for k in fields}
            name = named.get(key.casefold())
        if name is None:
            continue
        kind, says = fields[name]
        if value is None:
            if kind is list:
                out[name] = None
            continue
        if not isinstance(value, kind) or isinstance(value, Pairs) or (kind is int and (isinstance(value, bool) or not -(1 << 63) <= value < 1 << 63)):
            return f"{prefix}{name} must be of type {says}"
        if kind is list:
            items = []
            for item in value:
                if item is not None and not isinstance(item, Pairs):
                    return f"{prefix}{name} must be of type order.Item"
                items.append({"productId": "", "quantity": 0})
                if found := _assign(_ITEM_FIELDS, item or Pairs(), f"{prefix}{name}.", items[-1]):
                    return found
            out[name] = items
        else:
            out[name] = _clean(value) if kind is str else value
    return None


def read_body(body: str | None, fields: dict) -> tuple[str | None, dict]:
    """Why a body is refused, or None, and the fields it sets: one pass for both.

    The body is one JSON object of at most ``MAX_BODY`` bytes.  A value that is whole
    within them is judged before what follows it.
    """
    out: dict = {}
    text, long = body or "", False
    if len(text) > MAX_BODY // 4 and len(raw := text.encode()) > MAX_BODY:
        text, long = raw[:MAX_BODY].decode(errors="ignore"), True
    text = text.lstrip(_BLANK)
    too_long = f"body must not exceed {MAX_BODY} bytes"
    if not text:
        return too_long if long else "body must not be empty", out
    try:
        value, end = _first_value(text, long)
    except Incomplete:
        return too_long if long else "body is not valid JSON", out
    except Invalid:
        return "body is not valid JSON", out
    if value is not None and not isinstance(value, Pairs):
        return "body must be a JSON object", out
    if found := _assign(fields, value or Pairs(), "", out):
        return found, out
    if long or text[end:].strip(_BLANK):
        return "body must contain a single JSON object", out
    return None, out


_ITEMS = "array<struct<productId:string,quantity:bigint>>"


def _bodies(fields: dict, schema: str) -> Callable[[Column], Column]:
    kind = to_arrow_type(StructType.fromDDL(schema))

    def read(body: pa.Array) -> pa.Array:
        rows = []
        for b in body.to_pylist():
            problem, values = read_body(b, fields)
            rows.append({"problem": problem} if problem else values)
        return pa.array(rows, kind)

    return F.arrow_udf(read, schema)


def _decoded(requests: DataFrame, content_type: str, body: str, fields: dict, schema: str) -> DataFrame:
    """Bodies by a Python function on Arrow batches: Spark's parser coerces types, keeps case and ignores what follows a value."""
    wrong = F.coalesce(media_type(F.col(content_type)) != "application/json", F.lit(True))
    read = requests.withColumn("_body", _bodies(fields, schema)(F.when(~wrong, F.col(body))))
    problem = F.when(wrong, F.lit("Content-Type must be application/json")).otherwise(F.col("_body.problem"))
    return read.withColumn("problem", problem).withColumns({name: F.col(f"_body.{name}") for name in fields}).drop("_body")


def order_bodies(requests: DataFrame, content_type: str = "content_type", body: str = "body") -> DataFrame:
    """``requests`` with the decoded ``couponCode`` and ``items``, or the ``problem`` that answers 400."""
    return _decoded(requests, content_type, body, _ORDER_FIELDS, f"problem string, couponCode string, items {_ITEMS}")


def coupon_bodies(requests: DataFrame, content_type: str = "content_type", body: str = "body") -> DataFrame:
    """``requests`` with the decoded ``couponCode``, or the ``problem`` that answers 400."""
    return _decoded(requests, content_type, body, _COUPON_FIELDS, "problem string, couponCode string")


def access_log(requests: DataFrame) -> DataFrame:
    """``(level, line)``: the JSON log line of ``(method, path, status, bytes, duration_ns, ip, user_agent, err, request_id)``."""
    failed = F.when(F.col("status") >= 500, F.col("err"))
    line = F.struct(F.upper(log_level(F.col("path"), F.col("status"))).alias("level"), F.lit("request").alias("msg"), "method", "path", "status", "bytes", F.col("duration_ns").alias("duration"), "ip", "user_agent", failed.alias("err"), F.nullif("request_id", F.lit("")).alias("request_id"))
    return requests.select("*", log_level(F.col("path"), F.col("status")).alias("level"), F.to_json(line).alias("line"))
