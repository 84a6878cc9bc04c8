"""The engine's queries by name, and each in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, money, network, text
from ..operators import lookup, orders, requests, snapshots, state, threshold
from ..sources import products as product_source
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DAY_US = 86_400_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# keys in several sources


@query(f"WITH {fx.VALID} SELECT code FROM valid ORDER BY code")
def threshold_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed codes in at least two of three sources, sorted."""
    return threshold.valid_codes(fx.coded_lines(spark, sf_dir), 2, 3)


@query(f"WITH {fx.LINES} SELECT DISTINCT code FROM lines WHERE regexp_full_match(code, '[0-9A-Za-z]{{8,10}}')")
def threshold_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed codes in any source."""
    return threshold.valid_codes(fx.coded_lines(spark, sf_dir), 1, 3)


@query(f"WITH {fx.LINES} SELECT code FROM lines WHERE regexp_full_match(code, '[0-9A-Za-z]{{8,10}}') GROUP BY code HAVING count(DISTINCT src) = 3")
def threshold_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed codes in every source."""
    return threshold.valid_codes(fx.coded_lines(spark, sf_dir), 3, 3)


@query("""SELECT l_partkey AS key FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 20""")
def threshold_many_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts delivered by at least 20 suppliers: the form for any number of sources."""
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("src"))
    return threshold.in_at_least(rows, "key", "src", 20)


@query(f"""WITH {fx.LINES} SELECT src, count(*) AS n_lines, count(DISTINCT code) AS n_distinct, count(*) - count(DISTINCT code) AS n_repeats FROM lines GROUP BY src""")
def source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, distinct lines and repeats of each source."""
    return threshold.source_duplicates(fx.coded_lines(spark, sf_dir))


@query(f"""WITH {fx.LINES} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(code) < 8 THEN 'short' WHEN length(code) > 10 THEN 'long'
  WHEN NOT regexp_full_match(code, '[0-9A-Za-z]*') THEN 'character' ELSE 'accepted' END AS reason FROM lines) GROUP BY reason""")
def code_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines are accepted, and why others are not."""
    reason = F.coalesce(codes.reject_reason(F.col("code")), F.lit("accepted"))
    return fx.coded_lines(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {fx.VALID}, digits AS (SELECT code, list_transform(range(1, 11), lambda i: CASE WHEN i <= length(code) THEN instr('{codes.SYMBOLS}', substr(code, CAST(i AS INTEGER), 1)) ELSE 0 END) AS d FROM valid)
  SELECT code, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(d, lambda x: CAST(x AS BIGINT))), lambda a, x: a * 64 + x) AS BIGINT) AS packed, code AS unpacked FROM digits""")
def code_pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid codes, packed into a number and back, in the number's order."""
    valid = threshold.in_at_least(fx.coded_lines(spark, sf_dir), "code", "src", 2, 3, codes.well_formed(F.col("code")))
    return valid.withColumn("packed", codes.pack(F.col("code"))).withColumn("unpacked", codes.unpack(F.col("packed"))).orderBy("packed")


# lookups


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select("c_custkey", fx.code_of(F.col("c_custkey")).alias("code"))


_ASKED = "asked AS (SELECT c_custkey, substr(md5(CAST(c_custkey AS VARCHAR)), 1, CAST(7 + c_custkey % 5 AS INTEGER)) || CASE WHEN c_custkey % 11 = 0 THEN '-' ELSE '' END AS code FROM customer)"


@query(f"""WITH {fx.VALID}, {_ASKED} SELECT c_custkey, code, CASE WHEN v.code IS NULL THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN v.code IS NOT NULL THEN 10 END AS discount_percent,
  '{{"couponCode":"' || code || CASE WHEN v.code IS NULL THEN '","valid":false}}' ELSE '","valid":true,"discountPercent":10}}' END AS body FROM asked LEFT JOIN valid v USING (code)""")
def coupon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's code against the valid set, with the answer's body."""
    valid = threshold.in_at_least(fx.coded_lines(spark, sf_dir), "code", "src", 2, 3, codes.well_formed(F.col("code")))
    out = lookup.coupon_outcomes(_asked(spark, sf_dir), valid)
    return out.withColumn("body", lookup.coupon_response(F.col("status"), F.col("code"), F.col("discount_percent")))


@query(f"""WITH {_ASKED} SELECT c_custkey, code, CASE WHEN regexp_full_match(code, '[0-9A-Za-z]{{8,10}}') THEN 'unavailable' ELSE 'invalid' END AS status FROM asked""")
def coupon_lookup_not_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same before a valid set is loaded."""
    asked = _asked(spark, sf_dir)
    return lookup.coupon_outcomes(asked, asked.limit(0), ready=False).drop("discount_percent")


@query(f"WITH {fx.VALID}, {_ASKED} SELECT c_custkey, code FROM asked WHERE code IN (SELECT code FROM valid)")
def coupon_valid_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose code is valid."""
    valid = threshold.in_at_least(fx.coded_lines(spark, sf_dir), "code", "src", 2, 3, codes.well_formed(F.col("code")))
    return lookup.valid_only(_asked(spark, sf_dir), valid)


# orders


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.in_at_least(fx.coded_lines(spark, sf_dir), "code", "src", 2, 3, codes.well_formed(F.col("code")))


_PRICED = f"""WITH {fx.VALID}, {fx.requests_sql(False)},
priced AS (SELECT order_id, count(*) AS n, CAST(sum(price * q) AS BIGINT) AS subtotal FROM items JOIN products ON pid = id GROUP BY order_id),
stated AS (SELECT c.order_id, n, subtotal, c.code, v.code IS NOT NULL AS good FROM codes c LEFT JOIN priced p ON p.order_id = c.order_id LEFT JOIN valid v ON v.code = c.code)"""


@query(f"""{_PRICED} SELECT order_id, subtotal, CAST(CASE WHEN code <> '' THEN (subtotal * 10 + 50) // 100 ELSE 0 END AS BIGINT) AS discounts,
  CAST(subtotal - CASE WHEN code <> '' THEN (subtotal * 10 + 50) // 100 ELSE 0 END AS BIGINT) AS total FROM stated WHERE n IS NOT NULL AND (code = '' OR good)""")
def order_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of all orders that can be placed."""
    out = orders.place_orders(fx.order_requests(spark, sf_dir, False), fx.products(spark, sf_dir), _valid(spark, sf_dir))
    return out.where("status = 200").select("order_id", "subtotal", "discounts", "total")


@query(f"""WITH {fx.requests_sql(False)}, firsts AS (SELECT order_id, pid, min(i) AS i FROM items GROUP BY order_id, pid)
  SELECT order_id, string_agg(pid, ',' ORDER BY i) AS products FROM firsts GROUP BY order_id""")
def order_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct products of each order in the order of their first item."""
    asked = fx.order_requests(spark, sf_dir, False).where("items is not null")
    ids = F.array_distinct(F.transform("items", lambda x: x["productId"]))
    return asked.select("order_id", F.array_join(ids, ",").alias("products"))


@query(f"""WITH {fx.VALID}, {fx.requests_sql(True)},
counts AS (SELECT c.order_id, code, count(i) AS n FROM codes c LEFT JOIN items USING (order_id) GROUP BY c.order_id, code),
shape AS (SELECT order_id, string_agg(p, '; ' ORDER BY i, k) AS problems FROM (
  SELECT order_id, i, 0 AS k, 'items[' || i || '].productId: is required' AS p FROM items WHERE pid = ''
  UNION ALL SELECT order_id, i, 1, 'items[' || i || '].quantity: must be between 1 and 100' FROM items WHERE q < 1 OR q > 100) GROUP BY order_id),
missing AS (SELECT order_id, string_agg('items[' || i || '].productId: product "' || pid || '" not found', '; ' ORDER BY i) AS problems FROM items LEFT JOIN products ON pid = id WHERE id IS NULL GROUP BY order_id),
staged AS (SELECT c.order_id, CASE WHEN n = 0 THEN 'items: must contain at least one item' WHEN n > 6 THEN 'items: must contain at most 6 items' ELSE s.problems END AS shape_problems, m.problems AS missing_problems,
  c.code <> '' AND v.code IS NULL AS bad FROM counts c LEFT JOIN shape s USING (order_id) LEFT JOIN missing m USING (order_id) LEFT JOIN valid v ON v.code = c.code)
SELECT order_id, CASE WHEN shape_problems IS NULL AND missing_problems IS NULL AND NOT bad THEN 200 ELSE 422 END AS status,
  CASE WHEN shape_problems IS NOT NULL THEN 'shape' WHEN missing_problems IS NOT NULL THEN 'products' WHEN bad THEN 'coupon' ELSE 'placed' END AS stage,
  coalesce(shape_problems, missing_problems, CASE WHEN bad THEN 'couponCode: is not a valid coupon' END) AS problems FROM staged""")
def order_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and problems of orders with shifted quantities and ids."""
    out = orders.place_orders(fx.order_requests(spark, sf_dir, True), fx.products(spark, sf_dir), _valid(spark, sf_dir), max_items=6)
    return out.select("order_id", "status", "stage", "problems")


@query("""SELECT l_orderkey, pid AS product_id FROM (SELECT l_orderkey, CASE WHEN l_partkey % 13 = 0 THEN CAST(l_partkey + 1000000 AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS pid FROM lineitem)
  WHERE pid NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)""")
def unknown_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a product that doesn't exist."""
    k = F.col("l_partkey")
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(k % 13 == 0, (k + 1_000_000).cast("string")).otherwise(k.cast("string")).alias("product_id"))
    return orders.unknown_products(lines, fx.products(spark, sf_dir))


@query("""SELECT p_partkey, c AS cents, c / 100.0::DOUBLE AS amount, regexp_replace(regexp_replace(CAST(CAST(c AS DECIMAL(20,0)) / 100 AS DECIMAL(20,2))::VARCHAR, '0+$', ''), '\\.$', '') AS text,
  (c * 7 + 50) // 100 AS seven_percent FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)""")
def money_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices as cents, doubles and shortest text, and seven per cent of them."""
    c = F.col("cents")
    base = fx.table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    return base.select("p_partkey", "cents", money.amount(c).alias("amount"), money.render(c).alias("text"), money.apply_percent(c, 7).alias("seven_percent"))


# products


@query("SELECT p_partkey, p_name, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM part")
def product_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products in order of their number."""
    part = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.round(F.col("p_retailprice") * 100).cast("long").alias("price"))
    return product_source.product_list(part.withColumn("n", F.col("p_partkey")))


_IDS = ("1", "7", "007", "+9", "0", "-1", "abc", "1.5", " 7 ", "99999999999999999999", "4000000")


@query(f"""WITH asked AS (SELECT unnest({list(_IDS)}) AS asked), parsed AS (SELECT asked, CASE WHEN regexp_full_match(asked, '[+-]?[0-9]+') THEN try_cast(asked AS BIGINT) END AS n FROM asked)
  SELECT asked, CAST(n AS VARCHAR) AS id, CASE WHEN n IS NULL THEN 400 WHEN p_partkey IS NULL THEN 404 ELSE 200 END AS status FROM parsed LEFT JOIN part ON n = p_partkey""")
def product_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path ids against the products: 200, 400 or 404."""
    asked = spark.createDataFrame([(i,) for i in _IDS], "asked string")
    asked = asked.withColumn("id", requests.product_id_status(F.col("asked"), F.lit(True))["id"])
    known = fx.products(spark, sf_dir).select(F.col("id").alias("_id"))
    joined = asked.join(known, F.col("id") == F.col("_id"), "left")
    return joined.select("asked", "id", requests.product_id_status(F.col("asked"), F.col("_id").isNotNull())["status"].alias("status"))


# the catalogue as it must be, written out apart from the code's own table
@query("""SELECT CAST(i AS VARCHAR) AS id, name, coalesce(category, split_part(name, ' ', -1)) AS category, CAST(cents AS BIGINT) AS price,
  'https://orderfoodonline.deno.dev/public/images/image-' || coalesce(image, lower(split_part(name, ' ', -1))) || '-thumbnail.jpg' AS thumbnail
  FROM (VALUES (9, 'Vanilla Panna Cotta', 'Panna Cotta', 650, 'panna-cotta'), (8, 'Salted Caramel Brownie', NULL, 550, NULL), (7, 'Red Velvet Cake', NULL, 450, NULL), (6, 'Lemon Meringue Pie', NULL, 500, 'meringue'),
    (5, 'Pistachio Baklava', NULL, 400, NULL), (4, 'Classic Tiramisu', NULL, 550, NULL), (3, 'Macaron Mix of Five', 'Macaron', 800, 'macaron'), (2, 'Vanilla Bean Crème Brûlée', 'Crème Brûlée', 700, 'creme-brulee'),
    (1, 'Waffle with Berries', 'Waffle', 650, 'waffle')) AS t(i, name, category, cents, image)""")
def demo_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo catalogue."""
    return product_source.demo_products(spark).select("id", "name", "category", "price", F.col("image.thumbnail").alias("thumbnail"))


# requests


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column."""
    return fx.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH asked AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'key-' || CAST(user_id % 7 AS VARCHAR) END AS api_key FROM events)
  SELECT event_id, CASE WHEN api_key = '' THEN 401 WHEN api_key IN ('key-0', 'key-1') THEN 200 WHEN api_key = 'key-2' THEN 403 ELSE 401 END AS status,
  CASE WHEN api_key = '' THEN 'missing api_key header' WHEN api_key IN ('key-0', 'key-1') THEN NULL WHEN api_key = 'key-2' THEN 'api key lacks the create_order scope' ELSE 'invalid api key' END AS message FROM asked""")
def auth_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and scopes of requests."""
    asked = fx.table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("key-"), (F.col("user_id") % 7).cast("string"))).alias("api_key"))
    given = spark.createDataFrame([("key-0:create_order, key-1:create_order|read,key-2:read",)], "t string")
    keys = given.select(F.explode(text.parse_keys(F.col("t"))).alias("e")).select(F.sha2("e.key", 256).alias("key_sha256"), F.col("e.scopes").alias("scopes"))
    return requests.authorise(asked, keys, "create_order").select("event_id", "status", "message")


_STATUS = "[0, 200, 400, 401, 403, 404, 405, 418, 422, 429, 500, 502, 503]"


@query(f"""WITH s AS (SELECT event_id, {_STATUS}[1 + event_id % 13] AS status FROM events), c AS (SELECT event_id, CASE WHEN status IN (0, 500) THEN 500 ELSE status END AS code FROM s)
  SELECT event_id, code, CASE WHEN code = 400 THEN 'bad_request' WHEN code = 401 THEN 'unauthorized' WHEN code = 403 THEN 'forbidden' WHEN code = 404 THEN 'not_found' WHEN code = 405 THEN 'method_not_allowed'
    WHEN code = 422 THEN 'validation_error' WHEN code = 429 THEN 'rate_limited' WHEN code = 500 THEN 'internal_error' WHEN code = 503 THEN 'unavailable' ELSE 'error' END AS type,
  CASE WHEN code = 200 THEN 'ok' WHEN code = 400 THEN 'bad request' WHEN code = 401 THEN 'unauthorized' WHEN code = 403 THEN 'forbidden' WHEN code = 404 THEN 'not found' WHEN code = 405 THEN 'method not allowed'
    WHEN code = 422 THEN 'unprocessable entity' WHEN code = 429 THEN 'too many requests' WHEN code = 500 THEN 'internal server error' WHEN code = 502 THEN 'bad gateway' WHEN code = 503 THEN 'service unavailable' ELSE '' END AS message FROM c""")
def error_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses as error bodies."""
    statuses = F.array(*[F.lit(int(x)) for x in _STATUS.strip("[]").split(", ")])
    status = F.element_at(statuses, (F.col("event_id") % 13 + 1).cast("int"))
    return fx.table(spark, sf_dir, "events").select("event_id", requests.error_body(status, F.lit(None).cast("string")).alias("b")).select("event_id", "b.code", "b.type", "b.message")


@query("""SELECT event_id, CASE WHEN path IN ('/health', '/ready') THEN 'debug' WHEN status = 503 THEN 'warn' WHEN status >= 500 THEN 'error' ELSE 'info' END AS level
  FROM (SELECT event_id, ['/health', '/api/order', '/ready', '/api/product'][1 + event_id % 4] AS path, [200, 500, 503, 404, 502][1 + event_id % 5] AS status FROM events)""")
def log_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each request's log line."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    return fx.table(spark, sf_dir, "events").select(
        "event_id", requests.log_level(pick(["/health", "/api/order", "/ready", "/api/product"], 4), pick([200, 500, 503, 404, 502], 5)).alias("level")
    )


@query("""SELECT page_id, i, CASE WHEN regexp_full_match(part, '[A-Za-z0-9._-]{1,64}') THEN part END AS request_id FROM (
  SELECT page_id, unnest(string_split(url, '/')) AS part, generate_subscripts(string_split(url, '/'), 1) AS i FROM pages)""")
def request_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of URLs as request ids: kept or dropped."""
    parts = fx.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("url", "/")).alias("i", "part"))
    return parts.select("page_id", (F.col("i") + 1).cast("long").alias("i"), requests.request_id(F.col("part")).alias("request_id"))


@query("""SELECT c_custkey, 'k' || c_custkey || i AS key, CASE i WHEN 0 THEN 'create_order' WHEN 1 THEN '' ELSE 'read|s' || c_custkey % 5 END AS scopes FROM customer, unnest(range(0, 1 + c_custkey % 3)) AS t(i)""")
def key_config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured key lists, with blanks around and between, as rows."""
    k = F.col("c_custkey").cast("string")
    parts = [F.concat(F.lit(" k"), k, F.lit("0:create_order")), F.concat(F.lit(" ,, k"), k, F.lit("1: ")), F.concat(F.lit(",k"), k, F.lit("2: read ||s"), (F.col("c_custkey") % 5).cast("string"), F.lit("| "))]
    given = F.concat_ws(",", F.slice(F.array(*parts), F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int")))
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", F.explode(text.parse_keys(given)).alias("e"))
    return rows.select("c_custkey", "e.key", F.array_join("e.scopes", "|").alias("scopes"))


@query("""WITH b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_quantity ORDER BY l_linenumber, l_suppkey) AS n, l_partkey AS p, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
  k AS (SELECT *, (l_orderkey + p + q) % 12 AS kind FROM b)
  SELECT l_orderkey, p, q, CASE kind WHEN 1 THEN 'items.productId must be of type string' WHEN 2 THEN 'items.quantity must be of type int' WHEN 3 THEN 'items.quantity must be of type int'
    WHEN 4 THEN 'body must contain a single JSON object' WHEN 5 THEN 'body is not valid JSON' WHEN 6 THEN 'body must be a JSON object' WHEN 7 THEN 'body is not valid JSON' WHEN 8 THEN 'Content-Type must be application/json'
    WHEN 9 THEN 'body must not be empty' END AS problem, CASE WHEN kind IN (0, 10, 11) THEN 'C' || p END AS coupon, CASE WHEN kind IN (0, 10, 11) THEN CAST(p AS VARCHAR) END AS product_id, CASE WHEN kind IN (0, 10, 11) THEN CAST(q AS BIGINT) END AS quantity FROM k""")
def order_body_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order bodies of twelve kinds: why each is refused, and what the others hold, names in any case."""
    line = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p"), F.col("l_quantity").cast("int").alias("q"))
    line = line.repartition("l_orderkey", "p", "q")  # a small file is one task, but its bodies are a hundred times its size
    p, q, kind = F.col("p").cast("string"), F.col("q").cast("string"), (F.col("l_orderkey") + F.col("p") + F.col("q")) % 12
    body = lambda item, more="", names=("couponCode", "items"): F.concat(F.lit(f'{{"{names[0]}":"C'), p, F.lit(f'","{names[1]}":[{{'), *item, F.lit(f"}}]{more}}}"))
    plain = [F.lit('"productId":"'), p, F.lit('","quantity":'), q]
    bodies = [
        body(plain), body([F.lit('"productId":'), p]), body([F.lit('"quantity":"'), q, F.lit('"')]), body([F.lit('"quantity":'), q, F.lit(".5")]), F.concat(body(plain), F.lit(" {}")), body(plain, ',"x":NaN'),
        F.concat(F.lit("["), body(plain), F.lit("]")), F.concat(F.lit('{"x":'), F.repeat(F.lit("["), 11_000), F.lit("1"), F.repeat(F.lit("]"), 11_000), F.lit("}")), body(plain), F.lit(" \n\t"),
        F.concat(F.lit(" "), body([F.lit('"PRODUCTID":"'), p, F.lit('","Quantity":'), q], ',"note":[[[{"a":null}]]]', ("couponcode", "ITEMS")), F.lit("\r\n")), F.concat(F.lit('{"items":[{}],'), F.substring(body(plain), 2, 1_000)),
    ]
    chosen, media = F.lit(None).cast("string"), F.when(kind == 8, "text/plain").otherwise("application/json; charset=utf-8")
    for i, b in enumerate(bodies):
        chosen = F.when(kind == i, b).otherwise(chosen)
    read = requests.order_bodies(line.select("l_orderkey", "p", "q", media.alias("content_type"), chosen.alias("body")))
    return read.select("l_orderkey", "p", "q", "problem", F.col("couponCode").alias("coupon"), F.col("items")[0]["productId"].alias("product_id"), F.col("items")[0]["quantity"].alias("quantity"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.' || u % 256 || '.7' WHEN 1 THEN '10.1.' || u % 256 || '.7' WHEN 2 THEN '2001:db8:' || printf('%x', u % 16) || ':1::/64' ELSE 'client-' || u END AS client
  FROM (SELECT event_id, user_id AS u FROM events)""")
def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-limit buckets of client addresses."""
    u = F.col("user_id")
    octet, group = (u % 256).cast("string"), F.lower(F.hex(u % 16))
    kinds = [F.concat(F.lit("10.0."), octet, F.lit(".7")), F.concat(F.lit("::ffff:10.1."), octet, F.lit(".7")), F.concat(F.lit("2001:db8:"), group, F.lit(":1:ff::"), group), F.concat(F.lit("client-"), u.cast("string"))]
    ip = F.element_at(F.array(*kinds), (F.col("event_id") % 4 + 1).cast("int"))
    return fx.table(spark, sf_dir, "events").select("event_id", network.client_key(ip).alias("client"))


# snapshots and state


@query("""WITH b AS (SELECT 'f' || p_partkey AS path, p_size AS size, p_partkey AS mod_ns FROM part WHERE p_partkey % 7 <> 0),
  a AS (SELECT 'f' || p_partkey AS path, p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS size, p_partkey AS mod_ns FROM part WHERE p_partkey % 9 <> 0)
  SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.mod_ns <> b.mod_ns""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that differ between two snapshots."""
    k = F.col("p_partkey")
    part = fx.table(spark, sf_dir, "part")
    path = F.concat(F.lit("f"), k.cast("string")).alias("path")
    before = part.where("p_partkey % 7 <> 0").select(path, F.col("p_size").cast("long").alias("size"), k.alias("mod_ns"))
    after = part.where("p_partkey % 9 <> 0").select(path, (F.col("p_size") + F.when(k % 10 == 0, 1).otherwise(0)).cast("long").alias("size"), k.alias("mod_ns"))
    return snapshots.snapshot_diff(before, after)


_RATE = 2


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  f AS (SELECT event_id, user_id, t, rn, CAST({_RATE * DAY_US} - {DAY_US} AS BIGINT) AS tokens, true AS passed FROM e WHERE rn = 1
    UNION ALL SELECT event_id, user_id, t, rn, CASE WHEN have >= {DAY_US} THEN have - {DAY_US} ELSE have END, have >= {DAY_US} FROM (
      SELECT e.event_id, e.user_id, e.t, e.rn, CAST(least({_RATE * DAY_US}, f.tokens + (e.t - f.t) * {_RATE}) AS BIGINT) AS have FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
  SELECT event_id, CAST(user_id AS VARCHAR) AS client, passed FROM f""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a bucket of two a day lets pass."""
    out = state.rate_limit(fx.table(spark, sf_dir, "events"), _RATE, DAY_US, "user_id", "ts", "event_id")
    return out.select(F.col("id").alias("event_id"), F.col("k").alias("client"), F.col("flag").alias("passed"))


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
    CASE WHEN user_id % 3 <> 0 THEN {5 * DAY_US} ELSE {DAY_US} END AS ttl FROM events),
  f AS (SELECT event_id, user_id, rn, CAST(t + ttl AS BIGINT) AS expires, false AS hit FROM e WHERE rn = 1
    UNION ALL SELECT e.event_id, e.user_id, e.rn, CAST(CASE WHEN e.t < f.expires THEN f.expires ELSE e.t + e.ttl END AS BIGINT), e.t < f.expires FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
  SELECT event_id, CAST(user_id AS VARCHAR) AS code, hit FROM f""")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups answered from a cache of five days for valid and one day for invalid answers."""
    asked = fx.table(spark, sf_dir, "events").withColumn("valid", F.col("user_id") % 3 != 0)
    out = state.cached_answers(asked, 5 * DAY_US, DAY_US, "user_id", "ts", "event_id", check_codes=False)
    return out.select(F.col("id").alias("event_id"), F.col("k").alias("code"), F.col("flag").alias("hit"))


from . import service  # noqa: E402, F401  registers its queries
