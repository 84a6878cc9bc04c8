"""Queries of sources, stored tables, request handling and helpers, each in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network, text
from ..operators import api, lookup, requests, snapshots, state, threshold
from ..sources import lines, order_table
from ..storage import new_path
from . import fixtures as fx
from .queries import DAY_US, query


@query(f"WITH {fx.VALID} SELECT code FROM valid ORDER BY code")
def file_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid codes of three folders of files: text, gzip, and text with carriage returns."""
    coded, folders = fx.coded_lines(spark, sf_dir), []
    for i, kind in enumerate(({}, {"gzip": True}, {"line_end": "\r\n"})):
        folders.append(new_path(spark, f"codes-{i}"))
        lines.write_lines(coded.where(F.col("src") == i), folders[-1], **kind)
    return threshold.valid_codes(lines.read_sources(spark, folders), 2, 3)


@query("""SELECT 'a' AS source, true AS some_bytes, count(*) AS n_lines FROM orders WHERE o_custkey % 3 <> 0""")
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's files as listed, and the lines in them; hidden files and marks of writers don't count."""
    folder = new_path(spark, "lines")
    lines.write_lines(fx.coded_lines(spark, sf_dir).where("src = 0"), folder, gzip=True)
    listed = {path: info for path, info in lines.list_files(folder, spark).items() if not path.rpartition("/")[2].startswith("_")}
    counted = lines.read_lines(spark, folder).agg(F.count("*").alias("n_lines"))
    return counted.select(F.lit("a").alias("source"), F.lit(bool(listed) and all(size > 0 for size, _ in listed.values())).alias("some_bytes"), "n_lines")


_ORDERS = "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders"


def _saved_orders(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "order-table")
    first = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total"))
    order_table.save_orders(first, path, 1)
    order_table.save_orders(first.where("order_id % 3 = 0").withColumn("status", F.lit("changed")), path, 2)
    return path


@query(_ORDERS)
def order_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders saved in two batches: the last one of an id counts."""
    return order_table.read_orders(spark, _saved_orders(spark, sf_dir))


@query(f"SELECT * FROM ({_ORDERS}) WHERE order_id = 9")
def order_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved order by its id."""
    return order_table.get_order(spark, _saved_orders(spark, sf_dir), 9)


_PATHS = "['/api/product/', '/api/coupon/validate', '/api/order', '/health', '/api/nowhere', '/api/openapi.yaml', '/api/coupon/validate', '/api/order']"


@query(f"""WITH {fx.VALID}, r AS (SELECT event_id, event_id % 8 AS kind, user_id AS u, substr(md5(CAST(user_id AS VARCHAR)), 1, CAST(7 + user_id % 5 AS INTEGER)) || CASE WHEN user_id % 11 = 0 THEN '-' ELSE '' END AS code FROM events),
  a AS (SELECT r.*, v.code IS NOT NULL AS good, p_partkey IS NOT NULL AS known, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM r LEFT JOIN valid v ON v.code = r.code LEFT JOIN part ON p_partkey = u * 20)
  SELECT event_id, CASE kind WHEN 0 THEN CASE WHEN known THEN 200 ELSE 404 END WHEN 1 THEN 200 WHEN 2 THEN CASE WHEN NOT known OR NOT good THEN 422 ELSE 200 END WHEN 3 THEN 405 WHEN 4 THEN 404 WHEN 5 THEN 200 WHEN 6 THEN 400
    ELSE CASE WHEN u % 2 = 0 THEN 401 ELSE 403 END END AS status,
  CASE WHEN kind = 0 AND NOT known THEN 'product not found' WHEN kind = 2 AND NOT known THEN 'items[0].productId: product "' || u * 20 || '" not found' WHEN kind = 2 AND NOT good THEN 'couponCode: is not a valid coupon'
    WHEN kind = 3 THEN 'method not allowed' WHEN kind = 4 THEN 'not found' WHEN kind = 6 THEN 'body is not valid JSON' WHEN kind = 7 AND u % 2 = 0 THEN 'missing api_key header' WHEN kind = 7 THEN 'api key lacks the create_order scope' END AS message,
  CASE WHEN kind = 1 THEN good END AS valid, CASE WHEN kind = 2 AND known AND good THEN (3 * price - (3 * price * 10 + 50) // 100) / 100.0::DOUBLE END AS total FROM a""")
def respond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of requests through the whole API: statuses, messages and what the answers hold."""
    events = fx.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", (F.col("event_id") % 8).alias("kind"), fx.code_of(F.col("user_id")).alias("code"))
    part, kind = (F.col("user_id") * 20).cast("string"), F.col("kind")
    paths = F.array(*[F.lit(x) for x in _PATHS.strip("[]").replace("'", "").split(", ")])
    coupon = F.concat(F.lit('{"couponCode":"'), F.col("code"), F.lit('"}'))
    order = F.concat(F.lit('{"couponCode":"'), F.col("code"), F.lit('","items":[{"productId":"'), part, F.lit('","quantity":3}]}'))
    rows = events.select(
        F.col("event_id").alias("id"), "ts", F.when(kind.isin(0, 4, 5), "GET").otherwise("POST").alias("method"),
        F.concat(F.element_at(paths, (kind + 1).cast("int")), F.when(kind == 0, part).otherwise("")).alias("path"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("client"), F.when(kind == 2, "apitest").when((kind == 7) & (F.col("user_id") % 2 == 1), "readonly").alias("api_key"),
        F.lit("application/json").alias("content_type"), F.when(kind == 1, coupon).when(kind.isin(2, 7), order).when(kind == 6, "{").alias("body"),
    )
    keys = spark.createDataFrame([("apitest", ["create_order"]), ("readonly", [])], "key string, scopes array<string>").select(F.sha2("key", 256).alias("key_sha256"), "scopes")
    valid = threshold.valid_codes(fx.coded_lines(spark, sf_dir), 2, 3)
    many = api.Limits(coupon=(1_000_000_000, DAY_US), order=(1_000_000_000, DAY_US))
    out = api.respond(rows, fx.products(spark, sf_dir), valid, keys, many, spec="openapi: 3.1.0")
    fine = lambda field, kind: F.when(F.col("status") == 200, F.from_json("body", f"{field} {kind}")[field])
    message = F.when(F.col("status") != 200, F.get_json_object("body", "$.message"))
    return out.select(F.col("id").alias("event_id"), "status", message.alias("message"), fine("valid", "boolean").alias("valid"), fine("total", "double").alias("total"))


@query(f"""WITH RECURSIVE e AS (SELECT event_id, substr(md5(CAST(user_id AS VARCHAR)), 1, CAST(7 + user_id % 5 AS INTEGER)) || CASE WHEN user_id % 11 = 0 THEN '-' ELSE '' END AS code, epoch_us(ts) AS t,
    CASE WHEN event_id % 4 = 0 THEN 0 WHEN user_id % 3 <> 0 THEN {5 * DAY_US} ELSE {DAY_US} END AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, user_id FROM events),
  f AS (SELECT event_id, code, user_id, rn, CAST(CASE WHEN ttl > 0 THEN t + ttl ELSE 0 END AS BIGINT) AS expires, false AS hit FROM e WHERE rn = 1 AND regexp_full_match(code, '[0-9A-Za-z]{{8,10}}')
    UNION ALL SELECT e.event_id, e.code, e.user_id, e.rn, CAST(CASE WHEN e.t < f.expires THEN f.expires WHEN e.ttl > 0 THEN e.t + e.ttl ELSE 0 END AS BIGINT), e.t < f.expires FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
  SELECT event_id, code, hit FROM f UNION ALL SELECT event_id, code, false FROM e WHERE NOT regexp_full_match(code, '[0-9A-Za-z]{{8,10}}')""")
def cache_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lookups from a cache that ill-formed codes bypass and that keeps no answer that couldn't be had."""
    known = F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 3 != 0)
    asked = fx.table(spark, sf_dir, "events").select("event_id", "ts", fx.code_of(F.col("user_id")).alias("code"), known.alias("valid"))
    out = state.cached_answers(asked, 5 * DAY_US, DAY_US, "code", "ts", "event_id")
    return out.select(F.col("id").alias("event_id"), F.col("k").alias("code"), F.col("flag").alias("hit"))


def cache_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with room for 40 entries, the least recently used of which goes. Tests hold it against brute force."""
    asked = fx.table(spark, sf_dir, "events").withColumn("valid", F.col("user_id") % 3 != 0)
    out = state.cached_answers(asked, 5 * DAY_US, DAY_US, "user_id", "ts", "event_id", check_codes=False, max_entries=40)
    return out.select(F.col("id").alias("event_id"), F.col("k").alias("code"), F.col("flag").alias("hit"))


query()(cache_bounded)


@query("""SELECT event_id, CASE WHEN u % 3 = 0 THEN '192.0.2.' || u % 256 WHEN u % 4 = 0 THEN '10.1.2.3' WHEN u % 5 = 0 THEN '10.9.9.9' ELSE '198.51.100.' || u % 256 END AS ip FROM (SELECT event_id, user_id AS u FROM events)""")
def real_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of clients behind trusted proxies: direct peers, all hops trusted, a broken hop, and a foreign hop."""
    u = F.col("user_id")
    peer = F.when(u % 3 == 0, F.concat(F.lit("192.0.2."), (u % 256).cast("string"))).when(u % 4 == 0, "10.1.2.3").when(u % 5 == 0, "10.4.4.4").otherwise("10.1.2.3")
    hops = F.when(u % 3 == 0, "203.0.113.9").when(u % 4 == 0, "1.2.3.4, nonsense, 10.7.7.7").when(u % 5 == 0, " 10.9.9.9 ,10.8.8.8").otherwise(F.concat(F.lit("6.6.6.6, 198.51.100."), (u % 256).cast("string"), F.lit(", 10.8.8.8")))
    return fx.table(spark, sf_dir, "events").select("event_id", network.real_ip(peer, hops, ["10.0.0.0/8"]).alias("ip"))


@query("""WITH p AS (SELECT event_id AS poll, user_id % 3 AS fp FROM events), t AS (SELECT *, lag(fp) OVER (ORDER BY poll) = fp AS twice FROM p),
  g AS (SELECT *, last_value(CASE WHEN twice THEN fp END IGNORE NULLS) OVER (ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS loaded FROM t)
  SELECT poll, fp, coalesce(twice, false) AND NOT coalesce(loaded = fp, false) AS load FROM g""")
def stable_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of a folder that start a build."""
    return snapshots.stable_loads(fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("poll"), (F.col("user_id") % 3).alias("fp")))


@query("""SELECT page_id, split_part(url, '/', -1) AS base_name, regexp_replace(url, 'feed$', '') AS cut, lower(url) AS lowered, starts_with(url, 'https://') AS secure FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String helpers over the URLs of pages."""
    url = F.col("url")
    return fx.table(spark, sf_dir, "pages").select("page_id", text.base_name(url).alias("base_name"), text.drop_suffix(url, "feed").alias("cut"), F.lower(url).alias("lowered"), url.startswith("https://").alias("secure"))


@query("""SELECT p_partkey, '"' || replace(p_name, ' ', CASE p_partkey % 6 WHEN 0 THEN '\\n' WHEN 1 THEN '\\x01' WHEN 2 THEN '\\"' WHEN 3 THEN '\\u200b' WHEN 4 THEN 'é ' ELSE '\\\\\\t' END) || '"' AS quoted FROM part""")
def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with control characters, quotes and marks that can't be seen, as messages show them."""
    between = F.element_at(F.array(*map(F.lit, ("\n", "\x01", '"', "​", "é ", "\\\t"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", text.quoted(F.replace(F.col("p_name"), F.lit(" "), between)).alias("quoted"))


@query("""SELECT event_id, printf('%012x', epoch_us(ts) // 1000) AS time_part, '7' AS version, true AS well_formed FROM events""")
def time_ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 7 UUIDs: the time in front, then the version."""
    at = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))  # whatever the session's zone
    made = fx.table(spark, sf_dir, "events").select("event_id", text.time_ordered_uuid(at).alias("u"))
    whole = F.col("u").rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")
    return made.select("event_id", F.concat(F.substring("u", 1, 8), F.substring("u", 10, 4)).alias("time_part"), F.substring("u", 15, 1).alias("version"), whole.alias("well_formed"))


@query("""WITH a AS (SELECT event_id, event_id % 6 AS kind, user_id % 4 = 0 AS bad FROM events)
  SELECT event_id, CASE WHEN bad THEN 'invalid' WHEN kind = 0 THEN 'valid' WHEN kind = 1 THEN 'invalid' ELSE 'unavailable' END AS status, CASE WHEN NOT bad AND kind = 0 THEN 15 END AS discount_percent FROM a""")
def recorded_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of a code service as outcomes: found, not found, damaged, of a wrong type, failing, and none."""
    kind = F.col("event_id") % 6
    body = F.when(kind == 0, '{"code":"HAPPYHRS","discountPercent":15}').when(kind == 2, '{"code":').when(kind == 3, '{"code":"HAPPYHRS","discountPercent":"much"}').otherwise("oops")
    code = F.when(F.col("user_id") % 4 == 0, "no").otherwise("HAPPYHRS")
    http = F.when(kind.isin(0, 2, 3), 200).when(kind == 1, 404).when(kind == 4, 500)
    asked = fx.table(spark, sf_dir, "events").select("event_id", code.alias("code"), http.alias("http_status"), body.alias("body"))
    return lookup.recorded_outcomes(asked, "code").select("event_id", "status", "discount_percent")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'debug' WHEN event_id % 5 = 3 THEN 'warn' WHEN event_id % 5 = 4 THEN 'error' ELSE 'info' END AS level,
  '{"level":"' || upper(CASE WHEN event_id % 3 = 2 THEN 'debug' WHEN event_id % 5 = 3 THEN 'warn' WHEN event_id % 5 = 4 THEN 'error' ELSE 'info' END) || '","msg":"request","method":"GET","path":"' || ['/api/order', '/api/product', '/health'][1 + event_id % 3]
  || '","status":' || [200, 201, 404, 503, 500][1 + event_id % 5] || ',"bytes":' || user_id || ',"duration":' || event_id * 1000 || ',"ip":"10.0.0.1","user_agent":"a"' || CASE WHEN event_id % 5 >= 3 THEN ',"err":"broken"' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ',"request_id":"r"' ELSE '' END || '}' AS line FROM events""")
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of requests."""
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    rows = fx.table(spark, sf_dir, "events").select(
        "event_id", F.lit("GET").alias("method"), at(["/api/order", "/api/product", "/health"], 3).alias("path"), at([200, 201, 404, 503, 500], 5).alias("status"), F.col("user_id").alias("bytes"),
        (F.col("event_id") * 1000).alias("duration_ns"), F.lit("10.0.0.1").alias("ip"), F.lit("a").alias("user_agent"), F.lit("broken").alias("err"), F.when(F.col("event_id") % 2 == 0, "r").otherwise("").alias("request_id"),
    )
    return requests.access_log(rows).select("event_id", "level", "line")
