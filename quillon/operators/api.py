"""Request records through the whole API: route, limit, key, body, answer.

Every record ``(id, ts, method, path, client, api_key, content_type, body)`` gets the
status and JSON body that its endpoint answers.  Stages are independent columns and
joins on the record id; the first that refuses decides.  The list of all products is
``sources.products.product_list``, so that endpoint's body is left null here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import render
from ..functions.network import client_key
from .lookup import coupon_outcomes, coupon_response
from .orders import place_orders
from .requests import authorise, coupon_bodies, error_body, order_bodies, product_id_status
from .state import rate_limit

UNAVAILABLE = "coupons cannot be checked right now, retry later"


@dataclass(frozen=True)
class Limits:
    """Requests per window and client, and the window in microseconds, of the two limited routes."""

    coupon: tuple[int, int] = (20, 60_000_000)
    order: tuple[int, int] = (10, 60_000_000)


def route(method: Column, path: Column) -> Column:
    """The endpoint, or the status that a path without one is answered with."""
    known = [("GET", "/api/product", "list"), ("POST", "/api/coupon/validate", "coupon"), ("POST", "/api/order", "order"), ("GET", "/health", "health"), ("GET", "/ready", "ready"), ("GET", "/api/openapi.yaml", "openapi")]
    one = path.rlike(r"\A/api/product/[^/]+\z")
    out = F.when(one & (method == "GET"), "product")
    for verb, at, name in known:
        out = out.when((path == at) & (method == verb), name)
    return out.when(one | path.isin([at for _, at, _ in known]), "405").otherwise("404")


def json_text(value: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    return F.substr(whole, F.lit(6), F.char_length(whole) - 6)


def product_json(product: DataFrame) -> Column:
    """A product's JSON, its price as the shortest decimal. Columns that the table lacks are empty."""
    text = lambda name: json_text(F.col(name)) if name in product.columns else F.lit('""')
    image = F.to_json("image") if "image" in product.columns else F.lit('{"thumbnail":"","mobile":"","tablet":"","desktop":""}')
    return F.concat(F.lit('{"id":'), json_text(F.col("id")), F.lit(',"name":'), text("name"), F.lit(',"price":'), render(F.col("price")), F.lit(',"category":'), text("category"), F.lit(',"image":'), image, F.lit("}"))


def order_json(placed: DataFrame, requests: DataFrame, products: DataFrame) -> DataFrame:
    """``(order_id, body)`` of placed orders; at most as many products as an order has items."""
    known = products.select(F.col("id").alias("pid"), product_json(products).alias("p"))
    rows = placed.where("status = 200").select("order_id", "total", "discounts", F.posexplode("products").alias("i", "pid")).join(known, "pid")
    listed = rows.groupBy("order_id", "total", "discounts").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]), ",").alias("listed"))
    both = listed.join(requests.select("order_id", "items"), "order_id")
    body = F.concat(
        F.lit('{"id":'), json_text(F.col("order_id").cast("string")), F.lit(',"total":'), render(F.col("total")), F.lit(',"discounts":'), render(F.col("discounts")),
        F.lit(',"items":'), F.to_json("items"), F.lit(',"products":['), F.col("listed"), F.lit("]}"),
    )
    return both.select("order_id", body.alias("body"))


def respond(requests: DataFrame, products: DataFrame, valid: DataFrame, keys: DataFrame, limits: Limits = Limits(), percent: int = 10, ready: bool = True, spec: str = "") -> DataFrame:
    """``(id, status, body, retry_after, rate_limit, rate_remaining)`` for every record; ids are unique.

    The last three are headers: seconds to wait, of a 429 or 503, and of the limited
    routes the requests that a client has and those that are left.  ``spec`` is the
    API description that one route answers with.
    """
    rows = requests.withColumn("route", route(F.col("method"), F.col("path")))
    keyed = rows.where("route in ('coupon', 'order')").select("id", "ts", "route", client_key(F.col("client")).alias("client"))
    budgets = [rate_limit(keyed.where(F.col("route") == name), *budget, headers=True).withColumn("rate_limit", F.lit(budget[0])) for name, budget in (("coupon", limits.coupon), ("order", limits.order))]
    passed = budgets[0].unionByName(budgets[1]).select("id", F.col("flag").alias("passed"), "left", "wait_us", "rate_limit")

    auth = authorise(rows.where("route = 'order'").select("id", "api_key"), keys, "create_order").select("id", F.col("status").alias("auth"), F.col("message").alias("auth_message"))

    coupons = coupon_bodies(rows.where("route = 'coupon'").select("id", "content_type", "body")).withColumn("code", F.coalesce("couponCode", F.lit("")))
    coupons = coupon_outcomes(coupons, valid, "code", percent, ready).withColumnRenamed("status", "outcome")
    required = (F.col("code") == "") & F.col("problem").isNull()
    coupons = coupons.select(
        "id",
        F.when(F.col("problem").isNotNull(), 400).when(required, 422).when(F.col("outcome") == "unavailable", 503).otherwise(200).alias("c_status"),
        F.coalesce("problem", F.when(required, "couponCode: is required"), F.when(F.col("outcome") == "unavailable", UNAVAILABLE)).alias("c_message"),
        coupon_response(F.col("outcome"), F.col("code"), F.col("discount_percent")).alias("c_body"),
    )

    bodies = order_bodies(rows.where("route = 'order'").select("id", "content_type", "body"))
    asked = bodies.where("problem is null").select(F.col("id").alias("order_id"), "couponCode", "items")
    placed = place_orders(asked, products, valid, percent, ready)
    answers = order_json(placed, asked, products)
    orders = bodies.select("id", "problem").join(placed.select(F.col("order_id").alias("id"), "status", "problems"), "id", "left").join(answers.select(F.col("order_id").alias("id"), F.col("body").alias("o_body")), "id", "left")
    orders = orders.select(
        "id",
        F.when(F.col("problem").isNotNull(), 400).otherwise(F.col("status")).alias("o_status"),
        F.coalesce("problem", F.when(F.col("status") == 503, UNAVAILABLE), F.when(F.col("status") == 422, F.col("problems"))).alias("o_message"),
        "o_body",
    )

    ids = rows.where("route = 'product'").select("id", product_id_status(F.element_at(F.split("path", "/"), -1), F.lit(True))["id"].alias("pid"))
    known = products.select(F.col("id").alias("pid"), product_json(products).alias("p_body"))
    ids = ids.join(known, "pid", "left").select("id", F.when(F.col("pid").isNull(), 400).when(F.col("p_body").isNull(), 404).otherwise(200).alias("p_status"), "p_body")

    joined = rows.select("id", "route")
    for side in (passed, auth, coupons, orders, ids):
        joined = joined.join(side, "id", "left")
    r = F.col("route")
    limited = r.isin("coupon", "order") & ~F.col("passed")
    denied = (r == "order") & (F.col("auth") != 200)
    status = (
        F.when(r.isin("404", "405"), r.cast("int"))
        .when(limited, 429)
        .when(denied, F.col("auth"))
        .when(r == "coupon", F.col("c_status"))
        .when(r == "order", F.col("o_status"))
        .when(r == "product", F.col("p_status"))
        .when((r == "ready") & F.lit(not ready), 503)
        .otherwise(200)
    )
    message = (
        F.when(limited, "too many requests, retry later")
        .when(denied, F.col("auth_message"))
        .when(r == "coupon", F.col("c_message"))
        .when(r == "order", F.col("o_message"))
        .when((r == "product") & (F.col("p_status") == 400), "productId must be an integer")
        .when((r == "product") & (F.col("p_status") == 404), "product not found")
    )
    fine = F.when(r == "coupon", F.col("c_body")).when(r == "order", F.col("o_body")).when(r == "product", F.col("p_body")).when(r == "openapi", F.lit(spec))
    fine = fine.when(r == "health", F.lit('{"status":"ok"}')).when(r == "ready", F.lit('{"status":"ready"}'))
    out = joined.select("id", status.alias("status"), message.alias("message"), fine.alias("fine"), r.alias("route"), "rate_limit", "left", "wait_us")
    down = F.when(F.col("route") == "ready", F.lit('{"status":"shutting down"}'))
    body = F.when(F.col("status") == 200, F.col("fine")).otherwise(F.coalesce(down, F.to_json(error_body(F.col("status"), F.col("message")))))
    wait = F.when(F.col("status") == 429, F.greatest(F.ceil(F.col("wait_us") / 1_000_000), F.lit(1))).when((F.col("status") == 503) & F.col("rate_limit").isNotNull(), F.lit(5))
    return out.select("id", "status", body.alias("body"), wait.cast("long").alias("retry_after"), "rate_limit", F.col("left").alias("rate_remaining"))


def coupon_service(codes: DataFrame, valid: DataFrame, percent: int = 10, ready: bool = True) -> DataFrame:
    """``codes(id, code)`` as the internal code service answers: 200, 404, or 503 before it is ready."""
    found = codes.join(valid.select(F.col("code").alias("_valid")).distinct(), F.col("code") == F.col("_valid"), "left")
    status = F.lit(503) if not ready else F.when(F.col("_valid").isNotNull(), 200).otherwise(404)
    good = F.to_json(F.struct("code", F.lit(percent).alias("discountPercent")))
    error = F.to_json(F.struct(F.when(F.col("status") == 503, "coupons are still loading").otherwise("coupon not found").alias("error")))
    return found.withColumn("status", status).select("id", "status", F.when(F.col("status") == 200, good).otherwise(error).alias("body"))
