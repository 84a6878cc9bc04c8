from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillon.operators.api import Limits, coupon_service, respond
from quillon.sources.products import demo_products

SCHEMA = "id int, ts int, method string, path string, client string, api_key string, content_type string, body string"
JSON = "application/json"


def ask(spark, rows, **kw):
    frame = spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))
    valid = spark.createDataFrame([("HAPPYHRS",)], "code string")
    keys = spark.createDataFrame([("apitest", ["create_order"]), ("readonly", [])], "key string, scopes array<string>").select(F.sha2("key", 256).alias("key_sha256"), "scopes")
    out = respond(frame, demo_products(spark), valid, keys, **kw).collect()
    assert len(out) == len(rows)
    return {r["id"]: (r["status"], json.loads(r["body"]) if r["body"] else None) for r in out}


def post(path, body, key=None, client="1.1.1.1", kind=JSON):
    return ("POST", path, client, key, kind, body)


def get(path):
    return ("GET", path, "1.1.1.1", None, None, None)


ORDER = '{"items":[{"productId":"1","quantity":2},{"productId":"3","quantity":1}]}'


def test_products(spark):
    out = ask(spark, [get("/api/product"), get("/api/product/2"), get("/api/product/007"), get("/api/product/abc"), get("/api/product/99"), ("POST", "/api/product/1", "c", None, None, None), get("/nowhere"), get("/health")])
    assert [out[i][0] for i in range(8)] == [200, 200, 200, 400, 404, 405, 404, 200]
    assert out[1][1]["price"] == 7 and out[1][1]["image"]["mobile"].endswith("-mobile.jpg") and out[2][1]["id"] == "7" and out[2][1]["price"] == 4.5
    assert out[3][1] == {"code": 400, "type": "bad_request", "message": "productId must be an integer"}
    assert out[4][1]["type"] == "not_found" and out[6][1]["message"] == "not found" and out[5][1]["type"] == "method_not_allowed"


def test_orders(spark):
    path = "/api/order"
    out = ask(
        spark,
        [
            post(path, ORDER, "apitest"),
            post(path, ORDER[:-1] + ',"couponCode":"HAPPYHRS"}', "apitest"),
            post(path, ORDER, None),
            post(path, ORDER, "what"),
            post(path, ORDER, "readonly"),
            post(path, "{}", "apitest"),
            post(path, "{} {}", "apitest"),
            post(path, '{"items":[{"productId":"77","quantity":1}]}', "apitest"),
            post(path, ORDER[:-1] + ',"couponCode":"NOTVALID"}', "apitest"),
        ],
        limits=Limits(order=(50, 60_000_000)),
    )
    assert [out[i][0] for i in range(9)] == [200, 200, 401, 401, 403, 422, 400, 422, 422]
    assert (out[0][1]["total"], out[0][1]["discounts"], [p["id"] for p in out[0][1]["products"]]) == (21, 0, ["1", "3"])
    assert (out[1][1]["total"], out[1][1]["discounts"]) == (18.9, 2.1)
    assert [out[i][1]["message"] for i in (2, 3, 4)] == ["missing api_key header", "invalid api key", "api key lacks the create_order scope"]
    assert out[5][1] == {"code": 422, "type": "validation_error", "message": "items: must contain at least one item"}
    assert out[7][1]["message"] == 'items[0].productId: product "77" not found'


def test_coupons_and_limits(spark):
    path = "/api/coupon/validate"
    rows = [post(path, '{"couponCode":"HAPPYHRS"}'), post(path, '{"couponCode":"SHORT"}'), post(path, "{}"), post(path, '{"couponCode":1}'), post(path, '{"couponCode":"HAPPYHRS"}', client="2001:db8::1"), post("/api/order", ORDER)]
    out = ask(spark, rows, limits=Limits(coupon=(3, 600_000_000), order=(1, 600_000_000)))
    assert [out[i][0] for i in range(6)] == [200, 200, 422, 429, 200, 401]
    assert out[0][1] == {"couponCode": "HAPPYHRS", "valid": True, "discountPercent": 10} and out[1][1] == {"couponCode": "SHORT", "valid": False}
    assert out[3][1] == {"code": 429, "type": "rate_limited", "message": "too many requests, retry later"}
    out = ask(spark, [*rows[:2], get("/ready")], ready=False)
    assert [out[i][0] for i in range(3)] == [503, 200, 503] and out[0][1]["type"] == "unavailable"
    assert ask(spark, [post(path, '{"couponCode":"HAPPYHRS"}')], percent=0)[0][1] == {"couponCode": "HAPPYHRS", "valid": True}


def test_coupon_service(spark):
    codes = spark.createDataFrame([(1, "HAPPYHRS"), (2, "NO")], "id int, code string")
    valid = codes.where("id = 1").select("code")
    got = {r["id"]: (r["status"], json.loads(r["body"])) for r in coupon_service(codes, valid).collect()}
    assert got == {1: (200, {"code": "HAPPYHRS", "discountPercent": 10}), 2: (404, {"error": "coupon not found"})}
    assert {r["status"] for r in coupon_service(codes, valid, ready=False).collect()} == {503}


def test_headers_and_description(spark):
    path = "/api/coupon/validate"
    rows = [post(path, '{"couponCode":"HAPPYHRS"}')] * 4 + [get("/api/openapi.yaml"), get("/ready"), ("POST", "/api/openapi.yaml", "c", None, None, None)]
    frame = spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))
    valid = spark.createDataFrame([("HAPPYHRS",)], "code string")
    keys = spark.createDataFrame([], "key_sha256 string, scopes array<string>")
    out = {r["id"]: r for r in respond(frame, demo_products(spark), valid, keys, Limits(coupon=(3, 60_000_000)), spec="openapi: 3.1.0\n").collect()}
    assert [(out[i]["status"], out[i]["rate_limit"], out[i]["rate_remaining"]) for i in range(4)] == [(200, 3, 2), (200, 3, 1), (200, 3, 0), (429, 3, 0)]
    assert [out[i]["retry_after"] for i in range(4)] == [None, None, None, 17]
    assert (out[4]["status"], out[4]["body"], out[4]["rate_limit"]) == (200, "openapi: 3.1.0\n", None) and out[6]["status"] == 405
    assert json.loads(out[5]["body"]) == {"status": "ready"}
