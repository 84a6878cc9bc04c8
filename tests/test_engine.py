from __future__ import annotations

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from quillon.operators import lookup, orders, requests, snapshots, state
from quillon.sources import config, order_table, products, saved
from quillon.streaming.keyed import stream_cached_answers, stream_rate_limit
from quillon.streaming.refresh import CouponRefresh

ITEMS = "order_id int, couponCode string, items array<struct<productId:string,quantity:int>>"


def place(spark, rows, **kw):
    prices = spark.createDataFrame([("1", 650), ("2", 455)], "id string, price long")
    valid = spark.createDataFrame([("HAPPYHRS",)], "code string")
    return {r["order_id"]: r for r in orders.place_orders(spark.createDataFrame(rows, ITEMS), prices, valid, **kw).collect()}


def test_orders_are_staged_and_priced(spark):
    out = place(
        spark,
        [
            (1, None, [("1", 2), ("2", 1), ("1", 1)]),
            (2, "HAPPYHRS", [("1", 1), ("2", 1)]),
            (3, "", []),
            (4, None, None),
            (5, "NOPE", [("", 0), ("9", 1)]),
            (6, "NOPE", [("9", 1), ('a"b', 2)]),
            (7, "NOTVALID1", [("1", 1)]),
            (8, None, [("1", 1)] * 101),
            (9, None, [(None, None)]),
        ],
    )
    assert (out[1]["total"], out[1]["discounts"], out[1]["products"]) == (2405, 0, ["1", "2"])
    assert (out[2]["subtotal"], out[2]["discounts"], out[2]["total"]) == (1105, 111, 994)
    assert out[3]["problems"] == out[4]["problems"] == "items: must contain at least one item"
    assert out[5]["problems"] == "items[0].productId: is required; items[0].quantity: must be between 1 and 100"
    assert out[6]["problems"] == 'items[0].productId: product "9" not found; items[1].productId: product "a\\"b" not found'
    assert out[7]["problems"] == "couponCode: is not a valid coupon"
    assert out[8]["problems"] == "items: must contain at most 100 items"
    assert out[9]["problems"] == "items[0].productId: is required; items[0].quantity: must be between 1 and 100"
    assert {k: r["status"] for k, r in out.items()} == {1: 200, 2: 200, 3: 422, 4: 422, 5: 422, 6: 422, 7: 422, 8: 422, 9: 422}


def test_coupon_that_cannot_be_checked(spark):
    out = place(spark, [(1, "HAPPYHRS", [("1", 1)]), (2, "bad!", [("1", 1)]), (3, None, [("1", 1)]), (4, "HAPPYHRS", [("9", 1)])], ready=False)
    assert [out[i]["status"] for i in (1, 2, 3, 4)] == [503, 422, 200, 422]


def test_lookup_outcomes(spark):
    asked = spark.createDataFrame([("HAPPYHRS",), ("happyhrs",), ("x",), (None,)], "code string")
    valid = spark.createDataFrame([("HAPPYHRS",)], "code string")
    out = lookup.coupon_outcomes(asked, valid).withColumn("b", lookup.coupon_response(F.col("status"), F.col("code"), F.col("discount_percent"))).collect()
    assert sorted(r["status"] for r in out) == ["invalid"] * 3 + ["valid"]
    assert [json.loads(r["b"]) for r in out if r["code"] == "HAPPYHRS"] == [{"couponCode": "HAPPYHRS", "valid": True, "discountPercent": 10}]


def test_bodies(spark):
    rows = spark.createDataFrame(
        [("application/json", '{"ITEMS": null, "items":[{"productId":"1","quantity":2}]}'), ("application/json", '{"a":"' + "x" * 70000), (None, "{}"), ("application/json", '{"couponCode":5}'), ("application/json", "null")],
        "content_type string, body string",
    )
    out = requests.order_bodies(rows).collect()
    assert [r["problem"] for r in out] == [None, "body must not exceed 65536 bytes", "Content-Type must be application/json", "couponCode must be of type string", None]
    assert out[0]["items"][0]["productId"] == "1"


def test_folds(spark):
    rows = spark.createDataFrame([(i, "a", t, True) for i, t in enumerate([0, 1, 2, 20, 40, 41])] + [(9, "b", 0, False), (10, "b", 15, False)], "id long, k string, s int, valid boolean")
    rows = rows.withColumn("ts", F.timestamp_seconds("s"))
    passed = {r["id"]: r["flag"] for r in state.rate_limit(rows, 3, 60_000_000, "k").collect()}
    assert passed == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 9: True, 10: True}
    hits = {r["id"]: r["flag"] for r in state.cached_answers(rows, 20_000_000, 10_000_000, "k", check_codes=False).collect()}
    assert hits == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True, 9: False, 10: False}


@pytest.mark.parametrize("form", ["limit", "cache"])
def test_streams_agree_with_batch(spark, tmp_path, form):
    rows = spark.range(0, 60).selectExpr("id", "concat('c', id % 3) as client", "timestamp_seconds(id * 7) as ts", "id % 2 = 0 as valid")
    source = str(tmp_path / "in")
    rows.where("id < 30").coalesce(1).write.parquet(source)
    rows.where("id >= 30").coalesce(1).write.mode("append").parquet(source)
    # the older file first
    parts = sorted((p for p in os.listdir(source) if p.endswith(".parquet")), key=lambda p: os.stat(os.path.join(source, p)).st_mtime_ns)
    for n, p in enumerate(parts):
        os.utime(os.path.join(source, p), (1_000_000 + n * 10, 1_000_000 + n * 10))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    if form == "limit":
        out, want = stream_rate_limit(stream, 2, 60_000_000), state.rate_limit(rows, 2, 60_000_000)
    else:
        out, want = stream_cached_answers(stream, 40_000_000, 10_000_000, "client", check_codes=False), state.cached_answers(rows, 40_000_000, 10_000_000, "client", check_codes=False)
    query = out.writeStream.format("memory").queryName(form).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table(form).collect())) == sorted(map(tuple, want.collect()))


def test_saved_result(tmp_path):
    folder = str(tmp_path)
    snap = {"/somewhere/a.txt": (3, 5)}
    with pytest.raises(FileNotFoundError):
        saved.read_saved(folder)
    saved.write_saved(folder, snap, ["AAAAAAAA", "BBBBBBBB"])
    got = saved.read_saved(folder)
    assert got.codes == ["AAAAAAAA", "BBBBBBBB"] and got.matches({"/moved/a.txt": (3, 5)})
    assert not got.matches({"/moved/a.txt": (3, 6)}) and not got.matches(snap, 3) and not got.matches({})
    for codes in (["B" * 8, "A" * 8], ["A" * 8, "A" * 8], ["bad"]):
        saved.write_saved(folder, snap, codes)
        with pytest.raises(ValueError):
            saved.read_saved(folder)
    (tmp_path / saved.NAME).write_text("{")
    with pytest.raises(ValueError):
        saved.read_saved(folder)
    assert os.listdir(folder) == [saved.NAME]


def test_refresh(spark, tmp_path):
    loads = []
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    service = CouponRefresh(spark, str(tmp_path), on_load=loads.append)
    assert not service.ready and service.poll() and service.ready and loads[-1].codes == 0  # an empty folder loads at once
    a.write_text("HAPPYHRS\nONLYINA1\n")
    b.write_text("HAPPYHRS\n")
    assert not service.poll() and service.poll() and not service.poll()
    assert service.is_valid("HAPPYHRS") and not service.is_valid("ONLYINA1")
    b.write_text("HAPPYHRS\nONLYINA1\n")
    assert not service.poll() and service.poll()
    assert [r["code"] for r in spark.table("valid_codes").collect()] == ["HAPPYHRS", "ONLYINA1"]
    again = CouponRefresh(spark, str(tmp_path), view="again", on_load=loads.append)
    assert again.restore() and loads[-1].restored and again.is_valid("ONLYINA1") and not again.poll()
    (tmp_path / "c.gz").write_bytes(b"not gzip")
    assert not service.poll() and service.poll() and loads[-1].error and service.is_valid("ONLYINA1")
    assert not service.poll()  # a failure isn't tried again
    stop = threading.Event()
    stop.set()
    CouponRefresh(spark, str(tmp_path), view="third").run(stop)


def test_snapshots(spark):
    polls = spark.createDataFrame(list(enumerate(["x", "x", "x", "y", "x", "x", "y", "y"])), "poll int, fp string")
    assert [r["poll"] for r in snapshots.stable_loads(polls).where("load").orderBy("poll").collect()] == [1, 7]
    one = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size long, mod_ns long")
    assert snapshots.same_snapshot(one, one) and not snapshots.same_snapshot(one, one.where("path = 'a'"))


def test_orders_table_and_products(spark, tmp_path):
    path = str(tmp_path / "orders")
    order_table.save_orders(spark.createDataFrame([("x", 1), ("y", 2)], "order_id string, total long"), path, 1)
    order_table.save_orders(spark.createDataFrame([("x", 3)], "order_id string, total long"), path, 2)
    assert sorted(map(tuple, order_table.read_orders(spark, path).collect())) == [("x", 3), ("y", 2)]
    assert order_table.get_order(spark, path, "x").first()["total"] == 3
    demo = products.demo_products(spark).collect()
    assert len(demo) == 9 and demo[1]["image"]["tablet"].endswith("image-creme-brulee-tablet.jpg")


def test_config(tmp_path):
    assert config.load({}).coupon_cache_ttl == 300
    file = tmp_path / "c.toml"
    file.write_text('coupon_cache_ttl = "1m30s"\norder_rate_limit = 3\n')
    got = config.load({"ORDER_RATE_LIMIT": "7", "API_KEYS": "a:x|y, b:"}, str(file))
    assert (got.coupon_cache_ttl, got.order_rate_limit, got.api_keys) == (90, 7, {"a": ["x", "y"], "b": []})
    with pytest.raises(ValueError, match="rate limits.*DISCOUNT_PERCENT"):
        config.load({"ORDER_RATE_LIMIT": "0", "DISCOUNT_PERCENT": "101"})
    with pytest.raises(ValueError) as e:
        config.load({"API_KEYS": "secret:x,secret:y"})
    assert "secret" not in str(e.value)


BODY_CASES = [
    ('{"couponcode":"HAPPYHRS","ITEMS":[{"productid":"1","QUANTITY":2}]}', None),
    ('{"couponCode":"a","COUPONCODE":"HAPPYHRS","items":null,"items":[{"productId":"1","quantity":2}]}', None),
    ('{"couponCode":"HAPPYHRS","x":' + "[" * 9000 + "]" * 9000 + ',"items":[{"productId":"1","quantity":2}]}', None),
    ("[" * 30000 + "]" * 30000, "body is not valid JSON"),
    ("[" * 20000, "body is not valid JSON"),
    ('{"x":NaN}', "body is not valid JSON"),
    ('{"x":-Infinity}', "body is not valid JSON"),
    ('{"items":[{"quantity":1' + "0" * 5000 + "}]}", "items.quantity must be of type int"),
    ('{"items":[{"quantity":true}]}', "items.quantity must be of type int"),
    ('{"items":[7]}', "items must be of type order.Item"),
    ('{"items":{}}', "items must be of type []order.Item"),
    (" {}", "body is not valid JSON"),
    ("{}" + " " * 70000, "body must contain a single JSON object"),
    ('{"items":[' + '{"productId":"1","quantity":1},' * 3000 + "]}", "body must not exceed 65536 bytes"),
    (" \t\r\n", "body must not be empty"),
    (None, "body must not be empty"),
    ('"x"', "body must be a JSON object"),
]


def test_bodies_are_read_in_one_pass(spark):
    rows = spark.createDataFrame([(i, "application/json", b) for i, (b, _) in enumerate(BODY_CASES)], "n int, content_type string, body string")
    out = {r["n"]: r for r in requests.order_bodies(rows).collect()}
    assert [out[i]["problem"] for i in range(len(BODY_CASES))] == [p for _, p in BODY_CASES]
    for i in range(3):
        assert out[i]["couponCode"] == "HAPPYHRS" and [tuple(x) for x in out[i]["items"]] == [("1", 2)]


def test_scanner_agrees_with_the_library():
    import random

    rng = random.Random(1)
    decoder = json.JSONDecoder(object_pairs_hook=requests.Pairs)
    for _ in range(5000):
        text = "".join(rng.choices(["{", "}", "[", "]", ",", ":", '"a"', "1", "-2.5e3", "null", "true", " ", '"\\u00e9"'], k=rng.randint(1, 9))).lstrip(" ")
        try:
            want = decoder.raw_decode(text)[0]
        except ValueError:
            want = ValueError
        try:
            got = requests._scan(text)[0]
        except ValueError:
            got = ValueError
        assert got == want, text


def test_whole_bodies_are_not_scanned_token_by_token(monkeypatch):
    def scan(text):
        raise AssertionError(text[:20])

    monkeypatch.setattr(requests, "_scan", scan)
    deep = ["[" * 11_000 + "]" * 11_000, '{"x":' + '[{"]}\\"":' * 5_100, "[" * 10_001, '{"x":NaN}', '{"a"', "[1,]", "["]
    assert [requests.read_body(x, {})[0] for x in deep] == ["body is not valid JSON"] * len(deep)
    flat = "[" + "[]," * 12_000 + "[]]"
    assert requests.read_body(flat, {})[0] == "body must be a JSON object"
    assert requests.read_body('{"x":"' + "[" * 20_000 + '"}', {})[0] is None


def test_depth_and_decoder_agree_with_the_scanner(monkeypatch):
    import random

    def outcome(f, *args):
        try:
            return f(*args)
        except (requests.Invalid, requests.Incomplete) as e:
            return type(e)

    monkeypatch.setattr(requests, "MAX_DEPTH", 2)
    rng, seen = random.Random(2), set()
    parts = ["{", "}", "[", "[", "[", "]", ",", ":", '"a"', '"', '"[\\"["', "\\", "\n", "\u00e9", "1", "-", "nul", "null", " ", "{}", '{"b":[', '"\\u00', "]]"]
    for _ in range(50_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9))).lstrip(" \n")
        want = outcome(requests._scan, text)
        assert outcome(requests._first_value, text, True) == want, text
        assert outcome(requests._first_value, text, False) == (requests.Invalid if want is requests.Incomplete else want), text
        seen.add((requests._too_deep(text), want if isinstance(want, type) else "value"))
    assert seen == {(True, requests.Invalid), (False, requests.Invalid), (False, requests.Incomplete), (False, "value")}


def test_bounded_cache(spark):
    import random
    from collections import OrderedDict

    rng = random.Random(3)
    rows = [(i, f"CODE{rng.randrange(9):05d}" if rng.random() > 0.1 else "bad", rng.randrange(400), rng.choice((True, False, None))) for i in range(600)]
    cache, want = OrderedDict(), {}
    for i, k, t, valid in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = False
        if k == "bad":
            continue
        if k in cache:
            cache.move_to_end(k)
            if t < cache[k]:
                want[i] = True
                continue
            del cache[k]
        if valid is not None:
            cache[k] = t + (20 if valid else 5)
            while len(cache) > 4:
                cache.popitem(last=False)
    frame = spark.createDataFrame(rows, "id long, code string, s long, valid boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = state.cached_answers(frame, 20_000_000, 5_000_000, max_entries=4).collect()
    assert {r["id"]: r["flag"] for r in got} == want and sum(want.values()) > 20


def test_answers_and_base_urls(spark):
    assert lookup.base_url("http://a:1/") == "http://a:1"
    for bad in ("a:8081", "ftp://a", "/x", "http://", ""):
        with pytest.raises(ValueError):
            lookup.base_url(bad)
    rows = [("HAPPYHRS", 200, '{"code":"HAPPYHRS","discountPercent":7}'), ("HAPPYHRS", 200, '{"code":"' + "x" * 5000), ("HAPPYHRS", 200, None), ("HAPPYHRS", None, None), ("HAPPYHRS", 502, "x"), ("HAPPYHRS", 404, "x"), ("x", 200, "{}")]
    out = lookup.recorded_outcomes(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, code string, http_status int, body string")).orderBy("n").collect()
    assert [(r["status"], r["discount_percent"]) for r in out] == [("valid", 7), *[("unavailable", None)] * 4, ("invalid", None), ("invalid", None)]


def test_settings_of_both_servers(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("coupon_rate_limit: 7\napi_keys:\n  k: [create_order]\nread_timeout: 3s\n")
    pytest.importorskip("yaml")
    got = config.load({"ADDR": ":9"}, str(path))
    assert (got.coupon_rate_limit, got.api_keys, got.read_timeout, got.addr, got.order_rate_limit) == (7, {"k": ["create_order"]}, 3.0, ":9", 10)
    service = config.load({"COUPONS_DIR": str(tmp_path), "COUPONS_POLL_INTERVAL": "5s"}, kind=config.ServiceConfig)
    assert service.coupons_poll_interval == 5 and service.coupons_addr == "127.0.0.1:8081"
    with pytest.raises(ValueError, match="COUPONS_DIR.*PERCENT.*LOG_FORMAT"):
        config.load({"COUPONS_DIR": str(path), "COUPONS_DISCOUNT_PERCENT": "101", "LOG_FORMAT": "xml"}, kind=config.ServiceConfig)
