from __future__ import annotations

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.functions import codes, money, network, text
from quillon.operators import threshold
from quillon.sources.lines import list_files, read_lines, read_sources


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


GOOD = ["HAPPYHRS", "FIFTYOFF1", "TENCHARS10", "aaaaaaaa", "00000000"]
BAD = ["", "SHORT12", "ELEVENCHARS", "HAPPY HR", "HAPPYHR\n", "HAPPYHRS\r", "HÄPPYHRS", "under_sco", None]


def test_format_is_bytes_and_anchored(spark):
    assert column(spark, codes.well_formed, GOOD) == [True] * len(GOOD)
    assert column(spark, codes.well_formed, BAD) == [False] * len(BAD)


def test_packing_keeps_order_and_round_trips(spark):
    some = sorted(["00000000", "0000000000", "9ZZZZZZZ", "AAAAAAAA", "AAAAAAAAA", "HAPPYHRS", "aaaaaaaa", "zzzzzzzzzz"])
    df = spark.createDataFrame([(c,) for c in some], "c string").withColumn("p", codes.pack(F.col("c"))).withColumn("u", codes.unpack(F.col("p")))
    rows = df.orderBy("p").collect()
    assert [r["c"] for r in rows] == some
    assert [r["u"] for r in rows] == some
    assert {r["c"]: r["p"] for r in rows}["HAPPYHRS"] == 327471571720589312
    assert column(spark, codes.pack, ["SHORT", None, "WITH-DASH"]) == [None] * 3


def test_build_from_text_crlf_and_gzip(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"BOTHAB01\nHAPPYHRS\nONLYINA1\nBOTHAB01\nshort\n")
    (tmp_path / "b.txt").write_bytes(b"BOTHAB01\r\nTENCHARS10\r\nTOOLONGCODE1\r\nBAD\rLINE1\r\n")
    with gzip.open(tmp_path / "c.GZ", "wb") as f:
        f.write(b"HAPPYHRS\nTENCHARS10\nONLYINC1")
    (tmp_path / ".hidden").write_bytes(b"ONLYINA1\nONLYINC1\n")
    paths = sorted(list_files(str(tmp_path)))
    assert len(paths) == 3
    out = threshold.valid_codes(read_sources(spark, paths), 2, len(paths)).collect()
    assert [r["code"] for r in out] == ["BOTHAB01", "HAPPYHRS", "TENCHARS10"]


def test_no_files_is_no_codes_and_a_path_twice_is_two_sources(spark, tmp_path):
    assert threshold.valid_codes(read_sources(spark, []), 2, 0).collect() == []
    p = tmp_path / "x.txt"
    p.write_text("HAPPYHRS\n")
    assert [r[0] for r in threshold.valid_codes(read_sources(spark, [str(p), str(p)]), 2, 2).collect()] == ["HAPPYHRS"]
    with pytest.raises(ValueError):
        read_lines(spark, str(tmp_path / "_x.txt"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_sources(spark, [str(tmp_path / "none.txt")]).collect()


def test_many_files_are_one_scan(spark, tmp_path):
    paths = []
    for i in range(70):
        p = tmp_path / f"f {i}.txt"
        p.write_text("HAPPYHRS\n" * (i % 3) + f"ONLY{i:04d}\n")
        paths.append(str(p))
    lines = read_sources(spark, paths)
    assert [r[0] for r in threshold.valid_codes(lines, 40, len(paths)).collect()] == ["HAPPYHRS"]
    assert threshold.source_counts(lines, "code", "src").where("code = 'HAPPYHRS'").first()["n_sources"] == 46
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


@pytest.mark.parametrize("seed", range(4))
def test_threshold_against_counts(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(50)}", s) for s in range(rng.randint(1, 5)) for _ in range(rng.randrange(30))]
    df = spark.createDataFrame(rows, "key string, src int")
    n = Counter(k for k, _ in set(rows))
    for least in (1, 2, 3, 9):
        want = sorted(k for k, c in n.items() if c >= least)
        for sources in (5, None):
            assert sorted(r[0] for r in threshold.in_at_least(df, "key", "src", least, sources).collect()) == want


def test_more_sources_than_bits(spark):
    df = spark.range(0, 200).selectExpr("'k' as key", "cast(id as int) as src")
    assert threshold.source_counts(df, "key", "src", 200).first()["n_sources"] == 200
    assert threshold.source_counts(df.where("src < 63"), "key", "src", 63).first()["n_sources"] == 63


def test_money(spark):
    cents = [0, 5, 650, 700, 1330, 1999, 10000, 123456]
    assert column(spark, money.render, cents, "long") == ["0", "0.05", "6.5", "7", "13.3", "19.99", "100", "1234.56"]
    assert [column(spark, lambda c: money.apply_percent(c, 10), [v], "long")[0] for v in (655, 654, 5, 4, 0)] == [66, 65, 1, 0, 0]
    assert column(spark, lambda c: money.apply_percent(c, 100), [9_000_000_000_000_001], "long") == [9_000_000_000_000_001]


def test_text_helpers(spark):
    assert column(spark, lambda c: text.split_list(c), [" a, ,b ,", ""]) == [["a", "b"], []]
    assert column(spark, text.keys_problem, ["a:x,b", ":x", "a:x, a:y"]) == [None, "empty key", "duplicate key"]
    assert column(spark, text.base_name, ["/a/b.txt", "c"]) == ["b.txt", "c"]
    assert column(spark, lambda c: text.drop_suffix(c, "/"), ["http://x//", "y"]) == ["http://x/", "y"]
    assert column(spark, text.media_type, ["Application/JSON; charset=x"]) == ["application/json"]
    u = spark.range(1).select(text.time_ordered_uuid(F.lit("2024-01-01").cast("timestamp"))).first()[0]
    assert len(u) == 36 and u[14] == "7" and u.startswith("018cc251-f400")


def test_client_keys(spark):
    asked = ["203.0.113.7", "::ffff:203.0.113.7", "2001:db8:1:2:3:4:5:6", "2001:db8:1:2:ff::1", "not-an-ip", None]
    assert column(spark, network.client_key, asked) == ["203.0.113.7", "203.0.113.7", "2001:db8:1:2::/64", "2001:db8:1:2::/64", "not-an-ip", None]
    df = spark.createDataFrame([("10.0.0.1", "1.1.1.1, 2.2.2.2, 10.0.0.9"), ("9.9.9.9", "1.1.1.1"), ("10.0.0.1", None)], "p string, h string")
    assert [r[0] for r in df.select(network.real_ip(F.col("p"), F.col("h"), ["10.0.0.0/8"])).collect()] == ["2.2.2.2", "9.9.9.9", "10.0.0.1"]
