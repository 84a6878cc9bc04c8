"""The training-data operators against brute force, and their defined cases."""

from __future__ import annotations

import gzip
import hashlib
import html
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_rotation, components, decontaminate, html_labelled, html_tree, huffman, near_dedup, quality_fm, queries, repetition, sentencepiece_trie, substring_dedup, textops, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def corpus(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Random texts with copies, near copies, shared passages, blanks, nulls and one long text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "été", "a-b", "The", "the", "x\xa0y"]
    texts: list[str | None] = []
    passage = " ".join(rng.choices(vocabulary, k=45))
    for _ in range(n):
        kind = rng.random()
        words = rng.choices(vocabulary, k=rng.randint(1, 120))
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.35 and (old := rng.choice(texts)):
            words = old.split() or ["w1"]
            for _ in range(max(1, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        elif kind < 0.5:
            cut = rng.randrange(len(words))
            text = " ".join(words[:cut]) + " " + passage + "\n" + " ".join(words[cut:])
        else:
            text = " ".join(words)
        texts.append(text)
    texts += ["", " \n\t ", None, "one", "ONE", "a b", " ".join(["ab"] * 700), " ".join(rng.choices(vocabulary, k=3000))]
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


# words and hashes


def test_words_and_hashes():
    texts = pa.array(["a bb  a", "", None, "\x1cé\x0bx\x85 a", "a", " bb"])
    words = textops.Words(texts)
    raw = words.buf.tobytes()
    got = [raw[a:b].decode() for a, b in zip(words.start, words.end, strict=True)]
    assert got == ["a", "bb", "a", "\x1cé", "x\x85", "a", "a", "bb"]
    assert words.count.tolist() == [3, 0, 0, 3, 1, 1]
    h = words.hashes()
    assert h[0] == h[2] == h[5] == h[6] and h[1] == h[7] and len(set(h.tolist())) == 4
    assert words.joined()[0].tobytes().decode() == "".join(w + " " for w in got)
    sliced = textops.Words(pa.array(["zz", "a bb", "q"]).slice(1, 1))
    assert sliced.hashes().tolist() == [h[0], h[1]]


def test_windows():
    values = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for w in (1, 2, 3, 5, 8, 17):
        assert textops.sliding_min(values, w).tolist() == [min(values[i : i + w]) for i in range(201 - w)]
    hashes = textops.window_hashes(values, 3)
    seen = {}
    for i, h in enumerate(hashes.tolist()):
        assert seen.setdefault(tuple(values[i : i + 3].tolist()), h) == h
    assert len(set(seen.values())) == len(seen)


# 1


TURNS = "conv_id long, turn long, role string, text string"


def test_rotation(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", None), (1, None, None, "late"), (1, 2, "ann", "again"), (1, 2, "ann", "again"), (2, 0, "system", "only"), (None, 5, " ", "n")]
    out = chat_rotation.rotate(spark.createDataFrame(rows, TURNS)).collect()
    by = {}
    for r in out:
        by.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "unknown")}
    for (_, who), turns in by.items():
        turns.sort(key=lambda r: r["position"])
        assert [r["position"] for r in turns] == list(range(len(turns)))
        text = "".join(r["segment"] for r in turns)
        for r in turns:
            assert text[r["start"] : r["end"]] == r["segment"]
            assert (r["target_start"] is not None) == (r["role"] == "assistant")
            if r["role"] == "assistant":
                assert text[r["target_start"] : r["target_end"]].endswith("<|end|>") and r["name"] is None
            elif r["role"] == "user":
                assert r["name"] not in (None, who)
    ann = by[1, "ann"]
    assert [r["segment"] for r in ann][:3] == ["<|system|>\nS<|end|>\n", "<|assistant|>\nhi < |x<|end|>\n", "<|assistant|>\nagain<|end|>\n"]
    assert ann[-1]["segment"] == "<|user unknown|>\nlate<|end|>\n"
    assert chat_rotation.rotate(spark.createDataFrame([], TURNS)).collect() == []


def test_rotation_of_a_long_conversation(spark):
    rows = spark.range(0, 3000).selectExpr("7L as conv_id", "id as turn", "concat('p', id % 3) as role", "repeat('x', cast(id % 11 as int)) as text", "1 as segment")
    out = chat_rotation.rotate(rows).where("perspective = 'p1'").orderBy("position").collect()
    assert len(out) == 3000 and [r["turn"] for r in out] == list(range(3000))
    assert all(a["end"] == b["start"] for a, b in zip(out, out[1:], strict=False))


def test_rotation_without_numbers_and_ids(spark):
    rows = [(None, None, f"p{i % 2}", f"t{i % 50:02d}") for i in range(400)] + [("", None, "p0", "one"), ("", 1, "p1", "two"), ("a", 1, "p0", "x" * (1 << 20))]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("segment", F.lit(0)).withColumn("k", F.lit("k")).withColumn("block", F.lit(9))
    out = chat_rotation.rotate(frame).collect()
    assert Counter((r["conv_id"], r["perspective"]) for r in out) == {(None, "p0"): 400, (None, "p1"): 400, ("", "p0"): 2, ("", "p1"): 2, ("a", "p0"): 1}
    for who in ("p0", "p1"):
        mine = sorted((r for r in out if r["conv_id"] is None and r["perspective"] == who), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(400)) and all(a["end"] == b["start"] for a, b in zip(mine, mine[1:], strict=False))
        want = sorted((r, t) for _, _, r, t in rows[:400])
        assert [("p0" if (r["role"] == "assistant") == (who == "p0") else "p1", r["segment"].split("\n")[1][:3]) for r in mine] == [(a, t) for a, t in want]


# 2


def brute_repetition(text):
    words = WORDS.findall(text or "")

    def covered(k):
        n = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        flags = [False] * len(words)
        for i in range(len(words) - k + 1):
            if n[tuple(words[i : i + k])] > 1:
                flags[i : i + k] = [True] * k
        return flags

    longest, k = 0, 8
    while True:
        grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        if len(set(grams)) == len(grams):
            break
        longest, k = k, k + 1
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    # maximal repeats by definition: found twice, and with unequal words (or none) on both sides
    maximal, k = 0, 8
    while k <= longest:
        at: dict[tuple, list[int]] = {}
        for i in range(len(words) - k + 1):
            at.setdefault(tuple(words[i : i + k]), []).append(i)
        for spots in at.values():
            left = {words[i - 1] if i else None for i in spots}
            right = {words[i + k] if i + k < len(words) else None for i in spots}
            maximal += len(spots) > 1 and len(left) > 1 and len(right) > 1
        k += 1
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(covered(5)), sum(len(w) for w, c in zip(words, covered(8), strict=True) if c), longest, maximal,
    )


REPETITIVE = ["a b c d e f g h i " * 5, "x\ny\nx\n \n \nx", "# <| |> é*", "to be or not to be or not to be or not " * 3 + "z", "p q r s t u v w " + " ".join(f"n{i}" for i in range(90)) + " p q r s t u v w"]


def test_repetition(spark):
    rows = [(i, t) for i, t in enumerate(REPETITIVE + [t for _, t in corpus(5)])]
    out = repetition.repetition_rules(frame(spark, rows).withColumn("kept", F.lit(1))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat", "n_maximal_repeats")
    for r in out:
        assert tuple(r[n] for n in names) == brute_repetition(r["text"]), r["text"]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert repetition.repetition_rules(frame(spark, rows).limit(0)).collect() == []


def test_maximal_repeats():
    rng = random.Random(3)
    for _ in range(30):
        s = [rng.choice("ab") for _ in range(rng.randint(2, 40))]
        symbols = np.array([ord(c) for c in s] + [10_000], np.uint64)
        order, levels = repetition.suffix_ranks(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        lcp = repetition.common_prefixes(order, levels, 1)
        before = np.concatenate([[9_999], symbols[:-1]])
        found = {tuple(symbols[order[f] : order[f] + k].tolist()): last - f + 1 for k, f, last in repetition.lcp_intervals(lcp, order, before)}
        want = {}
        for k in range(1, len(s)):
            for i in range(len(s) - k + 1):
                g = tuple(symbols[i : i + k].tolist())
                at = [j for j in range(len(s) - k + 1) if tuple(symbols[j : j + k].tolist()) == g]
                if len(at) > 1 and len({before[j] for j in at}) > 1 and len({symbols[j + k] for j in at}) > 1:
                    want[g] = len(at)
        assert found == want


# 3


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed):
    rows = corpus(seed)
    rng = random.Random(seed)
    long = [t for _, t in rows if t and len(TOKENS.findall(t)) > 30]
    items = []
    for i in range(12):
        w = TOKENS.findall(rng.choice(long))
        at = rng.randrange(len(w) - 12)
        items.append((i, " ".join(w[at : at + rng.choice((1, 3, 10, 25))]).upper() if i % 3 else "!".join(w[at : at + 15])))
    items += [(12, "never seen words"), (13, None), (14, ""), (3, "one"), (None, "a b")]
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = TOKENS.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add("" if i is None else str(i))
    rows = [*rows, (None, "ONE a b"), rows[0]]
    out = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["item_ids"])) for r in out)
    want = Counter()
    for d, t in rows:
        w = TOKENS.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if found := windows.get(tuple(w[s : s + k])):
                    ids |= found
                    hit.update(range(s, s + k))
        want[d, len(w), len(hit), len(ids), ",".join(sorted(ids))] += 1
    assert got == want
    assert any(r["n_near"] for r in out)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.contamination(frame(spark, rows), none).collect()} == {0}
    assert decontaminate.contamination(frame(spark, rows).limit(0), none).collect() == []


@pytest.mark.parametrize("slop", [2, 20])
def test_proximity(spark, slop):
    rows = [*corpus(3), (None, "one two, three four")]
    docs = [(d, TOKENS.findall((t or "").translate(LOWER))) for d, t in rows]
    rng = random.Random(slop)
    items = [(90, "zzunseen alone"), (91, "w1 w1 w1"), (92, "w1"), (93, None), (94, "one zzunseen three four")]
    for i in range(16):
        w = list(rng.choice([x for _, x in docs if len(x) > 30]))
        at, size = rng.randrange(len(w) - 20), rng.choice((4, 8, 10, 15, 19))
        w = w[at : at + size]
        if i % 4:
            w[len(w) // 2] = "zzunseen"  # in all windows of the item
        if i % 3 == 0:
            w[1:2] = ["w7", w[0]]
        items.append((i, " ".join(w)))
    df = Counter(t for _, w in docs for t in w)
    want: dict[tuple, set] = {(d, tuple(w)): set() for d, w in docs}
    for i, text in items:
        w = TOKENS.findall(text or "")
        anchors = set()
        for s in range(max(1, len(w) - 9) if w else 0):
            ranked = sorted((df[w[q]], w[q], q) for q in range(s, min(s + 10, len(w))))
            present = [(t, q) for n, t, q in ranked if n]
            anchors |= set(present[:1] + [x for x in present if x[0] != present[0][0]][:1])
        for d, words in docs:
            spots = [(p - q, t) for p, x in enumerate(words) for t, q in anchors if x == t]
            if any(a[1] != b[1] and abs(a[0] - b[0]) <= slop for a in spots for b in spots):
                want[d, tuple(words)].add(str(i))
    out = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), slop=slop).collect()
    found = Counter((r["doc_id"], r["n_words"], r["n_near"]) for r in out)
    assert found == Counter((d, len(w), len(want[d, tuple(w)])) for d, w in docs)
    assert Counter((r["doc_id"], r["n_words"], ",".join(r["near_ids"])) for r in out) == Counter((d, len(w), ",".join(sorted(want[d, tuple(w)]))) for d, w in docs)
    assert next(r for r in out if r["doc_id"] is None and r["n_words"] == 4)["near_ids"] == ["94"]


# 4


PAGES = "page_id long, url string, html string"


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x?y", "<p>A &amp; B</p><script>no</script><p>c\n d"), (2, None, None), (None, "u", ""), (1, "http://a/x?y", "<p>A &amp; B</p><script>no</script><p>c\n d")]
    records = warc.responses(spark.createDataFrame(rows, PAGES).withColumn("record", F.lit(0)))
    sources = {r["record"]: dict(next(warc.parse(bytes(r["record"])))[0]) for r in records.collect()}
    out = warc.derivatives(records).collect()
    assert len(out) == 8 and Counter(r["type"] for r in out) == {"metadata": 4, "conversion": 4}
    for r in out:
        (fields, block), = warc.parse(bytes(r["record"]))
        source = next(s for s in sources.values() if s["warc-record-id"] == r["source_id"])
        assert fields["warc-refers-to"] == source["warc-record-id"] and fields["warc-refers-to-target-uri"] == source["warc-target-uri"]
        assert fields["warc-refers-to-date"] == source["warc-date"] and fields["warc-block-digest"] == warc.digest(block) and int(fields["content-length"]) == len(block)
        if r["type"] == "metadata":
            assert source["warc-payload-digest"].encode() in block and b"source-header-content-type: text/html" in block and b"verified: true" in block
    texts = {bytes(r["record"]).split(b"\r\n\r\n")[1].decode() for r in out if r["type"] == "conversion"}
    assert texts == {"A & B\nc\nd", ""}
    path = str(tmp_path / "w")
    warc.write_records(warc.derivatives(records), path)
    back = warc.read_records(spark, path)
    assert sorted((r["record_id"], bytes(r["block"])) for r in back.collect()) == sorted((f["warc-record-id"], b) for r in out for f, b in warc.parse(bytes(r["record"])))
    assert warc.derivatives(records.limit(0)).collect() == []


def test_warc_parsing():
    one = warc.response(1, "u", "body", "2024-01-01T00:00:00Z")
    assert [f["warc-type"] for f, _ in warc.parse(one + one)] == ["response"] * 2
    assert len(list(warc.parse(warc.member(one) + warc.member(one)))) == 2 and len(list(warc.parse(gzip.compress(one + one)))) == 2
    assert len(list(warc.parse(one + one[:-20]))) == 1 and list(warc.parse(b"junk")) == []
    fields = {"warc-record-id": "<x>", "content-type": "image/png"}
    assert [dict(f)["WARC-Type"] for f, _ in warc.derive(fields, b"\x89PNG")] == ["metadata"]


def test_warc_damage():
    one, two = (warc.response(i, "u", f"body {i}", "2024-01-01T00:00:00Z") for i in (1, 2))
    ids = lambda data: [f["warc-record-id"] for f, _ in warc.parse(data)]
    (first,), (second,) = ids(one), ids(two)
    size = next(x for x in one.split(b"\r\n") if x.startswith(b"Content-Length"))
    for bad in (one.replace(size, b"Content-Length: x"), one.replace(size, b"Content-Length: 99999999"), one.replace(size, b"Content-Length: " + b"9" * 9000), b"WARC/1.1\r\n\xff\xfe: x\r\nContent-Length: ?\r\n\r\n\r\n\r\n"):
        assert ids(bad + two) == [second] and ids(two + bad + two) == [second, second]
    assert ids(one.replace(b"WARC-Type", b"\xff\xfe")) == [first]
    broken = bytearray(warc.member(one))
    broken[len(broken) // 2] ^= 0xFF
    broken[len(broken) // 2 + 1] ^= 0xFF
    assert ids(bytes(broken) + warc.member(two)) [-1:] == [second] and ids(warc.member(two) + bytes(broken)) == [second]
    assert ids(warc.member(one) * 3000) == [first] * 3000
    made = warc.response(3, "http://a/\r\nX: y z", None, "d")
    assert next(warc.parse(made))[0]["warc-target-uri"] == "http://a/%0D%0AX:%20y%20z"


def test_warc_text_of_a_broken_megabyte():
    for text in ("<p " * (1 << 19), "<a" * (1 << 19), "<script>" * (1 << 17), "</script " * (1 << 17), " \n" * (1 << 19), "<!--" * (1 << 18), "&#" + "9" * (1 << 20), "<" * (1 << 20)):
        start = time.monotonic()
        warc.plain_text(text)
        assert time.monotonic() - start < 10
    assert warc.plain_text("<p title='a>b'>x &lt;y&gt; <br/>z</p  >") == "x <y>\nz"


def test_warc_files(spark, tmp_path):
    rows = [warc.response(i, f"http://a/{i}", "body\r\n\r\nWARC/1.1\r\nnot a record\r\n\r\n" * (i % 3) + "\xff" * i, "d") for i in range(40)]
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(rows[:20]))
    (folder / "b.warc.gz").write_bytes(b"".join(map(warc.member, rows[20:])))
    (folder / "c.warc").write_bytes(rows[0] + rows[1][:-30])
    (folder / "d.warc").write_bytes(b"")
    out = warc.read_records(spark, str(folder)).collect()
    want = Counter((f["warc-record-id"], b) for r in [*rows, rows[0]] for f, b in warc.parse(r))
    assert Counter((r["record_id"], bytes(r["block"])) for r in out if r["problem"] is None) == want
    (bad,) = (r for r in out if r["problem"])
    assert bad["problem"] == "cut short" and bad["block"] is None and bad["file"].endswith("c.warc")


# 5


def brute_components(rows, size):
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 5)])
def test_near_duplicates(spark, seed, size):
    rows = corpus(seed, 150)
    got = near_dedup.near_duplicates(frame(spark, rows).withColumn("n_shingles", F.lit(0)), shingle=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_around_a_hub(spark):
    """Copies that are similar to a base but not to each other, in more than one chunk."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        words = list(base)
        for j in rng.sample(range(200), rng.choice((8, 9, 10, 11, 14))):
            words[j] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    old = near_dedup.CHUNK_ROWS
    near_dedup.CHUNK_ROWS = 16
    try:
        got = near_dedup.near_duplicates(frame(spark, rows), shingle=2).collect()
    finally:
        near_dedup.CHUNK_ROWS = old
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 2)


def test_near_duplicates_defined_cases(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "x y z"), (2, "x y z"), (9, "a b c"), (5, None), (6, ""), (7, "q"), (8, "Q")]
    got = near_dedup.near_duplicates(frame(spark, rows), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {None: None, 4: 2, 2: 2, 9: 2, 5: 5, 6: 6, 7: 7, 8: 7}
    assert len(got) == len(rows) and [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0), shingle=2).collect() == []


def test_sketches():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(a[:200]), np.unique(a[40:240]), a[:1], np.unique(a[:3])]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    s = near_dedup.sketch(np.concatenate(sets), off, 240)
    assert s.shape == (4, 240) and (s[2] >> np.uint64(32)).max() <= 479
    assert abs((s[0] == s[1]).mean() - 160 / 240) < 0.1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    label = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(70):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["vertex"]: r["component"] for r in got} == label and len(got) == len(label)


# 6


def test_html_marginals_are_exact():
    model = html_tree.train(20, 10)
    tree = html_tree.parse("<div id=content><p>one two<b>x</b></p><ul><li>a</ul></div>")
    a = html_tree._arrays([tree])
    n = len(tree.tag)
    total, one = 0.0, np.zeros(n)
    unary = html_tree._unary(a, model.node)
    for states in range(1 << n):
        s = [states >> i & 1 for i in range(n)]
        e = sum(unary[i] for i in range(n) if s[i]) + sum(model.edge[a["edge"][i], s[a["parent"][i]], s[i]] for i in range(1, n))
        total += np.exp(e)
        one += np.exp(e) * np.array(s)
    assert np.allclose(html_tree.marginals(model, a)[0], one / total)


def test_html_held_out_pages():
    model = html_tree.train()
    right = every = 0
    for page in html_labelled.labelled_pages(120, seed=5):
        tree = html_tree.parse(page)
        p, _ = html_tree.marginals(model, html_tree._arrays([tree]))
        for i in {i for i, text, _ in tree.texts if text.strip() and tree.tag[i] not in html_tree.HIDDEN}:
            every += 1
            right += (p[i] >= 0.5) == tree.main[i]
    assert right / every > 0.97


def test_html_cases(spark):
    good = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy now</div><article><h1>T &amp; U</h1><p>First <b>bo</b>ld\n\n text<p>Second &eacute;<br>line</article><footer>&copy; x</footer>"
    rows = [(1, "u", good), (2, None, None), (3, "", ""), (None, "v", good), (5, "w", "<article><p>x<script>var a='</p>'"), (6, "w", "<" * 50 + "div" * 3000), (7, "w", "<div>" * 3000 + "deep")]
    out = {(r["page_id"], r["url"]): r for r in html_tree.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[1, "u"]["text"] == out[None, "v"]["text"] == "T & U First bold text Second é line"
    assert out[2, None]["text"] == out[3, ""]["text"] == "" and out[3, ""]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in out.values()) and len(out) == 7 and "var" not in out[5, "w"]["text"]
    assert html_tree.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_html_nests_deeper_than_two_hundred():
    model = html_tree.train()
    menu = "<nav class=menu><ul><li><a href=/>Home</a></ul></nav>"
    words = " ".join(["ba ko ri tes un la mor en"] * 4)
    nest = "<div>" * 300 + f"<button>Press</button><script>var a='</div>'</script><p>{words} inmost</p>" + "</div>" * 300
    page = f"{menu}<div class=wrapper><article><h1>Ba ko</h1><p>{words} before</p>{nest}<p>{words} after</p></article><footer>copyright</footer></div>"
    tree = html_tree.parse(page)
    assert max(tree.depth) > 300 and all(tree.depth[i] == tree.depth[p] + 1 for i, p in enumerate(tree.parent) if p >= 0)
    at = {text.split()[-1]: tree.tag[i] for i, text, _ in tree.texts}
    assert at["Press"] == "button" and at["inmost"] == at["after"] == "p"
    above = {text.split()[-1]: tree.tag[tree.parent[i]] for i, text, _ in tree.texts}
    assert above["inmost"] == "div" and above["before"] == above["after"] == "article"
    text = html_tree.extract(model, [page])[0]
    assert text.startswith(f"Ba ko {words} before") and text.endswith(f"{words} after") and "Press" not in text
    quoted = html_tree.extract(model, [page.replace("<div>", "<blockquote>").replace("</div>" * 300, "</blockquote>" * 300)])[0]
    assert quoted == f"Ba ko {words} before {words} inmost {words} after"


def test_html_marginals_of_a_deep_chain_are_exact():
    model, a = html_tree.train(20, 10), html_tree._arrays([html_tree.parse("<font>" * 5000 + "deep" + "</i>" * 5000)])
    unary, edge = html_tree._unary(a, model.node), model.edge[a["edge"]]
    n = len(unary)
    assert a["parent"].tolist() == list(range(-1, n - 1))
    down, up = np.zeros((n, 2)), np.zeros((n, 2))  # sums over the chain above and below a node
    for i in range(1, n):
        down[i] = np.logaddexp(down[i - 1, 0] + edge[i, 0], down[i - 1, 1] + unary[i - 1] + edge[i, 1])
        up[-i - 1] = np.logaddexp(up[-i, 0] + edge[-i, :, 0], up[-i, 1] + unary[-i] + edge[-i, :, 1])
    odds = unary + down[:, 1] - down[:, 0] + up[:, 1] - up[:, 0]
    assert np.allclose(html_tree.marginals(model, a)[0], 1 / (1 + np.exp(-odds)))


@pytest.mark.parametrize("name", ["noscript", "template", "svg", "select"])
def test_html_unclosed_hidden_elements_end_with_their_parents(name):
    model = html_tree.train()
    words = " ".join(["ba ko ri tes un la mor en"] * 4)
    page = "<nav class=menu><ul><li><a href=/>Home</a></ul></nav><div class=search>{}</div><article><h1>Ba ko</h1><p>%s before{}</p><p>%s after</p></article>" % (words, words)
    want = f"Ba ko {words} before {words} after"
    inside = "<option>Not this" if name == "select" else "Not this"
    closed, nested = f"<{name}>{inside}<p>Nor this</p></{name}>", f"<{name}><{name}>{inside}</{name}>Nor this</{name}>"
    for made in (closed, nested, f"<{name}>{inside}", f"<{name} a='>'>{inside}<script>'</{name}>'</script><!--</{name}>-->", f"<{name} b=''/>"):
        assert html_tree.extract(model, [page.format("", made)]) == [want]
        # in an element of its own before the article, and a closed one later
        assert html_tree.extract(model, [page.format(made, "")]) == [want]
        assert html_tree.extract(model, [page.format(made, closed)]) == [want]


def test_html_markup_breaks_out_of_unclosed_foreign_elements():
    tree = html_tree.parse("<div><svg><g><foreignObject><p>in</p></foreignObject><text>too</text><svg><p>out</div>")
    chains = {}
    for i, text, _ in tree.texts:
        chains[text] = []
        while i > 1:
            chains[text].append(tree.tag[i])
            i = tree.parent[i]
    assert chains == {"in": ["p", "foreignobject", "g", "svg", "div"], "too": ["text", "g", "svg", "div"], "out": ["p", "div"]}
    cut = html_tree.parse("a<script>b<p>c")
    assert [t for _, t, _ in cut.texts] == ["a"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_html_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_tree.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|h2|br)>", " ", inner))).split())


# 7


def brute_windows(rows, k):
    first: dict[tuple, tuple] = {}
    low = -(1 << 70)
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - k + 1):
            key = (low if d is None else d, i)
            first[tuple(w[i : i + k])] = min(first.get(tuple(w[i : i + k]), key), key)
    out = Counter()
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (low if d is None else d, i):
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("seed", "k", "m"), [(1, 20, 4), (2, 20, 4), (3, 5, 2)])
def test_substring_dedup(spark, seed, k, m):
    rows = corpus(seed, 120)
    rows = [*rows, (None, rows[3][1]), rows[7], (rows[7][0], rows[8][1])]
    out = substring_dedup.dedup_substrings(frame(spark, rows).withColumn("n_words", F.lit("x")), k=k, m=m)
    got = Counter(map(tuple, out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()))
    assert got == brute_windows(rows, k)


def test_substring_dedup_with_a_hot_passage(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + " " + passage + f" t{i}" * 25) for i in range(300)]
    out = substring_dedup.dedup_substrings(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert Counter(map(tuple, out)) == brute_windows(rows, 20)
    empty = frame(spark, rows).limit(0)
    assert substring_dedup.dedup_substrings(empty).collect() == []


def test_substring_dedup_with_hot_minimisers_and_many_buckets(spark, monkeypatch):
    for name, value in (("HOT_BYTES", 1 << 13), ("BUCKET_BYTES", 1 << 12), ("MOST_PARTITIONS", 3)):
        monkeypatch.setattr(substring_dedup, name, value)
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(["a", "b", "c d e f"], k=80))) for i in range(250)]
    hot, partitions, buckets = substring_dedup._plan(frame(spark, rows), 20, 4, 2)
    assert len(hot) and partitions > 2 and buckets > 1
    out = substring_dedup.dedup_substrings(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert Counter(map(tuple, out)) == brute_windows(rows, 20)


def test_bucket_parts_and_hash_clashes(monkeypatch):
    rng = random.Random(1)
    rows = [(d, " ".join(rng.choices("abc", k=60))) for d in range(40)]
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 500)
    for clash in (False, True):
        if clash:  # all windows of a bucket share a hash
            real = textops.span_hashes
            monkeypatch.setattr(substring_dedup.tx, "span_hashes", lambda v, s, e, which=0: np.zeros(len(s), np.uint64) if which == 1 else real(v, s, e, which))
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
        parts: dict[int, list] = {}
        for b in substring_dedup._send(iter([batch]), 6, 2, 3, 4, np.zeros(0, np.uint64)):
            for i in range(b.num_rows):
                parts.setdefault(b.column("part")[i].as_py(), []).append(b.slice(i, 1))
        for pieces in parts.values():
            pieces.sort(key=lambda x: x.column("bucket")[0].as_py())
        gone = {d: set() for d, _ in rows}
        for pieces in parts.values():
            for b in substring_dedup._receive(iter(pieces), 6):
                for r in b.to_pylist():
                    gone[r["doc_id"]].update(range(r["start"], r["start"] + r["n"] + 5))
        want = {d: n for (d, _, n, _), c in brute_windows(rows, 6).items()}
        assert {d: len(g) for d, g in gone.items()} == want


# 8


def test_quality(spark):
    rng = random.Random(0)
    good = lambda: ". ".join(" ".join(rng.choices(["the", "cat", "sat", "on", "mats", "while", "dogs", "ran"], k=9)).capitalize() for _ in range(5))
    junk = lambda: " ".join(w + "!!" for w in rng.choices(["BUY", "NOW", "CHEAP", "X1"], k=40))
    rows = [(i, good() if i % 3 else junk()) for i in range(600)]
    docs = frame(spark, [*rows, (None, good()), (9000, None), (9001, "")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(5, 0, 0), (None, 1, 0), (7, None, 0), (8, 9, 0)], "doc_id long, quality int, toxic int")
    out = quality_fm.quality_scores(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(out) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 9000]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.97
    one = quality_fm.quality_scores(docs, labels.where("quality = 1")).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.9
    assert {r["score"] for r in quality_fm.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_fm.quality_scores(docs.limit(0), labels).collect() == []


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    size = quality_fm.BUCKETS + quality_fm.STATS
    machine = quality_fm.Machine(0.1, rng.normal(size=size) * 0.1, rng.normal(size=(size, 3)) * 0.1, np.zeros(quality_fm.STATS), np.ones(quality_fm.STATS))
    texts = pa.array(["one two two THREE!!", "", "x"])
    at, bucket, value, stats = quality_fm.inputs(texts)
    for row, got in enumerate(quality_fm.score(machine, texts)):
        x = np.zeros(size)
        x[bucket[at == row]] = value[at == row]
        x[quality_fm.BUCKETS :] = stats[row]
        some = np.flatnonzero(x)
        z = machine.bias + machine.weights @ x + sum(machine.factors[i] @ machine.factors[j] * x[i] * x[j] for n, i in enumerate(some) for j in some[n + 1 :])
        assert np.isclose(got, 1 / (1 + np.exp(-z)))


# 9 and 10


@pytest.fixture(scope="module")
def vocabularies():
    return pytest.importorskip("public_tokenizers")


ODD = ["", " ", "  a", "a  b\n\n c ", "\n", "tab\there", "é ß ▁x", "日本語 テスト 😀😀", "a" * 60, "<s> </s> <0x0A>", "x\xa0y \x85 z", "don't we'll 12 345", "İstanbul ΣΑΣ ﬁ é", "<|endoftext|> q", "\x0b\x0c v"]


def test_sentencepiece(spark, vocabularies):
    import sentencepiece

    path = vocabularies.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*corpus(3), *((10_000 + i, t) for i, t in enumerate(ODD)), (None, "x"), (None, "x")]
    out = sentencepiece_trie.encode(frame(spark, rows).withColumn("ids", F.lit(1)), path)
    for r in sentencepiece_trie.decode(out, path).collect():
        assert r["ids"] == library.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    done = sentencepiece_trie.encode_and_decode(frame(spark, rows), path, with_ids=True).collect()
    assert len(done) == len(rows)
    for r in done:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert [r["doc_id"] for r in done if not r["round_trip"]] == [10_000 + ODD.index("é ß ▁x")]
    assert sentencepiece_trie.encode(frame(spark, rows).limit(0), path).collect() == []


def test_unigram_viterbi():
    rng = random.Random(1)
    score = {p: -rng.random() * 5 - 1 for p in {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(40)} | set("abc")}
    model = sentencepiece_trie.Model(False, score, {p: i for i, p in enumerate(score)}, [], 0, [], 4)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(200)})

    def best(word):
        return max((score[word[:i]] + best(word[i:]) for i in range(1, len(word) + 1) if word[:i] in score), default=-1e9) if word else 0.0

    for word, parts in zip(words, sentencepiece_trie.shared_prefix(words, model), strict=True):
        assert "".join(parts) == word and np.isclose(sum(score[p] for p in parts), best(word))


def test_code_lengths():
    import heapq

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 200):
        counts = rng.integers(1, 10_000, n) ** rng.integers(1, 3)
        lengths = huffman.code_lengths(counts, 18)
        assert sum(2.0 ** -lengths) <= 1 and lengths.max() <= 18
        heap = list(counts.tolist())
        heapq.heapify(heap)
        cost = 0 if n > 1 else counts[0]
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        if lengths.max() < 18:
            assert (lengths * counts).sum() == cost
    fibonacci = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    assert huffman.code_lengths(fibonacci, 5).max() == 5 and sum(2.0 ** -huffman.code_lengths(fibonacci, 5)) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_bits_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 511, 512, 513, 5000):
        stream = rng.choice(1000, n, p=np.r_[0.5, np.full(999, 0.5 / 999)])
        ids, counts = np.unique(stream, return_counts=True)
        bits = huffman.code_lengths(counts, 12)
        payload, marks = huffman.encode_bits(stream, *huffman.canonical(ids, bits))
        assert len(marks) == -(-n // huffman.STEP) and len(payload) == -(-int(bits[np.searchsorted(ids, stream)].sum()) // 8)
        assert (huffman.decode_bits(payload, marks, n, *huffman.decode_table(ids, bits)) == stream).all()


def test_token_files(spark, vocabularies, monkeypatch):
    from tokenizers import Tokenizer

    path = vocabularies.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*corpus(4), *((20_000 + i, t) for i, t in enumerate(ODD)), (None, "null id"), (5_000_000, "same id"), (5_000_000, "same id"), (5_000_000, None)]
    got = sorted(huffman.token_files(frame(spark, rows), path).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    want = Counter()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert huffman.token_files(frame(spark, rows).limit(0), path).collect() == []
    from quillon.storage import new_path

    where = new_path(spark, "t")
    huffman.write_token_files(frame(spark, rows), where, path)
    full = huffman.read_token_files(spark, where).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in full)


def test_long_runs_are_merged_like_short_ones(vocabularies):
    import sentencepiece

    path = vocabularies.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_trie.load(path)
    rng = random.Random(6)
    for text in [" " * 33, " " * 1000, "▁" * 77 + "word", " " * 40 + "a" * 90 + "  b", "".join(rng.choices("  \nab▁", k=3000)), "x" * 5000, "".join(rng.choices("etaoin shrdlu", k=4000))]:
        ids, off = sentencepiece_trie.encode_column(pa.array([text]), path)
        assert ids.tolist() == library.encode(text)
    for _ in range(200):  # the heap against the definition
        text = "▁" * rng.randint(1, 9) + "".join(rng.choices("aetnsior▁", k=rng.randint(5, 30)))
        assert model._merged_long(list(text)) == model.merged(text[:32]) or len(text) > 32


def test_a_megabyte_is_encoded_in_seconds(vocabularies):
    path = vocabularies.path("piece_bpe_32k.model")
    sentencepiece_trie.encode_column(pa.array(["warm"]), path)
    for text in (" " * (1 << 20), "▁" * (1 << 20), "a" * (1 << 20), "ab  " * (1 << 18), "é\n" * (1 << 18)):
        start = time.monotonic()
        ids, off = sentencepiece_trie.encode_column(pa.array([text, None, text[:7]]), path)
        assert sentencepiece_trie.decode_column(ids, off, path) == [text.replace("▁", " "), "", text[:7].replace("▁", " ")]
        assert time.monotonic() - start < 40
