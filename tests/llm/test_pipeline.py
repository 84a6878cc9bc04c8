"""The pipeline's stages, each on what the one before kept, against brute force."""

from __future__ import annotations

import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def kept_after_near_dedup(texts: dict[int, str]) -> set[int]:
    sets = {}
    for d, t in texts.items():
        w = WORDS.findall(t.translate(LOWER))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return {d for d in label if label[d] == d}


def cut(texts: dict[int, str]) -> dict[int, str]:
    seen, out = set(), {}
    words = {d: t.encode().split() for d, t in texts.items()}
    for d in sorted(words):
        w = words[d]
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(g)
        left = [x for x, y in zip(w, gone, strict=True) if not y]
        if not any(gone):
            out[d] = texts[d]
        elif left:
            out[d] = b" ".join(left).decode()
    return out


def test_stages(spark):
    import public_tokenizers
    import sentencepiece

    from quillon.storage import stored

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, got = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "stage")
        got.append({r["doc_id"]: r for r in docs.collect()})
        if len(got) < 5:
            assert sorted(docs.columns) == sorted(columns), name
            assert all(r["n_chars"] == len(r["text"]) for r in got[-1].values())
    quality, distinct, short, clean, tokens = got

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    every = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and d in every]
    assert sum(d in quality for d in good) >= 0.97 * len(good)
    bad = [d for d, q in labels.items() if q == 0 and d in every]
    assert sum(d in quality for d in bad) <= 0.2 * len(bad)

    assert set(distinct) == kept_after_near_dedup({d: r["text"] for d, r in quality.items()})
    assert {d: r["text"] for d, r in short.items()} == cut({d: r["text"] for d, r in distinct.items()})

    grams = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = TOKENS.findall(r["text"].translate(LOWER))
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(g) for g in grams}

    def dirty(text: str) -> bool:
        w = TOKENS.findall(text.translate(LOWER))
        return any(tuple(w[i : i + k]) in grams for k in sizes for i in range(len(w) - k + 1))

    assert set(clean) == {d for d, r in short.items() if not dirty(r["text"])}

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(tokens) == set(clean)
    for d, r in tokens.items():
        assert r["round_trip"] and r["ids"] == library.encode(clean[d]["text"]) and r["n_tokens"] == len(r["ids"])

    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, DATA).collect()} == {d: r["ids"] for d, r in tokens.items()}


ROWS = [
    (1, "The harbour was rebuilt in three stages. The oldest quay still carries the marks of the first cranes, and few visitors ever notice them."),
    (2, "The harbour was rebuilt in three stages. The oldest quay still carries the marks of the first cranes, and few visitors ever notice them."),
    (2, "The harbour was rebuilt in three stages. The oldest quay still carries the marks of the first cranes, and few visitors ever notice them."),
    (3, None),
    (4, ""),
    (4, ""),
    (None, "A survey of the warehouses found that most roofs date from the years after the great fire."),
    (5, "One more text that says: a b c d e f g h i j k l m and then something else."),
    (6, " \n\t"),
    (7, " ".join(f"word{i}" for i in range(100_000))),
    (8, "Before. " + " ".join(f"word{i}" for i in range(50, 80)) + " after."),
]


@pytest.fixture
def odd(spark, tmp_path):
    """Tables with nulls, blanks, repeats and columns named like those that operators add."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    extra = {"score": F.lit("mine"), "kept": F.lit(None).cast("int"), "h": F.lit(1.5), "n_words": F.lit("w"), "ranges": F.lit("r"), "component_id": F.lit(7), "a.b": F.lit("dot"), "given_score": F.lit("g")}
    docs = docs.withColumns(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("x", "A B C, d e f g h i j k"), (None, None), ("y", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    every = sorted(map(repr, docs.collect()))

    def after(name, table=docs):
        out = stages[name](spark, table, odd)
        assert out.columns == table.columns and [f.dataType for f in out.schema] == [f.dataType for f in table.schema]
        return out

    scored = after("quality classifier").collect()
    assert set(map(repr, scored)) <= set(every) and all(r["score"] == "mine" and r["a.b"] == "dot" for r in scored)
    near = after("MinHash near-dedup").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in near if r["doc_id"]) == [(False, i) for i in (1, 3, 4, 4, 5, 6, 7, 8)] and sum(r["doc_id"] is None for r in near) == 1
    short = {r["doc_id"]: r["text"] for r in after("substring dedup").collect()}
    assert short[1] == ROWS[0][1] and 2 not in short and short[3] is None and short[4] == "" and short[6] == " \n\t" and short[8] == "Before. after." and short[7] == ROWS[9][1]
    clean = after("benchmark decontamination").collect()
    assert sorted(map(repr, clean)) == [r for r in every if "doc_id=5," not in r]
    tokens = stages["SentencePiece encoding and decoding"](spark, docs, odd).collect()
    assert len(tokens) == len(ROWS) and all(r["round_trip"] for r in tokens) and [r["n_tokens"] for r in tokens if r["doc_id"] == 3] == [0]
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), odd).collect() == [], name


def test_run_takes_odd_rows(spark, odd):
    out = corpus_pipeline.run(spark, odd).collect()
    assert all(r["round_trip"] for r in out) and not {2, 5} & {r["doc_id"] for r in out}
