"""Quality scores from a factorisation machine.

A text's inputs are its hashed words (counts scaled to unit length) and a dozen
structure statistics: shares of symbols, capitals, digits and non-letters, word and
line lengths, repetition, and its size as metadata.  The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

whose last term holds the interactions of all pairs of inputs at a cost linear in
the number of inputs that aren't zero.

Training is on the driver, on at most ``max_per_class`` labelled texts of each class,
those with the smallest hashes of their ids; only their inputs are collected.  The
intercept is then moved to the label shares of all labelled rows.

Defined cases.  A null text is empty; an empty one has statistics of 0 and is scored
like any other.  Labels other than 0 and 1, of null ids, or contradicting each other
are not learned from.  If a class has no labelled text, all scores are the share of
label 1 with one row added to each class.  Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx

SLICE_BYTES = 2 << 20
BUCKETS = 1 << 12
STATS = 14
#: Small samples are gone through more often, up to so many batches.
MIN_STEPS = 240
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


@dataclass
class Machine:
    """Weights of the model, and the scales of the statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def inputs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values of hashed words, and the raw statistics of each row."""
    words = tx.Words(texts)
    rows, n, row = len(texts), len(words), words.row()
    hashes = words.hashes()
    key = row * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    found, count = np.unique(key, return_counts=True)
    at, bucket = found // BUCKETS, found % BUCKETS
    norm = np.sqrt(np.bincount(at, count.astype(float) ** 2, rows))
    value = count / norm[at]

    buf, many = words.buf, np.maximum(words.count, 1)
    size = np.diff(words.off).astype(float)
    some = np.maximum(size, 1)
    letters = _sums(_LETTER[buf], words.off)
    per_word = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTER[buf] | _DIGIT[buf], out=per_word[1:])
    alnum = per_word[words.end] - per_word[words.start]
    last = buf[words.end - 1] if n else buf[:0]
    first = buf[words.start] if n else buf[:0]
    ends = ~(_LETTER[last] | _DIGIT[last])
    double = ends & (words.end - words.start >= 2)
    double[double] = ~(_LETTER[buf[words.end[double] - 2]] | _DIGIT[buf[words.end[double] - 2]])
    repeated = _repeats(hashes, row, 1, rows)
    repeated_5 = _repeats(hashes, row, 5, rows)
    lines = _sums(buf == 0x0A, words.off) + 1
    stats = np.stack(
        [
            (size - letters - _sums(tx.SPACES[buf], words.off)) / some,
            _sums(_CAPITAL[buf], words.off) / np.maximum(letters, 1),
            _sums(_DIGIT[buf], words.off) / some,
            _sums(buf >= 0x80, words.off) / some,
            _sums(alnum == 0, words.first) / many,
            _sums(ends, words.first) / many,
            _sums(double, words.first) / many,
            _sums(_CAPITAL[first], words.first) / many,
            repeated / many,
            repeated_5 / many,
            _sums(words.end - words.start, words.first) / many / 10,
            np.log1p(words.count) / 10,
            np.log1p(size) / 12,
            np.log1p(words.count / lines) / 8,
        ],
        1,
    )
    return at, bucket, value, stats


def _repeats(hashes: np.ndarray, row: np.ndarray, k: int, rows: int) -> np.ndarray:
    """For each row, the number of its k-word windows less the number of distinct ones."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(rows)
    inside = row[:n] == row[k - 1 :]
    at = row[:n][inside].astype(np.uint64)
    window = tx.window_hashes(hashes, k)[inside] if k > 1 else hashes
    # the row in the high bits keeps rows apart when sorted
    key = np.sort((at << np.uint64(44)) | (window >> np.uint64(20)))
    same = key[1:] == key[:-1]
    return np.bincount((key[1:][same] >> np.uint64(44)).astype(np.int64), minlength=rows).astype(float)


def score(machine: Machine, texts: pa.Array) -> np.ndarray:
    """The score of every text."""
    at, bucket, value, stats = inputs(texts)
    scaled = (stats - machine.mean) / machine.scale
    w, v = machine.weights, machine.factors
    rows = len(texts)
    total = machine.bias + np.bincount(at, w[bucket] * value, rows) + scaled @ w[BUCKETS:]
    for f in range(v.shape[1]):
        x, y = v[bucket, f] * value, v[BUCKETS:, f] * scaled
        both = np.bincount(at, x, rows) + y.sum(1)
        total += 0.5 * (both**2 - np.bincount(at, x**2, rows) - (y**2).sum(1))
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(at: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray, label: np.ndarray, factors: int, epochs: int, seed: int = 7) -> Machine:
    """Logistic loss by Adam in small batches; ``at`` ascends."""
    rng = np.random.default_rng(seed)
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    scaled = (stats - mean) / scale
    size = BUCKETS + STATS
    theta = np.zeros((size, 1 + factors))
    theta[:, 1:] = rng.normal(0, 0.02, (size, factors))
    m, s, bias, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0
    off = np.searchsorted(at, np.arange(len(label) + 1))
    per_epoch = -(-len(label) // 64)
    epochs = max(epochs, -(-MIN_STEPS // per_epoch))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            n = off[rows + 1] - off[rows]
            pick = np.repeat(off[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            r = np.repeat(np.arange(len(rows)), n)
            x = np.zeros((len(rows), size))
            x[r, index[pick]] = value[pick]
            x[:, BUCKETS:] = scaled[rows]
            v = theta[:, 1:]
            xv = x @ v
            x2 = x**2
            z = bias + x @ theta[:, 0] + 0.5 * ((xv**2) - x2 @ v**2).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label[rows]) / len(rows)
            grad = np.empty_like(theta)
            grad[:, 0] = x.T @ g
            grad[:, 1:] = x.T @ (g[:, None] * xv) - (x2.T @ g)[:, None] * v
            grad += 1e-4 * theta
            step += 1
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            rate = 0.02 * (1 - (step - 1) / (epochs * per_epoch))
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            bias -= rate * 5 * g.sum()
    return Machine(float(bias), theta[:, 0].copy(), theta[:, 1:].copy(), mean, scale)


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, "text", SLICE_BYTES):
        at, bucket, value, stats = inputs(batch.column("text"))
        off = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, STATS, dtype=np.int32)), pa.array(stats.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("label"), *lists, flat], ["label", "index", "value", "stats"])


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = 1500, factors: int = 4, epochs: int = 6) -> Machine:
    """Fit on labelled documents: ``docs(doc_id, text)``, ``labels(doc_id, label)``."""
    clear = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    clear = clear.where("label = most").select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in clear.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    flat = Machine(float(np.log(share / (1 - share))), np.zeros(BUCKETS + STATS), np.zeros((BUCKETS + STATS, factors)), np.zeros(STATS), np.ones(STATS))
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return flat
    chosen = [clear.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * max_per_class rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "label")
    table = rows.repartition(8).mapInArrow(_inputs, "label int, index array<int>, value array<float>, stats array<double>").toArrow()
    label = np.array(table.column("label"), float)
    if len(set(label.tolist())) < 2:
        return flat
    index, value, stats = (table.column(c).combine_chunks() for c in ("index", "value", "stats"))
    stats = stats.flatten().to_numpy().reshape(-1, STATS)
    # the order in which rows arrive must not matter
    order = np.lexsort([*stats.T, label])
    n = index.value_lengths().to_numpy()
    off = np.cumsum(n) - n
    at = np.repeat(np.arange(len(label)), n[order])
    pick = np.repeat(off[order] - np.cumsum(n[order]) + n[order], n[order]) + np.arange(n.sum())
    machine = fit(at, index.flatten().to_numpy()[pick], value.flatten().to_numpy()[pick], stats[order], label[order], factors, epochs)
    machine.bias += float(np.log(counts[1] / counts[0]) - np.log(label.sum() / (len(label) - label.sum())))
    return machine


def _score(batches: Iterator[pa.RecordBatch], machine: Machine, column: str) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, column, SLICE_BYTES):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(machine, batch.column(column)))], [*batch.schema.names, "score"])


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, label_col: str = "quality", **training: int) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    docs = docs.drop("held_out", "score", "predicted")
    known = labels.select("doc_id", F.col(label_col).alias("label")).where(~held_out(F.col("doc_id")))
    machine = train(docs, known, **training)
    scored = docs.mapInArrow(lambda it: tx.lean(_score(it, machine, "text")), tx.schema_with(docs, "score double"))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
