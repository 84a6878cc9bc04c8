"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``k`` consecutive words.  Its minimiser is the smallest hash among
the ``m``-word groups in it, so equal windows have equal minimisers.  Consecutive
windows that share one travel together, as one packed string (their words joined
by single spaces), to the bucket of that minimiser.  In a bucket, windows are
sorted and the first of each kind (smallest document id, then smallest start)
stays; all later ones are reported and the words they cover removed.

Skew.  Equal packed strings within a slice of input are sent once: all but the
first are repeats, whatever else the corpus holds.  A first pass sums the bytes of
every minimiser's strings.  Those with more than a part holds are hot: their windows
travel one by one, dealt by the hash of the whole window.  The first pass also sets
the number of buckets, so that their size doesn't grow with the input.  A task takes
its buckets one after another and holds one at a time.

Defined cases.  A null or blank text has no words.  Texts of fewer than ``k``
words have no windows; a text of any length is read whole.  A null id sorts before
all others and is treated as one id.  Rows that share an id and a text are the same
document: neither is earlier than the other, so both keep what one would keep.  Rows
that share an id but differ in text are separate; windows at equal starts (a tie)
are then both kept.  An empty table gives an empty one.  Columns named like the ones
added are replaced, others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import textops as tx

SLICE_BYTES = 2 << 20
#: A packed string holds so many windows at most; a longer run is cut.
MAX_RUN = 256
#: Text bytes that a bucket sorts at once.
PART_BYTES = 4 << 20
#: Bytes of strings that a bucket is to hold, and that make a minimiser hot.
BUCKET_BYTES, HOT_BYTES = 32 << 20, 8 << 20
#: A partition is one bucket up to so many partitions; then each takes several, sorted.
MOST_PARTITIONS = 50_000
#: Hot minimisers there can be: each has over this share of all bytes.
HOT_KEYS = 4_000_000
_NULL_ID = -(1 << 63)
_FIELDS = (("doc", np.int64), ("crc", np.uint32), ("start", np.int32), ("words", np.int32), ("size", np.int32), ("sub", np.uint16))
_REPEATS = "doc_id long, crc long, start int, n int"


def _pack(columns: dict[str, np.ndarray], text: np.ndarray) -> bytes:
    head = np.int64([len(columns["doc"])]).tobytes()
    parts = [np.ascontiguousarray(columns[name], kind).tobytes() for name, kind in _FIELDS]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, *parts, text.tobytes()]))


def _unpack(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, columns = int(np.frombuffer(raw, np.int64, 1)[0]), 8, {}
    for name, kind in _FIELDS:
        columns[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return columns, np.frombuffer(raw, np.uint8, len(raw) - at, at)


class _Runs:
    """The super-k-mers of a slice: window ranges by first word, with a key each."""

    def __init__(self, batch: pa.RecordBatch, k: int, m: int, hot: np.ndarray):
        self.words = words = tx.Words(batch.column("text"))
        n = len(words) - k + 1
        self.start = self.stop = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n <= 0:
            return
        hashes = words.hashes()
        least = tx.sliding_min(tx.mix(tx.window_hashes(hashes, m), 7), k - m + 1)
        row = words.row()
        inside = row[:n] == row[k - 1 :]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | (row[1:n] != row[: n - 1])
        if len(hot):
            at = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
            single = hot[at] == least
            new |= single
            least = np.where(single, tx.mix(tx.window_hashes(hashes, k), 11), least)
        begin = np.flatnonzero(new)
        since = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        new |= since % MAX_RUN == 0
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], n)
        keep = inside[begin]
        self.start, self.stop = begin[keep], stop[keep]
        # the last run before a row's end is followed by windows that cross into the next row
        last = words.first[row[self.start] + 1] - k + 1
        self.stop = np.minimum(self.stop, last)
        self.key = least[self.start]
        self.row = row[self.start]
        self.content = tx.span_hashes(hashes, self.start, self.stop + k - 1)


def _weights(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    """For each slice and minimiser the bytes of its distinct strings, with what travels beside each."""
    for batch in tx.text_slices(batches, "text", SLICE_BYTES):
        runs = _Runs(batch, k, m, np.zeros(0, np.uint64))
        if not len(runs.start):
            continue
        _, first = np.unique(runs.content, return_index=True)
        size = runs.words.end[runs.stop[first] + k - 2] - runs.words.start[runs.start[first]] + 40
        keys, at = np.unique(runs.key[first], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.bincount(at, size).astype(np.int64))], ["key", "n"])


def _plan(docs: DataFrame, k: int, m: int, partitions: int) -> tuple[np.ndarray, int, int]:
    """The hot minimisers, the number of partitions, and of buckets in each."""
    weights = docs.mapInArrow(lambda it: tx.lean(_weights(it, k, m)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # light minimisers are summed up by 64 numbers, so that one pass gives the total, too
    light = F.col("n") <= HOT_BYTES
    weights = weights.groupBy(light.alias("light"), F.when(light, F.pmod("key", F.lit(64))).otherwise(F.col("key")).alias("key")).agg(F.sum("n").alias("n"))
    weights = stored(weights, "minimiser-weights")
    total = weights.agg(F.sum("n")).first()[0] or 0
    partitions = max(partitions, min(MOST_PARTITIONS, -(-total // BUCKET_BYTES)))
    buckets = max(1, -(-total // (partitions * BUCKET_BYTES)))
    least = max(HOT_BYTES, total // HOT_KEYS)
    hot = weights.where((~F.col("light")) & (F.col("n") > least)).select("key").toArrow().column("key").to_numpy()
    return np.sort(hot.astype(np.int64).astype(np.uint64)), partitions, buckets


def _send(batches: Iterator[pa.RecordBatch], k: int, m: int, partitions: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed strings by bucket, and the repeats that a slice shows by itself."""
    for batch in tx.text_slices(batches, "text", SLICE_BYTES):
        runs = _Runs(batch, k, m, hot)
        if not len(runs.start):
            continue
        words = runs.words
        text, begin, end = words.joined()
        texts = batch.column("text")
        crc = np.array([zlib.crc32(x.as_buffer()) if x.is_valid else 0 for x in texts], np.uint32)
        ids = batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        doc, start = ids[runs.row], (runs.start - words.first[runs.row]).astype(np.int32)
        number = (runs.stop - runs.start).astype(np.int32)
        at, size = begin[runs.start], end[runs.stop + k - 2] - begin[runs.start]

        # equal strings: the first by (doc, start) stays
        order = np.lexsort((start, doc, runs.content))
        same = np.zeros(len(order), bool)
        same[1:] = runs.content[order][1:] == runs.content[order][:-1]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        rows, heads = order[same], order[head[same]]
        equal = (size[rows] == size[heads]) & (number[rows] == number[heads])
        equal[equal] = tx.same_bytes(text, at[rows[equal]], at[heads[equal]], size[rows[equal]])
        rows, heads = rows[equal], heads[equal]
        later = (doc[rows] > doc[heads]) | (start[rows] > start[heads])
        sent = np.ones(len(order), bool)
        # a row with the same id and start as the first but another text must be judged by itself
        drop = later | (crc[runs.row[rows]] == crc[runs.row[heads]])
        sent[rows[drop]] = False
        again = rows[later]
        out_part, out_blob = [], []
        if len(again):
            spread = int(doc[again[0]]) % partitions
            columns = {"doc": doc[again], "crc": crc[runs.row[again]], "start": start[again], "words": number[again], "size": np.zeros(len(again)), "sub": np.zeros(len(again))}
            out_part.append((spread, -1))
            out_blob.append(_pack(columns, np.zeros(0, np.uint8)))

        chosen = np.flatnonzero(sent)
        key = runs.key[chosen]
        part = (key >> np.uint64(20)) % np.uint64(partitions)
        bucket = (tx.mix(key, 31) >> np.uint64(32)) % np.uint64(buckets)
        sub = (key & np.uint64(0xFFFF)).astype(np.uint16)
        order = np.lexsort((sub, bucket, part))
        chosen, part, bucket, sub = chosen[order], part[order], bucket[order], sub[order]
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])
        cuts = np.append(np.flatnonzero(new), len(part))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            pick = chosen[lo:hi]
            packed, _ = tx.gather(text, at[pick], size[pick])
            columns = {"doc": doc[pick], "crc": crc[runs.row[pick]], "start": start[pick], "words": number[pick] + k - 1, "size": size[pick], "sub": sub[lo:hi]}
            out_part.append((int(part[lo]), int(bucket[lo])))
            out_blob.append(_pack(columns, packed))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in out_part], pa.int32()), pa.array([b for _, b in out_part], pa.int32()), pa.array(out_blob, pa.binary())], ["part", "bucket", "blob"]
        )


def _rows(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    ids = pa.array(doc, pa.int64(), mask=doc == _NULL_ID)
    return pa.RecordBatch.from_arrays([ids, pa.array(crc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "crc", "start", "n"])


def _judge(columns: dict[str, np.ndarray], text: np.ndarray, k: int) -> pa.RecordBatch | None:
    """Sort the windows of packed strings; report all but the first of each kind, as runs."""
    off = np.concatenate([[0], np.cumsum(columns["size"], dtype=np.int64)])
    order = np.lexsort((columns["start"], columns["doc"]))
    doc, crc, start = columns["doc"][order], columns["crc"][order], columns["start"][order]
    text, off = tx.gather(text, off[order], columns["size"][order].astype(np.int64))
    words = tx.Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(text)]))
    number = words.count - k + 1  # windows of each string
    string = np.repeat(np.arange(len(number)), number)
    within = np.arange(len(string)) - np.repeat(np.cumsum(number) - number, number)
    at = words.first[:-1][string] + within  # the first word of each window
    low, high = words.start[at], words.end[at + k - 1]
    hashes = tx.span_hashes(words.hashes(1), at, at + k, 1)
    order = np.argsort(hashes, kind="stable")  # in a kind, by (doc, start)
    same = np.zeros(len(order), bool)
    same[1:] = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return None
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    place = start[string] + within
    repeat = (doc[string] > doc[string[head]]) | ((doc[string] == doc[string[head]]) & (place > place[head]))
    rows = np.flatnonzero(repeat)
    if not len(rows):
        return None
    heads = head[rows]
    # runs of windows that repeat runs of windows: one comparison of bytes each
    joint = np.zeros(len(rows), bool)
    joint[1:] = (rows[1:] == rows[:-1] + 1) & (heads[1:] == heads[:-1] + 1) & (string[rows[1:]] == string[rows[:-1]]) & (string[heads[1:]] == string[heads[:-1]])
    first = np.flatnonzero(~joint)
    last = np.append(first[1:], len(rows)) - 1
    size, other = high[rows[last]] - low[rows[first]], high[heads[last]] - low[heads[first]]
    good = size == other
    good[good] = tx.same_bytes(text, low[rows[first[good]]], low[heads[first[good]]], size[good])
    if not good.all():  # two kinds share a hash: tell windows apart by their bytes
        seen: dict[bytes, int] = {}
        verdict = np.zeros(len(string), bool)
        for i in range(len(string)):
            j = seen.setdefault(text[low[i] : high[i]].tobytes(), i)
            verdict[i] = (doc[string[i]], place[i]) > (doc[string[j]], place[j])
        rows = np.flatnonzero(verdict)
    if not len(rows):
        return None
    joint = np.zeros(len(rows), bool)
    joint[1:] = (rows[1:] == rows[:-1] + 1) & (string[rows[1:]] == string[rows[:-1]])
    first = np.flatnonzero(~joint)
    n = np.diff(np.append(first, len(rows)))
    return _rows(doc[string[rows[first]]], crc[string[rows[first]]], place[rows[first]], n)


def _judge_bucket(blobs: list[bytes], k: int) -> Iterator[pa.RecordBatch]:
    """Judge one bucket, in parts of bounded size if it is larger than planned."""
    total = sum(zstandard.frame_content_size(b) for b in blobs)
    parts = min(1 << 16, -(-total // PART_BYTES))  # a sub number each at most; more than one of it is hot
    for p in range(parts):
        lo, hi = -(-(p << 16) // parts), -(-((p + 1) << 16) // parts)
        pieces, texts = [], []
        for blob in blobs:
            c, text = _unpack(blob)
            a, b = np.searchsorted(c["sub"].astype(np.int64), [lo, hi])
            if a < b:
                off = np.concatenate([[0], np.cumsum(c["size"], dtype=np.int64)])
                pieces.append({name: c[name][a:b].copy() for name, _ in _FIELDS})
                texts.append(text[off[a] : off[b]].copy())
        if pieces:
            out = _judge({name: np.concatenate([x[name] for x in pieces]) for name, _ in _FIELDS}, np.concatenate(texts), k)
            if out is not None:
                yield out


def _receive(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Judge the buckets of this task, which come one after another."""
    blobs: list[bytes] = []
    now = -1
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if bucket < 0:
                c, _ = _unpack(blob.as_py())
                yield _rows(c["doc"], c["crc"], c["start"], c["words"])
                continue
            if bucket != now:
                yield from _judge_bucket(blobs, k)
                blobs, now = [], bucket
            blobs.append(blob.as_py())
    yield from _judge_bucket(blobs, k)


def repeated_windows(docs: DataFrame, k: int = 20, m: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every window that starts earlier elsewhere, as runs ``(doc_id, crc, start, n)``.

    ``n`` consecutive windows from word ``start`` (0-based) are repeats; ``crc`` is the
    CRC-32 of the text, which tells rows that share an id apart.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot, partitions, buckets = _plan(slim, k, m, partitions)
    sent = slim.mapInArrow(lambda it: tx.lean(_send(it, k, m, partitions, buckets, hot)), "part int, bucket int, blob binary")
    dealt = sent.repartitionById(partitions, F.col("part"))
    if buckets > 1:
        dealt = dealt.sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda it: tx.lean(_receive(it, k)), _REPEATS)


def _cut(batches: Iterator[pa.RecordBatch], k: int, column: str) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, column, SLICE_BYTES):
        kept, n_words, n_removed = [], [], []
        for text, ranges in zip(batch.column(column), batch.column("ranges"), strict=True):
            raw = text.as_py()
            words = raw.encode().split() if raw is not None else []
            n_words.append(len(words))
            if ranges.is_valid and len(ranges):
                start, n = (ranges.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n"))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n + k - 1, -1)
                stay = np.cumsum(edge[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        extra = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        rest = [batch.column(name) for name in batch.schema.names if name != "ranges"]
        names = [name for name in batch.schema.names if name != "ranges"]
        yield pa.RecordBatch.from_arrays([*rest, *extra], [*names, "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, k: int = 20, m: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``, the kept words joined by one space."""
    added = ("n_words", "n_removed", "kept_text", "ranges")
    docs = docs.drop(*added)
    ranges = stored(repeated_windows(docs, k, m, id_col, text_col), "repeated-windows")
    by_doc = ranges.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), "ranges")
    crc: Column = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.crc32(F.col(text_col).cast("binary")))
    joined = docs.join(by_doc, (F.col(id_col).cast("long").eqNullSafe(F.col("_id"))) & (crc == F.col("_crc")), "left").drop("_id", "_crc")
    schema = tx.schema_with(docs, "n_words long, n_removed long, kept_text string")
    return joined.mapInArrow(lambda it: tx.lean(_cut(it, k, text_col)), schema)
