"""Word and hash primitives over whole Arrow text columns.

All functions work on the flat UTF-8 buffer of a column with NumPy, so no Python
object is made per word.  Hashes choose buckets and candidates; operators that
promise exact results compare bytes where hashes agree.
"""

from __future__ import annotations

import contextlib
import ctypes
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

U64 = np.uint64
#: Random odd multipliers.
_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}
_SEGMENT = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: True for the separators space, \t, \n, \v, \f, \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Maps A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: The rest of a tag after its name, as a group: quotes count only where a value starts, and nothing is scanned twice.
TAG_REST = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?|'[^']*+'?|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)"
_DIGITS = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")


def unescape(text: str) -> str:
    """``html.unescape``, which refuses numbers of thousands of digits: they are no character."""
    if "&" not in text:
        return text
    try:
        return html.unescape(text)
    except ValueError:
        return html.unescape(_DIGITS.sub("\ufffd", text))


def _powers_to(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, _SEGMENT + (1 << 16))
        base = _BASE[which]
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            out = np.full(size, b, U64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            both.append(out)
        have = _powers[which] = (both[0], both[1])
    return have


def schema_with(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` with the columns of a DDL string after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others spread over all bits."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass batches on; at the end, give memory that a waiting worker would keep back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``max_bytes`` of text; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            upto = (total[at - 1] if at else 0) + max_bytes
            end = max(at + 1, int(np.searchsorted(total, upto, side="right")))
            yield batch.slice(at, end - at)
            at = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text or binary column and its n + 1 offsets; a null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    lo, hi = int(off[0]), int(off[-1])
    buf = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return buf, off - lo


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all slices after one another, and the offsets of each."""
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    index = np.repeat(start - off[:-1], size)
    index += np.arange(off[-1])
    return buf[index], off


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each i, whether buf[a:a+size] equals buf[b:b+size]."""
    out = np.ones(len(a), bool)
    some = np.flatnonzero(size > 0)
    at = 0
    while at < len(some):  # blocks of bounded size
        total = np.cumsum(size[some[at:]])
        upto = at + max(1, int(np.searchsorted(total, 8 << 20, side="right")))
        rows = some[at:upto]
        x, off = gather(buf, a[rows], size[rows])
        y, _ = gather(buf, b[rows], size[rows])
        out[rows] = np.logical_and.reduceat(x == y, off[:-1])
        at = upto
    return out


class Words:
    """The words of a text column: byte ranges, counts and hashes.

    ``first[d]`` to ``first[d + 1]`` are the words of row d; ``start`` and ``end`` are
    byte positions in ``buf``.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACES, fold: np.ndarray | None = None):
        buf, off = flat(texts)
        self.buf = buf if fold is None else fold[buf]
        self.off = off
        n = len(buf)
        word = ~separators[buf]
        opens, closes = word.copy(), word.copy()
        if n:
            opens[1:] &= ~word[:-1]
            closes[:-1] &= ~word[1:]
            edge = off[:-1][off[:-1] < n]
            opens[edge] = word[edge]
            edge = off[1:][off[1:] > 0] - 1
            closes[edge] = word[edge]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        return slice_hashes(self.buf, self.start, self.end, which)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one space after each: bytes, starts and ends."""
        size = self.end - self.start + 1
        if not len(size):
            return np.zeros(0, np.uint8), self.start, self.end
        out, off = gather(np.append(self.buf, np.uint8(0x20)), self.start, size)
        out[off[1:] - 1] = 0x20
        return out, off[:-1], off[1:] - 1


def slice_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice buf[start:end]; slices ascend and don't overlap."""
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        base = int(start[at])
        upto = max(at + 1, int(np.searchsorted(end, base + _SEGMENT, side="right")))
        piece = buf[base : int(end[upto - 1])]
        power, inverse = _powers_to(len(piece) + 1, which)
        total = np.zeros(len(piece) + 1, U64)
        np.cumsum((piece.astype(U64) + U64(1)) * power[: len(piece)], out=total[1:])
        s, e = start[at:upto] - base, end[at:upto] - base
        out[at:upto] = (total[e] - total[s]) * inverse[s]
        at = upto
    return mix(out, which)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run values[start:end] of 64-bit hashes."""
    power, inverse = _powers_to(len(values) + 1, which)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64), which)


def window_hashes(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """The hash of every k consecutive values: len(values) - k + 1 of them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    at = np.arange(n)
    return span_hashes(values, at, at + k, which)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    have, out = 1, values
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]


def text_array(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """A large_string column over the given bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))
