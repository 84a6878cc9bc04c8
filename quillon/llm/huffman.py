"""Token ids as files: canonical length-limited Huffman coding in independent blocks.

Files.  A folder with two Parquet tables.  ``codebook`` has ``(id, bits)``, from
which the canonical code follows: codes count up in the order of (bits, id).
``blocks`` has one row per block, in ascending order of document: the documents'
ids and token counts, the number of tokens before the block, the coded bits, and
the bit offset of every ``STEP``-th token.  A block needs nothing but the codebook,
and its checkpoints let a reader start at any of them.

Writing.  Documents are dealt by ranges of their id and tokenised into blocks,
which are stored.  Counts of ids over all blocks (at most one per id of the
vocabulary) give the code lengths by package-merge, the optimum under the length
limit.  A second pass codes the stored blocks.

Reading.  Lanes start at all checkpoints of a block at once; each step looks the
next ``limit`` bits of every lane up in one table of (id, bits).

Defined cases.  A null text is empty; every document ends with ``end_id``, so an
empty one has one token.  A null id sorts first.  Rows that share an id follow one
another, ordered by text, each with its own row.  An empty table gives empty files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, scratch, stored
from . import textops as tx
from .wordcache import WordCache

SLICE_BYTES = 2 << 20
#: A document starts no new block while its block has fewer tokens.
BLOCK_TOKENS = 1 << 19
STEP = 512
LIMIT = 18
_BLOCK = "part int, seq int, within long, doc_ids array<long>, sizes array<int>, n long, ids binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    below = np.zeros(0, np.int64)  # packages from the level below
    levels = []
    for _ in range(limit):
        weight = np.concatenate([leaves, below])
        by = np.argsort(weight, kind="stable")
        weight = weight[by]
        levels.append(by >= n)  # which items are packages
        even = len(weight) // 2 * 2
        below = weight[0:even:2] + weight[1:even:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for packages in reversed(levels):
        inside = int(packages[:take].sum())
        lengths[: take - inside] += 1
        take = 2 * inside
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by id, as arrays over 0 to the largest id."""
    code, length = np.zeros(int(ids.max()) + 1, np.uint64), np.zeros(int(ids.max()) + 1, np.uint64)
    order = np.lexsort((ids, bits))
    value, before = 0, 0
    for i, b in zip(ids[order].tolist(), bits[order].tolist(), strict=True):
        value <<= b - before
        code[i], length[i] = value, b
        value, before = value + 1, b
    return code, length


def decode_table(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``top`` bits: the id they start with and its bits."""
    top = int(bits.max())
    order = np.lexsort((ids, bits))
    spread = 1 << (top - bits[order])
    table, length = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    table[: spread.sum()] = np.repeat(ids[order].astype(np.uint32), spread)
    length[: spread.sum()] = np.repeat(bits[order].astype(np.uint8), spread)
    return table, length, top


def encode_bits(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, most significant first, and the offset of every STEP-th id."""
    size = length[ids]
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(ids) else 0
    lanes = np.zeros(total // 64 + 2, np.uint64)
    if total:
        value, word, offset = code[ids], (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
        over = (offset + size).astype(np.int64) - 64  # bits that belong to the next word
        shifted = np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64))
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        lanes[word[heads]] = np.add.reduceat(shifted, heads)
        cross = np.flatnonzero(over > 0)
        lanes[word[cross] + 1] |= value[cross] << (64 - over[cross]).astype(np.uint64)
    return lanes.astype(">u8").tobytes()[: (total + 7) // 8], start[::STEP].astype(np.uint32)


def decode_bits(payload: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, length: np.ndarray, top: int) -> np.ndarray:
    """The n ids of a block: all checkpoints advance together."""
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = checkpoints.astype(np.int64)
    last = len(window) - 1
    out = np.empty((STEP, len(at)), np.uint32)
    down = np.uint32(32 - top)
    for step in range(min(STEP, n)):
        peek = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> down
        out[step] = table[peek]
        at += length[peek]
    return out.T.reshape(-1)[:n]


def hf_words(path: str) -> Callable[[list[bytes]], list[list[int]]]:
    """Encode words with a file of the tokenizers library. White space must not matter to it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(words), 20_000):
            out += [e.ids for e in tokenizer.encode_batch([w.decode() for w in words[at : at + 20_000]], add_special_tokens=False)]
        return out

    return encode


_caches: dict[str, WordCache] = {}


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _caches:
        _caches.clear()
        _caches[path] = WordCache(hf_words(path))
    cache, part, seq = _caches[path], TaskContext.get().partitionId(), 0
    within = 0  # tokens of this part before the block
    docs: list = []
    sizes: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        size = np.concatenate(sizes)
        columns = [[part], [seq], [within], [docs], [size], [int(size.sum())], [np.concatenate(ids).tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "seq", "within", "doc_ids", "sizes", "n", "ids"])

    for batch in tx.text_slices(batches, "text", SLICE_BYTES):
        words = tx.Words(batch.column("text"))
        flat, per_word = cache.lookup(words)
        upto = np.concatenate([[0], np.cumsum(per_word)])[words.first]  # ids before each document
        out = np.insert(flat, upto[1:], end_id)
        size = np.diff(upto) + 1
        docs += batch.column("doc_id").to_pylist()
        sizes.append(size.astype(np.int32))
        ids.append(out)
        if sum(map(len, ids)) >= BLOCK_TOKENS:
            yield block()
            seq, within = seq + 1, within + sum(map(len, ids))
            docs, sizes, ids = [], [], []
    if docs:
        yield block()


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for raw in batch.column("ids"):
            total += np.bincount(np.frombuffer(raw.as_buffer(), np.uint16), minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])


def _encode(batches: Iterator[pa.RecordBatch], ids: np.ndarray, bits: np.ndarray, before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    if not len(ids):
        return
    code, length = canonical(ids, bits)
    same = ["part", "seq", "doc_ids", "sizes", "n"]
    for batch in batches:
        coded = [encode_bits(np.frombuffer(raw.as_buffer(), np.uint16), code, length) for raw in batch.column("ids")]
        start = [before[p] + w for p, w in zip(batch.column("part").to_pylist(), batch.column("within").to_pylist(), strict=True)]
        extra = [pa.array(start, pa.int64()), pa.array([c[1] for c in coded], pa.list_(pa.int64())), pa.array([c[0] for c in coded], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in same), *extra], [*same, "start", "checkpoints", "payload"])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise ``docs`` and write the two tables of the format below ``path``."""
    with scratch():
        spark = docs.sparkSession
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        tie = F.xxhash64("text")
        dealt = slim.repartitionByRange(partitions, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
        blocks = stored(dealt.mapInArrow(lambda it: tx.lean(_tokenise(it, tokenizer, end_id)), _BLOCK), "token-blocks")

        counts = blocks.select("ids").mapInArrow(_histogram, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
        ids = np.array([r["id"] for r in counts], np.int64)
        bits = code_lengths(np.array([r["n"] for r in counts], np.int64))
        book = pa.table({"id": pa.array(ids, pa.int32()), "bits": pa.array(bits, pa.int32())})
        spark.createDataFrame(book).coalesce(1).write.parquet(f"{path}/codebook")

        # tokens before each part: a number per partition
        before, total = {}, 0
        for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
            before[r["part"]] = total
            total += r["n"]
        coded = blocks.mapInArrow(lambda it: tx.lean(_encode(it, ids, bits, before)), "part int, seq int, doc_ids array<long>, sizes array<int>, n long, start long, checkpoints array<long>, payload binary")
        coded.write.parquet(f"{path}/blocks")


def _decode(batches: Iterator[pa.RecordBatch], ids: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(ids):
        return
    table, length, top = decode_table(ids, bits)
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, sizes, checkpoints = (batch.column(c)[row].values for c in ("doc_ids", "sizes", "checkpoints"))
            n = batch.column("n")[row].as_py()
            out = decode_bits(batch.column("payload")[row].as_py(), checkpoints.to_numpy(zero_copy_only=False), n, table, length, top)
            size = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(size)])
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off * 4), pa.py_buffer(out.astype("<u4"))])
            start = batch.column("start")[row].as_py() + off[:-1]
            crc = [zlib.crc32(x.as_buffer()) for x in raw]
            yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), raw.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)``; ``ids`` are little-endian unsigned 32-bit integers."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # a row per id of the vocabulary at most
    ids, bits = np.array([r["id"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    blocks = spark.read.parquet(f"{path}/blocks")
    if with_ids:
        return blocks.mapInArrow(lambda it: tx.lean(_decode(it, ids, bits)), schema)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return blocks.mapInArrow(lambda it: tx.lean(b.select(names) for b in _decode(it, ids, bits)), schema.rpartition(",")[0])


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path, with_ids=False)
