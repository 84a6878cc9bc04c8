"""SentencePiece encoding by a forward pass shared along a trie of words, and decoding.

Texts are cut into marked words, the runs between which no piece can reach: the
space marks in front of a word and the word.  The distinct marked words of a slice
are sorted, which is their trie in depth-first order: the forward states of a word
and its successor agree up to their common prefix and are kept on a stack, so each
trie node is computed once.

The state of a prefix is the best score over its segmentations and the last piece of
the best one (Viterbi).  A segmentation's score is the sum of its pieces' scores and
of a transition for every two neighbouring pieces.  In a unigram model transitions
are 0.  A BPE model isn't maximising a sum of scores, but its segmentation is the one
in which every two neighbouring pieces, encoded alone, stay apart: transitions are 0
between such pieces and minus infinity between others, so the one segmentation with
a finite score is best.  The ids agree with the sentencepiece library's in both cases.

Words with several marks and marks without a word are merged pair by pair instead,
from a heap, as the pieces of several marks have equal scores and their order is by
position.

Defined cases.  A null or empty text has no ids.  Characters without a piece become
byte pieces (without byte fallback: the unknown id).  Decoding gives the text back
but for the mark itself, U+2581, which comes back as a space as in the library.
Repeated rows get equal ids; ties between segmentations go to the longer last piece.
A text, word or run of spaces of any length is encoded whole, in time that grows with
its length (by a logarithm more for runs of marks).  An empty table gives an empty
one.  Columns named like the added ones are replaced, others pass through.
The model must leave text as it is: identity normalisation, a dummy prefix and no
removal of white space, or ``load`` raises ValueError.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .wordcache import WordCache

SLICE_BYTES = 2 << 20
MARK = "▁"
_UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_NORMAL, _UNKNOWN, _BYTE, _UNIGRAM, _BPE = 1, 2, 6, 1, 2


@dataclass
class Model:
    """What encoding needs of a model file."""

    bpe: bool
    score: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    unknown: int
    pieces: list[bytes]  # by id; control pieces are empty
    longest: int
    apart: dict[tuple[str, str], bool] = field(default_factory=dict)
    whole: dict[str, bool] = field(default_factory=dict)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the best pair, the first of equals, until none is left."""
        parts = list(text)
        if len(parts) > 32:
            return self._merged_long(parts)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_long(self, parts: list[str | None]) -> list[str]:
        """The same from a heap of pairs; a part that was merged into the one before it is None."""
        n, score = len(parts), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int, j: int) -> None:
            s = score.get(parts[i] + parts[j])
            if s is not None:
                heapq.heappush(heap, (-s, i, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, size = heapq.heappop(heap)
            # parts only grow, so an unchanged size means an unchanged pair
            if parts[i] is None or (j := after[i]) == n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def transition(self, left: str, piece: str) -> float:
        """The score of a piece after another (or none): 0, or minus infinity where BPE would not part them there."""
        if not self.bpe:
            return 0.0
        if left and left in self.score:
            return 0.0 if self.stay_apart(left, piece) else -np.inf
        return 0.0 if self.is_whole(piece) else -np.inf

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether the pieces a, b are what their concatenation is merged into."""
        key = (a, b)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 4_000_000:
                self.apart.clear()
            found = self.apart[key] = self.merged(a + b) == [a, b]
        return found

    def is_whole(self, piece: str) -> bool:
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = self.merged(piece) == [piece]
        return found

    def to_ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out


def load(path: str) -> Model:
    """Read a model file of the sentencepiece library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if kind not in (_UNIGRAM, _BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError(f"{path}: only unigram and BPE models that keep the text are supported")
    normal = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
    if any(MARK in p.lstrip(MARK) for p in normal):
        raise ValueError(f"{path}: pieces reach across words")
    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
    bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
    pieces = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() if p.type == _NORMAL else b" \xe2\x81\x87 " if p.type == _UNKNOWN else b"" for p in proto.pieces]
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
    return Model(kind == _BPE, normal, ids, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], unknown, pieces, max(map(len, normal)))


def shared_prefix(words: list[str], model: Model) -> list[list[str]]:
    """The pieces of every word; words ascend, none has a mark but in front."""
    out: list[list[str]] = []
    score, longest = model.score, model.longest
    floor = min(score.values(), default=0.0) - 10.0
    state: list[tuple[float, str]] = [(0.0, "")]  # by prefix length: score, last piece
    before = ""
    for word in words:
        keep = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            keep += 1
        del state[keep + 1 :]
        for end in range(keep + 1, len(word) + 1):
            best, last = -np.inf, ""
            for begin in range(max(0, end - longest), end):
                piece = word[begin:end]
                s = score.get(piece)
                if s is None:
                    if end - begin > 1:
                        continue
                    total = state[begin][0] + floor  # a character without a piece merges with nothing
                else:
                    total = state[begin][0] + s
                    if total > best:
                        total += model.transition(state[begin][1], piece)
                if total > best:
                    best, last = total, piece
                    if model.bpe:  # no other segmentation of the prefix is finite
                        break
            state.append((best, last))
        parts, end = [], len(word)
        while end:
            parts.append(state[end][1])
            end -= len(parts[-1])
        out.append(parts[::-1])
        before = word
    return out


def encode_words(words: list[str], model: Model) -> list[list[int]]:
    """Ids of marked words in any order."""
    order = sorted(range(len(words)), key=words.__getitem__)
    out: list[list[int]] = [[]] * len(words)
    plain = [i for i in order if not words[i].startswith(MARK * 2) and words[i] != MARK]
    for i, parts in zip(plain, shared_prefix([words[i] for i in plain], model), strict=True):
        out[i] = model.to_ids(parts)
    for i in order:
        if words[i].startswith(MARK * 2) or words[i] == MARK:
            out[i] = model.to_ids(model.merged(words[i]) if model.bpe else shared_prefix([words[i]], model)[0])
    return out


_SPLIT = np.zeros(256, bool)
_SPLIT[[0x20, 0x0A]] = True
_models: dict[str, tuple[Model, WordCache]] = {}


def _model(path: str) -> tuple[Model, WordCache]:
    if path not in _models:
        _models.clear()
        model = load(path)
        _models[path] = (model, WordCache(lambda words: encode_words([w.decode() for w in words], model), np.int32))
    return _models[path]


def encode_column(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts after one another, and the offsets of each."""
    model, cache = _model(path)
    words = tx.Words(texts, _SPLIT)
    rows = len(texts)
    # regular: words parted by single spaces or line ends, nothing before or after, no mark in the text
    size = np.diff(words.off)
    length = np.concatenate([[0], np.cumsum(words.end - words.start)])
    inner = length[words.first[1:]] - length[words.first[:-1]]
    regular = (size == inner + np.maximum(words.count - 1, 0)) & (words.count > 0)
    mark = np.flatnonzero(words.buf == 0xE2)
    mark = mark[mark + 2 < len(words.buf)]
    mark = mark[(words.buf[mark + 1] == 0x96) & (words.buf[mark + 2] == 0x81)]
    regular[np.searchsorted(words.off, mark, side="right") - 1] = False
    # a word has a mark in front unless it follows a line end
    space = np.ones(len(words), np.uint8)
    after = np.flatnonzero(words.start > 0)
    space[after] = words.buf[words.start[after] - 1] == 0x20
    space[words.first[:-1][words.count > 0]] = 1

    def marked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lead = np.frombuffer(MARK.encode(), np.uint8)
        extended = np.append(words.buf, lead)
        n = words.end[rows] - words.start[rows]
        front = np.where(space[rows] == 1, 3, 0)
        start = np.stack([np.full(len(rows), len(words.buf)), words.start[rows]], 1).reshape(-1)
        out, off = tx.gather(extended, start, np.stack([front, n], 1).reshape(-1))
        return out, off[:-1:2], off[2::2]

    flat, per_word = cache.lookup(words, space, marked)
    # a line end in front of a word is an id of its own
    lines = np.flatnonzero(space == 0)
    upto = np.concatenate([[0], np.cumsum(per_word)])
    newline = model.to_ids(["\n"])
    flat = np.insert(flat, np.repeat(upto[lines], len(newline)), np.tile(newline, len(lines)))
    per_word = per_word.copy()
    per_word[lines] += len(newline)
    upto = np.concatenate([[0], np.cumsum(per_word)])[words.first]
    if regular.all():
        return flat, upto
    ids, sizes = [], np.diff(upto)
    for row in range(rows):
        if regular[row]:
            ids.append(flat[upto[row] : upto[row + 1]])
        else:
            text = texts[row].as_py()
            units = _UNIT.findall((MARK + text.replace(" ", MARK))) if text else []
            ids.append(np.array([i for unit in encode_words(units, model) for i in unit], np.int32))
            sizes[row] = len(ids[-1])
    return np.concatenate(ids) if ids else flat, np.concatenate([[0], np.cumsum(sizes)])


def decode_column(ids: np.ndarray, off: np.ndarray, path: str) -> list[str]:
    """The texts of id sequences."""
    model, _ = _model(path)
    size = np.fromiter(map(len, model.pieces), np.int64, len(model.pieces))
    start = np.cumsum(size) - size
    out, at = tx.gather(np.frombuffer(b"".join(model.pieces), np.uint8), start[ids], size[ids])
    raw, at = out.tobytes(), at[off].tolist()
    return [raw[a + (raw[a : a + 1] == b" ") : b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _encode(batches: Iterator[pa.RecordBatch], column: str, path: str) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, column, SLICE_BYTES):
        ids, off = encode_column(batch.column(column), path)
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])


def _decode(batches: Iterator[pa.RecordBatch], column: str, path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(column)
        lists = lists.fill_null([]) if lists.null_count else lists
        ids, off = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decode_column(ids, off, path), pa.string())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, an array of int."""
    docs = docs.drop("ids")
    return docs.mapInArrow(lambda it: tx.lean(_encode(it, text_col, model_path)), tx.schema_with(docs, "ids array<int>"))


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of its ids."""
    tokens = tokens.drop("decoded")
    return tokens.mapInArrow(lambda it: tx.lean(_decode(it, ids_col, model_path)), tx.schema_with(tokens, "decoded string"))


def _summary(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, "text", SLICE_BYTES):
        ids, off = encode_column(batch.column("text"), path)
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        texts = decode_column(ids, off, path)
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(off), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "decoded": pa.array(texts, pa.string()), "text": batch.column("text")}
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_pydict(columns)


def encode_and_decode(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip)`` of every document, and ``ids`` if asked.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers;
    ``round_trip`` is true where the ids decode to the text (a null text to "").
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded string, text string" + ", ids array<int>" * with_ids
    done = slim.mapInArrow(lambda it: tx.lean(_summary(it, model_path, with_ids)), schema)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    out = ["doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip")]
    return done.select(*out, *["ids"] * with_ids)
