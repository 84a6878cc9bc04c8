"""Repetition inside a document, from suffix arrays over words.

All documents of a slice of input form one sequence of word numbers.  Each document
has numbers of its own for its words and one for its end, so that no repeat reaches
across documents.  The
suffix array is built by prefix doubling: only suffixes that are not yet alone in
their group are sorted again, and every level's ranks are kept.  The common prefix
of neighbours in the array follows from these ranks, longest level first.

An interval of the array whose neighbours share at least ``v`` words, bounded by
smaller values, is a right-maximal repeat of length ``v``; it is maximal if the
words before its members differ, too.  A maximal repeat's spans are its length from
each member's start.  Intervals are nested, so the longest span that starts at a
suffix is that of the innermost interval around its place; the union of these is the
union of all spans.  Covered words, the covered share of characters, the longest
repeat and the number of maximal repeats all come from the intervals.

Words are told apart by 64-bit hashes of their bytes.

Defined cases.  A null text has no words, like a blank one: it fails the base rule.
A text is judged by itself and whole, however long, so repeated rows get equal
results and ties cannot arise.  An empty table gives an empty one.  Columns named
like the added ones are replaced; others, nulls in them included, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

SLICE_BYTES = 2 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_maximal_repeats", "repeat_chars", "longest_repeat")


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of a sequence, and the rank of every suffix by its first 2^l symbols.

    The last symbol, and enough others that no repeat reaches the end, must be unique.
    """
    order = np.argsort(symbols, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = symbols[order][1:] != symbols[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    levels, h = [rank.astype(np.int32)], 1
    alone = new & np.append(new[1:], True)
    left = order[~alone]
    while len(left):
        key = (rank[left] << 32) | rank[left + h]
        by = np.argsort(key, kind="stable")
        left, key = left[by], key[by]
        old = key >> 32
        head = np.ones(len(left), bool)
        head[1:] = old[1:] != old[:-1]
        new = np.ones(len(left), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.arange(len(left))
        group = np.maximum.accumulate(np.where(head, at, 0))
        rank = rank.copy()
        rank[left] = old + np.maximum.accumulate(np.where(new, at, 0)) - group
        levels.append(rank.astype(np.int32))
        left = left[~(new & np.append(new[1:], True))]
        h *= 2
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """For each place r > 0 of the array the words shared with place r - 1; 0 if fewer than ``least``."""
    low = min(least.bit_length() - 1, len(levels) - 1)
    first = levels[low][order]
    some = np.flatnonzero(first[1:] == first[:-1]) + 1
    i, j = order[some - 1], order[some]
    shared = np.zeros(len(some), np.int64)
    for l in range(len(levels) - 1, -1, -1):
        equal = levels[l][i + shared] == levels[l][j + shared]
        shared[equal] += 1 << l
    out = np.zeros(len(order), np.int64)
    out[some] = np.where(shared >= least, shared, 0)
    return out


def lcp_intervals(lcp: np.ndarray, order: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal repeats as ``(length, first place, last place)`` of the suffix array.

    ``before`` is the symbol in front of each suffix.  Places whose prefix is 0 close
    all intervals, so only the runs between them are scanned.
    """
    differ = np.zeros(len(order) + 1, np.int64)
    differ[2:] = np.cumsum(before[order][1:] != before[order][:-1])
    some = np.flatnonzero(lcp)
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (length, first place)
    previous = -2
    for place, value in [*zip(some.tolist(), lcp[some].tolist(), strict=True), (len(order) + 1, 0)]:
        if place != previous + 1 and stack:
            for length, first in stack:
                if differ[previous + 1] > differ[first + 1]:
                    out.append((length, first, previous))
            stack = []
        if value:
            first = place - 1
            while stack and stack[-1][0] > value:
                length, first = stack.pop()
                if differ[place] > differ[first + 1]:
                    out.append((length, first, place - 1))
            if not stack or stack[-1][0] < value:
                stack.append((value, first))
        previous = place
    return out


def longest_spans(found: list[tuple[int, int, int]], places: int) -> np.ndarray:
    """For every place of the array the length of the innermost interval around it; 0 if none is."""
    out = np.zeros(places, np.int64)
    events = sorted([(first, 1, -last, length) for length, first, last in found] + [(last + 1, 0, 0, 0) for _, _, last in found])
    stack: list[int] = []
    before = 0
    for at, opens, _, length in events:
        if stack and at > before:
            out[before:at] = stack[-1]
        before = at
        if opens:
            stack.append(length)
        else:
            stack.pop()
    return out


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def features(texts: pa.Array, window: int, min_words: int) -> dict[str, np.ndarray]:
    """The counts of every text of a column, as arrays."""
    words = tx.Words(texts)
    rows, n = len(texts), len(words)
    lead = (words.buf & 0xC0) != 0x80
    inside = lead & ~tx.SPACES[words.buf]
    chars = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    out = {"n_words": words.count.astype(np.int64), "word_chars": _per_row(inside, words.off), "n_symbols": _per_row(SYMBOLS[words.buf], words.off)}
    out["n_dup_lines"] = np.fromiter((_dup_lines(t) for t in texts.to_pylist()), np.int64, rows)
    # word numbers, and one end of its own after each document
    row = words.row()
    place = np.arange(n) + row
    symbols = np.empty(n + rows, np.uint64)
    own = tx.mix(words.hashes() ^ tx.mix(row.astype(np.uint64), 3))  # a word of one document is none of another's
    _, number = np.unique(own, return_inverse=True)
    symbols[place] = number
    ends = words.first[1:] + np.arange(rows)
    symbols[ends] = n + np.arange(rows)
    order, levels = suffix_ranks(symbols)
    lcp = common_prefixes(order, levels, min(window, min_words))
    before = np.empty(len(symbols), np.uint64)
    before[1:] = symbols[:-1]
    before[0] = n + rows
    found = lcp_intervals(lcp, order, before)
    by_place = np.empty(len(order), np.int64)
    by_place[order] = longest_spans(found, len(order))
    reach = by_place[place]  # words of the longest maximal repeat that starts at each word
    covered = {}
    for least in {window, min_words}:
        edge = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(reach >= least)
        edge[at] = 1
        edge -= np.bincount(at + reach[at], minlength=n + 1)
        covered[least] = np.cumsum(edge[:-1]) > 0 if n else np.zeros(0, bool)
    out["n_repeat_words"] = _per_row(covered[window], words.first)
    size = chars[words.end] - chars[words.start]
    out["repeat_chars"] = _per_row(np.where(covered[min_words], size, 0), words.first)
    of_row = np.repeat(np.arange(rows), words.count + 1)
    size, first = (np.fromiter((f[i] for f in found if f[0] >= min_words), np.int64) for i in (0, 1))
    of = of_row[order[first]]
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, of, size)
    out["longest_repeat"] = top
    out["n_maximal_repeats"] = np.bincount(of, minlength=rows)
    return out


def _add(batches: Iterator[pa.RecordBatch], column: str, window: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, column, SLICE_BYTES):
        found = features(batch.column(column), window, min_words)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[f], pa.int64()) for f in _FEATURES)], [*batch.schema.names, *_FEATURES])


def repetition_rules(
    docs: DataFrame, window: int = 5, min_words: int = 8, max_covered: float = 0.25, max_repeat: int = 60, min_doc_words: int = 10, text_col: str = "text"
) -> DataFrame:
    """``docs`` with the counts, ``covered_fraction``, ``base_failed`` and ``kept``.

    The base rule fails a text of fewer than ``min_doc_words`` words, or with over a
    fifth of its words in repeated windows of ``window`` words.  The suffix-array rule
    fails it if maximal repeats of ``min_words`` words or more cover over
    ``max_covered`` of its word characters, or if one is longer than ``max_repeat``
    words.
    """
    docs = docs.drop(*_FEATURES, "covered_fraction", "base_failed", "kept")
    schema = tx.schema_with(docs, ", ".join(f"{name} long" for name in _FEATURES))
    counted = docs.mapInArrow(lambda it: tx.lean(_add(it, text_col, window, min_words)), schema)
    failed = (F.col("n_words") < min_doc_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = F.when(F.col("word_chars") > 0, F.col("repeat_chars") / F.col("word_chars")).otherwise(F.lit(0.0))
    out = counted.withColumn("covered_fraction", share).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("covered_fraction") <= max_covered) & (F.col("longest_repeat") <= max_repeat))
