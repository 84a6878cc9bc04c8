"""Folds over the ordered records of a key: rate limits and expiring answers.

Records are dealt by key, sorted by (key, time, id) on disk if need be, and streamed
through one pass with the state of a single key in memory.  A key with many
records costs its task time, not memory: its state after a record depends on all
records before it, so one key can't be split.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import well_formed


#: What a lookup found: no such code, a valid one, no answer, or a text that is no code.
INVALID, VALID, UNAVAILABLE, ILL_FORMED = range(4)
_FOLDED = "id long, k string, flag boolean"


def _fold(batches: Iterator[pa.RecordBatch], start: Callable, step: Callable, extra: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    key, state = object(), None
    for batch in batches:
        flags = np.empty(batch.num_rows, bool)
        more = np.zeros((len(extra), batch.num_rows), np.int64)
        for i, (k, t, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "t", "kind")), strict=True)):
            if k != key:
                key, state = k, start(t)
            flags[i], state, *rest = step(state, t, kind)
            if extra:
                more[:, i] = rest
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), pa.array(flags), *map(pa.array, more)], ["id", "k", "flag", *extra])


def _ordered_fold(rows: DataFrame, start: Callable, step: Callable, extra: tuple[str, ...] = ()) -> DataFrame:
    """``rows(id, k, t, kind)``, t in microseconds, to ``(id, k, flag)`` and the longs ``extra``."""
    dealt = rows.repartition("k").sortWithinPartitions("k", "t", "id")
    return dealt.mapInArrow(lambda it: _fold(it, start, step, extra), ", ".join([_FOLDED, *(f"{name} long" for name in extra)]))


def rate_limit(requests: DataFrame, limit: int, window_us: int, client: str = "client", at: str = "ts", ident: str = "id", headers: bool = False) -> DataFrame:
    """``(id, k, flag)``: whether a token bucket lets each request pass.

    A bucket holds ``limit`` tokens and gains ``limit`` per window.  A token counts as
    ``window_us`` units and every microsecond gains ``limit`` of them, so all numbers
    are integers.  With ``headers`` there are also ``left``, the whole tokens after the
    request, and ``wait_us``, the time until a refused one could pass.
    """
    full = limit * window_us

    def start(t: int) -> tuple[int, int]:
        return full, t

    def step(state: tuple[int, int], t: int, _: int) -> tuple:
        tokens = min(full, state[0] + (t - state[1]) * limit)
        passed = tokens >= window_us
        after = tokens - window_us * passed
        if not headers:
            return passed, (after, t)
        return passed, (after, t), after // window_us, 0 if passed else -(-(window_us - tokens) // limit)

    rows = requests.select(F.col(ident).cast("long").alias("id"), F.col(client).cast("string").alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.lit(0).alias("kind"))
    return _ordered_fold(rows, start, step, ("left", "wait_us") if headers else ())


def lookup_kind(valid: Column, code: Column | None = None) -> Column:
    """The number of what a lookup finds; a null ``valid`` is no answer, ``code`` is given to tell what is no code."""
    kind = F.when(valid.isNull(), UNAVAILABLE).when(valid.cast("boolean"), VALID).otherwise(INVALID)
    return kind if code is None else F.when(F.coalesce(well_formed(code), F.lit(False)), kind).otherwise(ILL_FORMED)


def _bounded(batches: Iterator[pa.RecordBatch], ttls: dict[int, int], most: int) -> Iterator[pa.RecordBatch]:
    """All records in order against one cache of at most ``most`` entries, the least recently used of which goes."""
    cache: OrderedDict[str, int] = OrderedDict()
    for batch in batches:
        flags = np.zeros(batch.num_rows, bool)
        for i, (k, t, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "t", "kind")), strict=True)):
            if kind == ILL_FORMED:
                continue
            expires = cache.get(k)
            if expires is not None:
                cache.move_to_end(k)
                if t < expires:
                    flags[i] = True
                    continue
                del cache[k]
            if ttls.get(kind, 0) > 0:
                cache[k] = t + ttls[kind]
                if len(cache) > most:
                    cache.popitem(last=False)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), pa.array(flags)], ["id", "k", "flag"])


def cached_answers(
    requests: DataFrame, ttl_us: int, negative_ttl_us: int, key: str = "code", at: str = "ts", ident: str = "id", valid: str = "valid", check_codes: bool = True, max_entries: int | None = None
) -> DataFrame:
    """``(id, k, flag)``: whether each lookup is answered from an expiring cache.

    A miss stores the answer until its time plus the TTL of valid or invalid answers; a
    TTL of 0 stores nothing, and no answer (a null ``valid``) is never stored.  An answer
    has expired at that very time, and a hit doesn't extend it.  With ``check_codes`` a
    text that is no code bypasses the cache.  Without ``max_entries`` keys don't depend
    on each other.  With it the least recently used entry goes when there are more, so
    every record depends on all before it: one task streams them in order, holding the
    entries alone.
    """
    ttls = {VALID: ttl_us, INVALID: negative_ttl_us}
    rows = requests.select(
        F.col(ident).cast("long").alias("id"), F.col(key).cast("string").alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"),
        lookup_kind(F.col(valid), F.col(key).cast("string") if check_codes else None).alias("kind"),
    )
    if max_entries is not None:
        return rows.repartition(1).sortWithinPartitions("t", "id").mapInArrow(lambda it: _bounded(it, ttls, max_entries), _FOLDED)
    return _ordered_fold(rows, lambda t: None, lambda state, t, kind: cache_step(state, t, kind, ttls))


def cache_step(expires: int | None, t: int, kind: int, ttls: dict[int, int]) -> tuple[bool, int | None]:
    """Whether a lookup is answered from a key's entry, and the entry's end after it."""
    if kind == ILL_FORMED:
        return False, expires
    if expires is not None and t < expires:
        return True, expires
    ttl = ttls.get(kind, 0)
    return False, t + ttl if ttl > 0 else None
