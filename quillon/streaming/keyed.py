"""Streaming forms of the keyed folds: token buckets and expiring answers.

Each key's state lives in the state store between micro-batches.  Within a batch a
key's records are applied in order of (time, id); records must not arrive in a later
batch than younger ones of their key.  The store is one of keys: a limit on the
number of entries across keys has no counterpart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import INVALID, VALID, cache_step, lookup_kind

_OUT = "id long, k string, flag boolean"


def _stream_fold(rows: DataFrame, state_schema: str, start: Callable, step: Callable) -> DataFrame:
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["t", "id"])  # the records of one key in one batch
        now = tuple(state.get) if state.exists else None
        flags = []
        for t, kind in zip(frame["t"].tolist(), frame["kind"].tolist(), strict=True):
            flag, now = step(start(t) if now is None else now, t, kind)
            flags.append(flag)
        state.update(now)
        yield pd.DataFrame({"id": frame["id"], "k": key[0], "flag": flags})

    return rows.groupBy("k").applyInPandasWithState(fold, _OUT, state_schema, "append", GroupStateTimeout.NoTimeout)


def _rows(requests: DataFrame, key: str, at: str, ident: str, kind) -> DataFrame:
    return requests.select(F.col(ident).cast("long").alias("id"), F.col(key).cast("string").alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), kind.alias("kind"))


def stream_rate_limit(requests: DataFrame, limit: int, window_us: int, client: str = "client", at: str = "ts", ident: str = "id") -> DataFrame:
    """The streaming form of ``operators.state.rate_limit``."""
    full = limit * window_us

    def step(state: tuple, t: int, _: int) -> tuple[bool, tuple]:
        tokens = min(full, state[0] + (t - state[1]) * limit)
        passed = tokens >= window_us
        return passed, (tokens - window_us * passed, t)

    return _stream_fold(_rows(requests, client, at, ident, F.lit(0)), "tokens long, t long", lambda t: (full, t), step)


def stream_cached_answers(requests: DataFrame, ttl_us: int, negative_ttl_us: int, key: str = "code", at: str = "ts", ident: str = "id", valid: str = "valid", check_codes: bool = True) -> DataFrame:
    """The streaming form of ``operators.state.cached_answers``."""
    ttls = {VALID: ttl_us, INVALID: negative_ttl_us}

    def step(state: tuple, t: int, kind: int) -> tuple[bool, tuple]:
        hit, expires = cache_step(state[0], t, kind, ttls)
        return hit, (expires,)

    kind = lookup_kind(F.col(valid), F.col(key).cast("string") if check_codes else None)
    return _stream_fold(_rows(requests, key, at, ident, kind), "expires long", lambda t: (None,), step)
