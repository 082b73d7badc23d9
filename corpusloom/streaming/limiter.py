"""A request limit per key in windows that restart with the first request after their end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, ts long, allowed boolean"


def admit(times: np.ndarray, start: int | None, count: int, limit: int, length: int) -> tuple[np.ndarray, int | None, int]:
    """Which of a key's ascending times pass, and the window that is then open.

    ``start`` and ``count`` are the open window and the requests it let pass; a key's
    first request opens its first window.
    """
    allowed, k = np.zeros(len(times), bool), 0
    while k < len(times):
        if start is None or times[k] - start >= length:
            start, count = int(times[k]), 0
        end = int(np.searchsorted(times, start + length, "left"))
        take = min(max(limit - count, 0), end - k)
        allowed[k : k + take] = True
        count += take
        k = end
    return allowed, start, count


def _sorted_fold(limit: int, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, count = None, None, 0
        for batch in batches:
            allowed = np.zeros(len(batch), bool)
            keys, times = batch["key"].to_numpy(object), batch["ts"].to_numpy(np.int64)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if keys[a] != last:
                    last, start, count = keys[a], None, 0
                allowed[a:b], start, count = admit(times[a:b], start, count, limit, length)
            yield batch.assign(allowed=allowed)

    return run


def rate_limit(requests: DataFrame, limit: int = 15, length: int = 60) -> DataFrame:
    """``requests`` (key string, ts long) with ``allowed``; a sorted pass that holds one window.

    Rows without key or time are left out.  A key's requests are a sequence and so one
    task's work, but they stream through it: no key is held in memory.
    """
    rows = requests.select("key", "ts").filter("key is not null and ts is not null")
    return rows.repartition("key").sortWithinPartitions("key", "ts").mapInPandas(_sorted_fold(limit, length), OUTPUT)


def rate_limit_stream(requests: DataFrame, limit: int = 15, length: int = 60) -> DataFrame:
    """The same for a stream; each key's state is its open window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        times = np.sort(np.concatenate([b["ts"].to_numpy(np.int64) for b in batches]))
        allowed, start, count = admit(times, start, count, limit, length)
        state.update((start, count))
        yield pd.DataFrame({"key": key[0], "ts": times, "allowed": allowed})

    rows = requests.select("key", "ts").filter("key is not null and ts is not null")
    return rows.groupBy("key").applyInPandasWithState(step, OUTPUT, "start long, count long", "append", GroupStateTimeout.NoTimeout)
