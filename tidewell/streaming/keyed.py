"""Keyed state over event streams: a limit on requests by client, and a cache with two times to live.

State lives in the stream's state store, so a job that is started again on its checkpoint goes on where it was. Events of a
key are taken by time within a batch; an event that comes in a later batch with an earlier time is taken as it comes.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Setting that keyed state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class _Limiter(StatefulProcessor):
    """A client's window: when it ends, and its requests so far."""

    def __init__(self, window_ms: int, most: int, key: str, order: list[str]):
        self.window_ms, self.most, self.key, self.order = window_ms, most, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "reset long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _in_order(rows, self.order)
        reset, n = self.window.get() if self.window.exists() else (None, 0)
        was, out = reset, []
        for at in _millis(events["ts"]).tolist():
            if reset is None or at >= reset:
                reset, n = at + self.window_ms, 0
            n += 1
            allowed = n <= self.most
            out.append((allowed, max(0, self.most - n), 0 if allowed else -(-(reset - at) // 1000)))
        self.window.update((reset, n))
        if reset != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(reset)
        made = pd.DataFrame(out, columns=["allowed", "remaining", "retry_after_s"])
        yield pd.concat([events[[self.key, *self.order]], made], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()  # its window is over for the watermark
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, key: str, event_id: str, window_s: int = 60, most: int = 30, late: str = "2 days") -> DataFrame:
    """Each event with whether its client may go on: a window starts with a client's first request outside the last one, and `most` of it are allowed.

    remaining: requests left in the window; retry_after_s: whole seconds to its end for a refused one. A client's state goes when the
    watermark passes its window's end, so the state holds the clients of the last windows alone.
    """
    types = dict(events.dtypes)
    rows = events.select(key, event_id, "ts").withWatermark("ts", late).groupBy(key)
    schema = f"{key} {types[key]}, ts timestamp, {event_id} {types[event_id]}, allowed boolean, remaining long, retry_after_s long"
    return rows.transformWithStateInPandas(_Limiter(1000 * window_s, most, key, ["ts", event_id]), schema, "append", "eventTime")


class _Cache(StatefulProcessor):
    """The entries of one shard, the least lately used first."""

    def __init__(self, ttl_ms: int, negative_ms: int, most: int, key: str, value: str, order: list[str]):
        self.ttl_ms, self.negative_ms, self.most, self.key, self.value, self.order = ttl_ms, negative_ms, most, key, value, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "value string, expires long, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _in_order(rows, self.order)
        stored = {k[0]: tuple(v) for k, v in self.entries.iterator()}  # `most` at most
        entries = OrderedDict(sorted(stored.items(), key=lambda e: e[1][2]))
        clock = max((v[2] for v in entries.values()), default=0)
        out = []
        for k, fresh, at in zip(events[self.key].astype(str), events[self.value].astype(object).where(events[self.value].notna(), None), _millis(events["ts"]).tolist()):
            clock += 1
            held = entries.pop(k, None)
            hit = held is not None and at <= held[1]
            value, expires = held[:2] if hit else (None if fresh is None else str(fresh), at + (self.negative_ms if fresh is None else self.ttl_ms))
            entries[k] = (value, expires, clock)
            while len(entries) > self.most:
                entries.popitem(last=False)
            out.append((hit, value))
        for k in stored.keys() - entries.keys():
            self.entries.removeKey((k,))
        for k, v in entries.items():
            if stored.get(k) != v:
                self.entries.updateValue((k,), v)
        made = pd.DataFrame(out, columns=["hit", "answer"])
        yield pd.concat([events[[self.key, *self.order]], made], axis=1)

    def close(self) -> None:
        pass


def cached(events: DataFrame, key: str, event_id: str, value: str, ttl_s: int = 30 * 86_400, negative_s: int = 600, most: int = 100_000, shards: int = 64) -> DataFrame:
    """Each lookup with whether a cache has its key, and the answer: the cached one, or `value`, which is then kept.

    A null value is an answer as well, kept for `negative_s`. Keys are dealt to shards by a hash; a shard keeps `most` / `shards`
    entries and lets go the least lately used ones, which with one shard is the order over all. A shard's state is bounded by that.
    """
    types = dict(events.dtypes)
    rows = events.select(key, event_id, "ts", F.col(value).cast("string").alias(value)).filter(F.col(key).isNotNull())
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards))).groupBy("_shard")
    schema = f"{key} {types[key]}, ts timestamp, {event_id} {types[event_id]}, hit boolean, answer string"
    return rows.transformWithStateInPandas(_Cache(1000 * ttl_s, 1000 * negative_s, max(1, most // shards), key, value, ["ts", event_id]), schema, "append", "none")
