"""Keyed stream state: windows, two times to live, the least lately used, and state across a restart."""

import datetime as dt
import random

import pytest

from tidewell.streaming import keyed

T0 = dt.datetime(2024, 1, 1)
DDL = "event_id long, user string, value string, ts timestamp"


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set(*keyed.STORE)
    yield lambda make, *batches: run(spark, tmp_path, make, batches)
    spark.conf.unset(keyed.STORE[0])


def run(spark, folder, make, batches):
    """The rows of a job that is started again for each batch, on one checkpoint."""
    for n, rows in enumerate(batches):
        spark.createDataFrame([(i, u, v, T0 + dt.timedelta(seconds=s)) for i, u, v, s in rows], DDL).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = make(spark.readStream.schema(DDL).parquet(f"{folder}/in"))
        out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").orderBy("event_id").collect()


def limited(rows, window, most):
    state, out = {}, []
    for i, u, _, s in rows:
        reset, n = state.get(u, (None, 0))
        if reset is None or s >= reset:
            reset, n = s + window, 0
        n += 1
        state[u] = reset, n
        out.append((i, n <= most, max(0, most - n), 0 if n <= most else reset - s))
    return out


def test_rate_limit(stream):
    rng = random.Random(1)
    rows, s = [], 0
    for i in range(120):
        s += rng.choice([0, 1, 7, 25])
        rows.append((i, rng.choice("abc"), None, s))
    got = stream(lambda events: keyed.rate_limited(events, "user", "event_id", window_s=60, most=3), rows[:50], rows[50:])
    assert [(r["event_id"], r["allowed"], r["remaining"], r["retry_after_s"]) for r in got] == limited(rows, 60, 3)


def test_windows_end_with_the_watermark(stream):
    rows = [(1, "a", None, 0), (2, "a", None, 1)], [(3, "b", None, 1000)], [(4, "a", None, 2000), (5, "a", None, 2001), (6, "a", None, 2002)]
    got = stream(lambda events: keyed.rate_limited(events, "user", "event_id", window_s=60, most=2, late="10 seconds"), *rows)
    assert [r["allowed"] for r in got] == [True, True, True, True, True, False]


def test_cache_with_two_times_to_live(stream):
    rows = [
        [(1, "x", "one", 0), (2, "x", "two", 10), (3, "y", None, 10), (4, "y", "late", 15)],
        [(5, "y", "new", 21), (6, "x", "three", 100), (7, "x", "four", 101), (8, "x", "five", 202), (9, "y", "old", 60)],
    ]
    got = stream(lambda events: keyed.cached(events, "user", "event_id", "value", ttl_s=100, negative_s=10, shards=1), *rows)
    assert {r["event_id"]: (r["hit"], r["answer"]) for r in got} == {1: (False, "one"), 2: (True, "one"), 3: (False, None), 4: (True, None), 5: (False, "new"), 6: (True, "one"), 7: (False, "four"), 8: (False, "five"), 9: (True, "new")}


def test_the_least_lately_used_goes(stream):
    rows = [[(1, "a", "1", 0), (2, "b", "1", 1), (3, "a", "2", 2), (4, "c", "1", 3)], [(5, "b", "3", 4), (6, "c", "4", 5), (7, "a", "5", 6)]]
    got = stream(lambda events: keyed.cached(events, "user", "event_id", "value", most=2, shards=1), *rows)
    assert [r["hit"] for r in got] == [False, False, True, False, False, True, False]
