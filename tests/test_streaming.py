from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from rillstone.catalog import streams
from rillstone.streaming.late import late_windows
from rillstone.streaming.monitor import QueryMetrics, batches, forget, rewind
from rillstone.streaming.processors import KeyedStore, LateWindows, RunningCount, SessionProcessor
from rillstone.streaming.run import drained

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def fed(spark, tmp_path, batches, schema):
    """A stream that takes one batch after another."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    import pathlib
    import time

    files = sorted(pathlib.Path(f"{tmp_path}/in").rglob("*.parquet"))
    (tmp_path / "flat").mkdir()
    for i, f in enumerate(files):
        f.rename(tmp_path / "flat" / f"{i:03d}.parquet")
        import os

        os.utime(tmp_path / "flat" / f"{i:03d}.parquet", (time.time() - 1000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")


def test_late_windows_over_batches(spark, tmp_path):
    schema = "key string, event_id bigint, seq bigint, ms bigint, value bigint, window_ms bigint, lateness bigint, disorder bigint"
    row = lambda i, ms, v=1: ("a", i, i, ms, v, 1000, 1000, 0)
    s = fed(spark, tmp_path, [[row(1, 100), row(2, 200, None)], [row(3, 1500)], [row(4, 300, 5), row(1, 100), row(5, 2500)], [row(6, 400), row(7, 900)]], schema)
    out = drained(s.groupBy("key").transformWithState(LateWindows(), LateWindows.OUTPUT, "Append", "None"))
    got = rows(out.select("outcome", "event_id", "window_start", "revision", "n", "total"))
    assert got == sorted([("window", None, 0, 0, 2, 1), ("corrected", 4, 0, 1, 3, 6), ("window", None, 1000, 0, 1, 1), ("dropped", 6, 0, None, None, None), ("dropped", 7, 0, None, None, None)], key=repr)


def test_dedup_keeps_records_without_transaction(spark, tmp_path):
    r = [(1, "t1"), (2, "t2"), (1, "t1"), (3, None), (3, None), (4, None)]
    data = [(e, "a", 1, i, i, T0 + timedelta(seconds=i), t) for i, (e, t) in enumerate(r)]
    spark.createDataFrame(data, "event_id bigint, key string, value bigint, ms bigint, arrival_seq bigint, arrived_at timestamp, transaction_id string").write.parquet(f"{tmp_path}/stream_events.parquet")
    assert rows(streams.stream_dedup(spark, str(tmp_path))) == sorted([("t1", 1), ("t2", 2), (None, 3), (None, 3), (None, 4)], key=repr)


def timed(spark, tmp_path, batches, delay, gap):
    s = fed(spark, tmp_path, [[(k, T0 + timedelta(seconds=x), int((T0.timestamp() + x) * 1000)) for k, x in b] for b in batches], "key string, ts timestamp, ms bigint")
    out = drained(s.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(SessionProcessor(gap), SessionProcessor.OUTPUT, "Append", "EventTime"))
    at = int(T0.timestamp() * 1000)
    return sorted((k, (a - at) // 1000, (b - at) // 1000, n) for k, a, b, n in rows(out))


def test_session_timers_over_batches(spark, tmp_path):
    got = timed(spark, tmp_path, [[("a", 0), ("a", 8), ("b", 1)], [("a", 18), ("a", 40)], [("c", 200)], [("c", 400)]], "1 second", 10_000)
    assert got == [("a", 0, 18, 3), ("a", 40, 40, 1), ("b", 1, 1, 1), ("c", 200, 200, 1)]


def test_sessions_out_of_order(spark, tmp_path):
    """Within the watermark's delay, sessions stay open side by side, and events between two make them one."""
    batches = [[("a", 1000)], [("a", 500), ("a", 510)], [("a", 1100)], [("a", 1020), ("a", 1080)], [("a", 1050)], [("b", 9000)], [("b", 9900)]]
    assert timed(spark, tmp_path, batches, "1000 seconds", 30_000) == [("a", 500, 510, 2), ("a", 1000, 1100, 5)]


class Calls:
    """A handle and its value state in memory, which counts the calls."""

    def __init__(self):
        self.value, self.timers, self.n = None, [], 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n, self.value = self.n + 1, value

    def clear(self):
        self.update(None)

    def registerTimer(self, at):  # noqa: N802
        self.n, self.timers = self.n + 1, [*self.timers, at]

    def deleteTimer(self, at):  # noqa: N802
        self.n, self.timers = self.n + 1, [t for t in self.timers if t != at]

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 5_000_000


def test_session_timers_by_group():
    """The sessions of all keys of a group take one value and one timer, whatever their number."""
    h, p = Calls(), SessionProcessor(1000)
    p.init(h)
    batch = lambda at: pd.DataFrame({"part": 7, "key": [str(i) for i in range(500)] * len(at), "ms": np.repeat(at, 500)})
    assert not [*p.handleInputRows((7,), iter([batch([9_000, 4_000]), batch([20_000])]), h), *p.handleInputRows((7,), iter([batch([3_000, 4_999_000, 4_999_001])]), h)]
    assert h.n == 5 and h.timers == [5_000]  # once 4,000 + gap, also after 3,000 came
    (out,) = p.handleExpiredTimer((7,), h, None)
    assert h.n == 8 and h.timers == [5_000, 5_000_001]  # Spark deletes the first
    assert sorted(zip(*(out[c] for c in out), strict=True)) == sorted((str(i), a, b, n) for i in range(500) for a, b, n in [(3_000, 4_000, 2), (9_000, 9_000, 1), (20_000, 20_000, 1)])


def test_session_disorder_by_group():
    """Batches out of order cost a group a few calls each, and give the sessions of all events at once."""
    h, p = Calls(), SessionProcessor(1000)
    p.init(h)
    rng = np.random.default_rng(3)
    keys, ms = rng.integers(0, 200, 8000).astype(str), rng.integers(0, 100_000, 8000)
    late = ms + rng.integers(0, 40_000, 8000)
    for i in range(7):
        at = (late // 20_000) == i
        assert not [*p.handleInputRows((7,), iter([pd.DataFrame({"key": keys[at], "ms": ms[at]})]), h)]
    assert h.n <= 7 * 4 and len(h.timers) == 1
    (out,) = p.handleExpiredTimer((7,), h, None)
    assert h.value is None
    e = pd.DataFrame({"key": keys, "ms": ms}).sort_values(["key", "ms"])
    nth = (e.groupby("key")["ms"].diff() > 1000).groupby(e["key"]).cumsum()
    want = e.groupby(["key", nth.rename("nth")])["ms"].agg(["min", "max", "count"]).reset_index().drop(columns="nth")
    assert sorted(map(tuple, out.to_numpy())) == sorted(map(tuple, want.to_numpy()))


def test_session_timers_of_keys_in_one_group(spark, tmp_path):
    batches = [[(0, k, T0 + timedelta(seconds=x), int((T0.timestamp() + x) * 1000)) for k, x in b] for b in ([("a", 0), ("b", 5), ("a", 8), ("b", 30)], [("b", 20), ("c", 11), (None, 1)], [("c", 400)])]
    s = fed(spark, tmp_path, batches, "part int, key string, ts timestamp, ms bigint").withWatermark("ts", "100 seconds")
    out = drained(s.groupBy("part").transformWithStateInPandas(SessionProcessor(10_000), SessionProcessor.OUTPUT, "Append", "EventTime"))
    at = int(T0.timestamp() * 1000)
    assert rows(out) == sorted([("a", at, at + 8000, 2), ("b", at + 5000, at + 5000, 1), ("b", at + 20_000, at + 30_000, 2), ("c", at + 11_000, at + 11_000, 1), (None, at + 1000, at + 1000, 1)], key=repr)


def test_running_count(spark, tmp_path):
    s = fed(spark, tmp_path, [[("a", 1), ("b", 2)], [("a", 3), ("a", 4)]], "key string, id bigint")
    out = drained(s.groupBy("key").transformWithStateInPandas(RunningCount(), RunningCount.OUTPUT, "Append", "None"))
    assert rows(out) == [("a", 1, 1), ("a", 3, 2), ("a", 4, 3), ("b", 2, 1)]


def test_keyed_store(spark, tmp_path):
    schema = "key string, op string, name string, value string, tx string, seq bigint"
    put = lambda q, n, v, tx=None: ("k", "put", n, v, tx, q)
    get = lambda q, n: ("k", "get", n, None, None, q)
    batches = [[put(1, "ab", "1", "t1"), put(2, "ac", "2"), get(3, "ab")], [put(4, "ab", "9", "t1"), get(5, "ab"), put(6, "b", "3"), get(7, "ac"), ("k", "list", "a", None, None, 8)], [("k", "delete", "b", None, None, 9), get(10, "b")]]
    s = fed(spark, tmp_path, batches, schema)
    out = drained(s.groupBy("key").transformWithState(KeyedStore(max_entries=2), KeyedStore.OUTPUT, "Append", "None"))
    assert sorted((q, n, v) for _, q, _, n, v in rows(out)) == [(3, "ab", "1"), (5, "ab", "1"), (7, "ac", None), (8, "ab", None), (10, "b", None)]
    with pytest.raises(ValueError):
        KeyedStore(policy="random")


def test_keyed_store_snapshot_and_size(spark, tmp_path):
    op = lambda q, o, n=None, v=None: ("k", o, n, v, None, q)
    batches = [[op(1, "put", "a", "xx"), op(2, "put", "b", "yyyy"), op(3, "exists", "a"), op(4, "snapshot")], [op(5, "put", "c", "zzzz"), op(6, "exists", "a"), op(7, "clear"), op(8, "snapshot"), op(9, "exists", "c")]]
    s = fed(spark, tmp_path, batches, "key string, op string, name string, value string, tx string, seq bigint")
    out = drained(s.groupBy("key").transformWithState(KeyedStore(max_bytes=10), KeyedStore.OUTPUT, "Append", "None"))
    assert sorted((q, n, v) for _, q, _, n, v in rows(out)) == [(3, "a", "true"), (4, "a", "xx"), (4, "b", "yyyy"), (6, "a", "false"), (9, "c", "false")]


def test_policies(spark, tmp_path):
    s = fed(spark, tmp_path, [[("a", 1, 1, 100, 1), ("a", 2, 2, 1500, 1)], [("a", 3, 3, 200, 1), ("a", 4, 4, 4000, 1)], [("a", 5, 5, 300, 1), (None, 6, 6, 300, 1)]], "key string, event_id bigint, seq bigint, ms bigint, value bigint")
    c = spark.createDataFrame([("a", 1000, 1000, 0)], "key string, window_ms bigint, lateness bigint, disorder bigint")
    got = {p: [r[0] for r in rows(drained(late_windows(s, c, p)).select("outcome"))] for p in ("drop", "update", "side_output")}
    assert got == {"drop": ["window"] * 2, "update": ["corrected", "window", "window"], "side_output": ["corrected", "dropped", "window", "window"]}
    with pytest.raises(ValueError):
        late_windows(s, c, "ignore")


def test_monitor(spark, tmp_path):
    m = QueryMetrics()
    spark.streams.addListener(m)
    try:
        s = fed(spark, tmp_path, [[("a", 1)], [("b", 2)]], "key string, id bigint")
        q = s.writeStream.queryName("copy").format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        import time

        for _ in range(50):
            if "copy" in m.queries and m.queries["copy"]["rows"] == 2:
                break
            time.sleep(0.2)
        assert m.queries["copy"]["active"] == 0
        other = spark.readStream.format("rate").load().writeStream.queryName("other").format("noop").start()
        for _ in range(50):
            if m.queries.get("other", {}).get("active"):
                break
            time.sleep(0.2)
        again = s.writeStream.queryName("again").format("noop").trigger(availableNow=True).start()
        again.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        for _ in range(50):
            if m.queries.get("again", {}).get("active") == 0:
                break
            time.sleep(0.2)
        assert m.queries["again"]["active"] == 0 and m.queries["other"]["active"] == 1  # the end of one isn't the end of all
        other.stop()
        assert m.queries["copy"]["rows"] == 2 and 'rillstone_query_rows{query="copy"} 2' in m.text() and '"copy"' in m.as_json()
    finally:
        spark.streams.removeListener(m)
    assert batches(spark, f"{tmp_path}/c") == [1, 0] and batches(spark, f"{tmp_path}/none") == []
    assert forget(spark, f"{tmp_path}/c") and not forget(spark, f"{tmp_path}/c")


def test_rewind(spark, tmp_path):
    """A running count taken back to its first batch counts the later ones again."""
    s = fed(spark, tmp_path, [[("a", 1)], [("a", 2)], [("a", 3)]], "key string, id bigint")
    seen = []

    def go_on():
        out = s.groupBy("key").transformWithStateInPandas(RunningCount(), RunningCount.OUTPUT, "Append", "None")
        out.writeStream.foreachBatch(lambda d, n: seen.extend((r["id"], r["n"]) for r in d.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    go_on()
    assert seen == [(1, 1), (2, 2), (3, 3)]
    seen.clear()
    assert rewind(spark, f"{tmp_path}/cp", 0) == [2, 1]
    go_on()
    assert seen == [(2, 2), (3, 3)]
    with pytest.raises(ValueError):
        rewind(spark, f"{tmp_path}/cp", 99)
