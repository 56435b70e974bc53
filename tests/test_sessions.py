import random

import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from rillstone.operators.sessions import SessionTimers, sessions

SCHEMA = "id bigint, u string, t bigint, k string, key string, slice int, start string, n0 int"


def run(spark, data, **kw):
    df = spark.createDataFrame([(*r, "clash", 0, "", 0) for r in data], SCHEMA)
    return sessions(df, F.col("u"), F.col("t"), F.col("k"), F.col("id"), ("a", "b"), **kw)


def brute(data, gap):
    out = []
    by = {}
    for i, u, t, k in {r for r in data if r[1] is not None and r[2] is not None}:
        by.setdefault(u, []).append((t, i, k))
    for u, events in by.items():
        events.sort(key=lambda e: e[0])
        part = [events[0]]
        for e in events[1:] + [(10**18, None, None)]:
            if e[0] - part[-1][0] > gap:
                c = [sum(x[2] == k for x in part) for k in ("a", "b")]
                out.append((u, part[0][0], part[-1][0], part[-1][0] - part[0][0], len(part), *c, len(part) - sum(c)))
                part = []
            part.append(e)
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["x", "y", None]), rng.choice([None, *range(-5000, 9000, 7)]), rng.choice(["a", "b", "z", None])) for i in range(700)]
    data += data[:100]
    for gap in (3, 40, 500):
        assert rows(run(spark, data, gap=gap, slice_seconds=600)) == brute(data, gap)


def test_borders(spark):
    # exactly the gap doesn't split, also across a slice, and a session may fill slices
    assert [r[1:5] for r in rows(run(spark, [(1, "x", 86_000, "a"), (2, "x", 87_800, "a")]))] == [(86_000, 87_800, 1800, 2)]
    assert len(rows(run(spark, [(1, "x", 86_000, "a"), (2, "x", 87_801, "a")]))) == 2
    long = [(i, "x", i * 1800, "b") for i in range(200)]
    assert [r[1:5] for r in rows(run(spark, long))] == [(0, 199 * 1800, 199 * 1800, 200)]
    assert run(spark, []).count() == 0


def test_timers_carry_over_batches():
    t = pa.RecordBatch.from_arrays([pa.array(["x"] * 3 + ["y"]), pa.array([0, 0, 0, 0], pa.int64()), pa.array([0, 5, 50, 7], pa.int64()), pa.array([0, 0, 1, 0], pa.int32()), pa.array([1, 2, 3, 4], pa.int64())], names=list("abcde"))
    timers, out = SessionTimers(10, 2), []
    for i in range(4):
        if (due := timers.updates(t.slice(i, 1))) is not None:
            out += due.to_pylist()
    out += timers.expired().to_pylist()
    assert [(r["key"], r["start"], r["end"], r["n0"], r["n1"]) for r in out] == [("x", 0, 5, 2, 0), ("x", 50, 50, 0, 1), ("y", 7, 7, 1, 0)]
