import random
from datetime import date, timedelta

from conftest import rows
from pyspark.sql import functions as F

from rillstone.operators.rolling import rolling_totals

SCHEMA = "id bigint, e string, d date, v double, entity string, n int, day string"


def run(spark, data, **kw):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in data], SCHEMA)
    return rolling_totals(df, F.col("e"), F.col("d"), F.col("v"), F.col("id"), **kw)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    start = date(2025, 1, 1)
    data = [(i, rng.choice("abc"), start + timedelta(rng.randint(0, 60)), rng.choice([None, float("nan"), float("inf"), -1.5, 0.1, 2.25])) for i in range(150)]
    data += data[:40]  # delivered again
    got = {(r["entity"], r["day"]): r for r in run(spark, data).collect()}
    one = {r[0]: r for r in data}.values()
    want = 0
    for e in "abc":
        own = [r for r in one if r[1] == e]
        day = min(r[2] for r in own)
        while day <= max(r[2] for r in own):
            want += 1
            for p in (7, 30):
                inside = [r for r in own if day - timedelta(p) < r[2] <= day]
                values = [r[3] for r in inside if r[3] is not None and r[3] == r[3] and r[3] != float("inf")]
                g = got[e, day]
                assert g[f"events_{p}d"] == len(inside)
                assert abs(g[f"total_{p}d"] - sum(values)) < 1e-9
                assert (g[f"average_{p}d"] is None) == (not values)
            assert got[e, day]["n_events"] == sum(r[2] == day for r in own)
            day += timedelta(1)
    assert len(got) == want


def test_defined_cases(spark):
    assert run(spark, []).count() == 0
    day = date(2025, 1, 1)
    assert run(spark, [(1, None, day, 1.0), (2, "a", None, 1.0)]).count() == 0
    # rows without an id are records of their own
    assert run(spark, [(None, "a", day, 1.0)] * 3).collect()[0]["events_7d"] == 3
    # a total doesn't suffer from a large value that has left the period
    out = rows(run(spark, [(1, "a", day, 9e15), (2, "a", day + timedelta(10), 0.1)]).select("day", "total_7d"))
    assert (day + timedelta(10), 0.1) in out
