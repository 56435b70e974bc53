import numpy as np
from pyspark.sql import functions as F

from rillstone.operators import spikes
from rillstone.operators.spikes import faults, flagged, outside_ellipsoid, stuck_runs

SCHEMA = "id bigint, s string, x string, t bigint, v double, block string, core int"


def market(n=1500, seed=0):
    """Three sources of one price, with planted faults; what was planted by id."""
    rng = np.random.default_rng(seed)
    level = 100 * np.exp(np.cumsum(rng.normal(0, 2e-4, n)))
    level[n // 2 :] *= 1.08  # a real move, on all sources
    out, planted, i = [], {}, 0
    for k, noise in enumerate((5e-4, 1e-3, 3e-3)):
        p = level * (1 + k * 1e-3) * np.exp(rng.normal(0, noise, n))
        kinds = np.full(n, "", object)
        for at in rng.choice(np.arange(50, n - 50), 8, replace=False):
            for j in range(int(rng.integers(1, 4))):
                p[at + j] *= 1 + 30 * noise * (1 if at % 2 else -1)
                kinds[at + j] = "spike"
        run = 300 + 200 * k
        p[run : run + 20] = p[run]
        kinds[run : run + 20] = ["", *["stuck"] * 19]
        p[[900 + k, 1000 + k, 1100 + k]] = [0, float("nan"), float("inf")]
        kinds[[900 + k, 1000 + k, 1100 + k]] = "impossible"
        for t in range(n):
            i += 1
            out.append((i, "M", f"x{k}", t * 30 + k * 7, float(p[t])))
            if kinds[t]:
                planted[i] = kinds[t]
    return out, planted


def run(spark, data, **kw):
    df = spark.createDataFrame([(*r, "clash", 0) for r in data], SCHEMA)
    return flagged(df, F.col("id"), F.col("s"), F.col("x"), F.col("t"), F.col("v"), **kw)


def test_finds_planted_faults(spark):
    data, planted = market()
    for kw in ({}, {"block_rows": 1000, "margin_rows": 400}):
        got = {r["record_id"]: r["kind"] for r in run(spark, data + data[::50], **kw).collect()}
        right = sum(planted.get(i) == k for i, k in got.items())
        assert right >= 0.95 * len(planted), (right, len(planted))
        assert right >= 0.97 * len(got), (right, len(got))


def test_defined_cases(spark):
    assert run(spark, []).count() == 0
    lone = [(1, "a", "x", 1, 5.0), (2, None, "x", 1, 5.0), (3, "a", None, 1, -5.0), (4, "a", "x", None, -5.0), (5, "a", "x", 2, None), (6, "b", "y", 1, -1.0)]
    assert [(r["record_id"], r["kind"]) for r in run(spark, lone).collect()] == [(6, "impossible")]
    same = [(i, "a", "x", 7, 3.0) for i in range(40)]  # ties in time; a run of the only value there is
    assert run(spark, same).count() == 39


def test_the_ellipsoid_decides(monkeypatch):
    """Without it, with one that holds all points, or with a smaller one, other records are found."""
    data, _ = market(20_000, 3)
    data.sort(key=lambda r: (r[3], r[0]))
    t, v, x = np.array([r[3] for r in data]), np.array([r[4] for r in data]), np.array([int(r[2][1:]) for r in data])
    found = faults(t, v, x)[0] == 1
    whole = spikes.outside_ellipsoid
    all_outside = lambda u, kept: (kept, *whole(u, kept)[1:])
    none_outside = lambda u, kept: (np.zeros(len(u), bool), *whole(u, kept)[1:])
    smaller = lambda u, kept: (whole(u, kept)[1] > 0.75 * whole(u, kept)[2], *whole(u, kept)[1:])
    for other in (all_outside, none_outside, smaller):
        monkeypatch.setattr(spikes, "outside_ellipsoid", other)
        assert (found != (faults(t, v, x)[0] == 1)).sum() >= 3, other


def test_turned_ellipsoid():
    """A point that is ordinary in each value by itself, but against the way in which they go together."""
    rng = np.random.default_rng(5)
    u = rng.normal(0, 1, 5000)
    u[1000:1005] = [3.2, -1, 3.4, -1, 3.2]
    outside, r, reach = outside_ellipsoid(u, np.ones(5000, bool))
    assert outside[1002] and (np.abs(u) < reach).all() and outside.sum() < 10


def test_parts():
    assert not outside_ellipsoid(np.zeros(50), np.ones(50, bool))[0].any()
    u = np.random.default_rng(1).normal(0, 1, 500)
    u[100] = 40
    assert outside_ellipsoid(u, np.ones(500, bool))[0][100]
    assert stuck_runs(np.array([1.0, 2, 2, 3, 4])).sum() == 0
    kind, _ = faults(np.zeros(0), np.zeros(0), np.zeros(0, int))
    assert len(kind) == 0
