import random

import numpy as np
import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from rillstone.llm import nearest_time
from rillstone.llm.nearest_time import PrefixTable, XFastTrie, nearest

SCHEMA = "id bigint, e string, ms bigint, side int, bucket string"


def run(spark, left, right, **kw):
    l, r = (spark.createDataFrame([(*x, 7, "clash") for x in side], SCHEMA) for side in (left, right))  # noqa: E741
    c = [F.col(x) for x in ("id", "e", "ms")]
    return nearest(l, *c, r, *c, **kw)


def brute(left, right, tolerance):
    out = {}
    for i, e, ms in left:
        near = [(abs(m - ms), m, j, m - ms) for j, f, m in right if None not in (i, e, ms, j, m) and e == f and abs(m - ms) <= tolerance]
        if near:
            out[i] = (min(near)[2], min(near)[3])
    return sorted(((i, *x) for i, x in out.items()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    ids = iter(range(10**6))
    point = lambda: (next(ids), rng.choice(["a", "b", None]), rng.choice([None, *range(-4000, 4000)]))
    left, right = [point() for _ in range(400)] + [(None, "a", 1)], [point() for _ in range(500)]
    right += [(next(ids), e, m) for _, e, m in right[:100]] + right[:50]  # ties and repeated rows
    for tolerance, bits in ((30, 6), (0, 10), (300, 3), (5000, 22)):
        assert rows(run(spark, left + left[:20], right, tolerance_ms=tolerance, bucket_bits=bits)) == brute(left, right, tolerance)


def test_defined_cases(spark, monkeypatch):
    assert run(spark, [], []).count() == run(spark, [(1, "a", 1)], []).count() == run(spark, [], [(1, "a", 1)]).count() == 0
    # equal distance: the earlier; equal time: the smaller id; the bound is included
    assert rows(run(spark, [(1, "a", 10)], [(9, "a", 20), (8, "a", 0), (7, "a", 0)])) == [(1, 7, -10)]
    assert rows(run(spark, [(1, "a", 0)], [(2, "a", 30_000)])) == [(1, 2, 30_000)]
    assert run(spark, [(1, "a", 0)], [(2, "a", 30_001)]).count() == 0
    assert rows(run(spark, [(1, "a", 5)], [(2, "a", 5)])) == [(1, 2, 0)]


def test_many_points_in_one_group(spark):
    """More rows of one group than are worked on at once."""
    n = nearest_time.BLOCK + 5000
    left = spark.range(n).select("id", F.lit("a").alias("e"), (F.col("id") % 1000 * 10 + 1).alias("ms"))
    right = spark.range(1000).select("id", F.lit("a").alias("e"), (F.col("id") * 10).alias("ms"))
    c = [F.col(x) for x in ("id", "e", "ms")]
    out = nearest(left, *c, right, *c, 100)
    assert out.count() == n
    assert out.where("right_id <> left_id % 1000 OR gap_ms <> -1").count() == 0


def test_tries_are_built_once(monkeypatch):
    """However many left records pass by; and rows in batches of any size give the same matches."""
    built = []
    monkeypatch.setattr(nearest_time, "XFastTrie", lambda *a: built.append(1) or XFastTrie(*a))
    rng = np.random.default_rng(1)
    size = {"a": 30_000, "b": 10, "c": 40_000, "d": 1}
    parts = []
    for e, n in size.items():
        for side in (0, 1):
            ms = np.sort(rng.choice(1 << 20, n, replace=False)) if side == 0 else np.sort(rng.integers(0, 1 << 20, 3 * n))
            parts.append(pa.table({"entity": [e] * len(ms), "bucket": np.zeros(len(ms), np.int64), "side": np.full(len(ms), side, np.int32), "ms": ms, "id": np.arange(len(ms))}))
    rows_ = pa.concat_tables(parts)
    results = []
    for step in (10_000, 777_777, 3_333):
        built.clear()
        m = nearest_time.Matcher(21, 20, 300)
        out = [b for batch in rows_.to_batches(max_chunksize=step) for b in m.add(batch)] + list(m.end())
        assert len(built) <= len(size)
        results.append(sorted(zip(*(pa.Table.from_batches(out)[k].to_pylist() for k in range(3)), strict=True)))
    assert results[0] == results[1] == results[2] and len(results[0]) > 100_000


def test_trie():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 50, 5000))
    t = PrefixTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + 1)[np.isin(keys + 1, keys, invert=True)] == -1).all()
    leaves = np.unique(rng.integers(0, 3 << 12, 900))
    q = rng.integers(0, 4 << 12, 3000)
    pred, succ = XFastTrie(leaves, 12).neighbours(q)
    for x, p, s in zip(q, pred, succ, strict=True):
        own = [i for i, v in enumerate(leaves) if v >> 12 == x >> 12]
        assert p == max((i for i in own if leaves[i] <= x), default=-1)
        assert s == min((i for i in own if leaves[i] > x), default=-1)
