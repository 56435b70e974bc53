import math
import random
import struct

from conftest import rows
from pyspark.sql import functions as F

from rillstone.llm.percentiles import counts, merged, ordered_key, percentiles, rolled_up

AT = (0.0, 0.01, 0.5, 0.95, 1.0)


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, 2) for r in data], "g string, d int, v double, n int, key int")


def brute(data, group):
    own = sorted(v for g, d, v in data if group(g, d) and v is not None and math.isfinite(v))
    return {p: own[max(1, math.ceil(round(p * 1e6) * len(own) / 1e6)) - 1] for p in AT} if own else {}


def test_matches_brute_force(spark):
    rng = random.Random(8)
    pick = lambda: rng.choice([None, float("nan"), float("inf"), 0.0, -0.0, 5e-324, 1e308, -1e308, rng.gauss(0, 1), rng.gauss(100, 5), float(rng.randint(0, 9)), -rng.random() * 1e-300])
    data = [(rng.choice(["x", "y", None]), rng.choice([1, 2, None]), pick()) for _ in range(1200)]
    part = counts(frame(spark, data), F.col("v"), {"g": F.col("g"), "d": F.col("d")})
    got = percentiles(rolled_up(part, [("g",), ("g", "d"), ()]), AT).collect()
    assert len(got) == (2 + 4 + 1) * len(AT)
    for r in got:
        kind = r["grouping"]
        group = {"g": lambda g, d: g == r["g"], "g+d": lambda g, d: g == r["g"] and d == r["d"], "all": lambda g, d: True}[kind]
        assert r["value"] == brute(data, group)[r["percentile"]], r


def test_partial_results_merge(spark):
    data = [("x", i % 3, float(i * 7919 % 1000)) for i in range(2000)]
    g = {"g": F.col("g")}
    parts = [counts(frame(spark, [r for r in data if r[1] == d]), F.col("v"), g) for d in range(3)]
    whole = counts(frame(spark, data), F.col("v"), g)
    assert rows(percentiles(merged(*parts), AT)) == rows(percentiles(whole, AT))


def test_bounded_error(spark):
    data = [("x", 1, math.exp(i / 500)) for i in range(4000)]
    part = counts(frame(spark, data), F.col("v"), {"g": F.col("g")}, mantissa_bits=6)
    assert part.count() < 1000
    for r in percentiles(part, AT).collect():
        exact = brute(data, lambda g, d: True)[r["percentile"]]
        assert exact * (1 - 2**-6) <= r["value"] <= exact


def test_defined_cases(spark):
    none = counts(frame(spark, [("x", 1, None), ("y", 1, float("nan"))]), F.col("v"), {"g": F.col("g")})
    assert percentiles(none, AT).count() == 0
    same = counts(frame(spark, [(None, 1, 3.5)] * 9), F.col("v"), {"g": F.col("g")})  # ties, and a NULL group
    assert rows(percentiles(same, (0.5,))) == [(None, 0.5, 9, 3.5)]


def test_keys_order_as_values(spark):
    rng = random.Random(1)
    values = sorted({struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3000)} | {2.0**k for k in range(-1074, 1024)} | {math.nextafter(2.0**k, 0) for k in range(-1000, 1000)}, key=lambda x: (math.isnan(x), x))
    values = [v for v in values if math.isfinite(v)]
    keys = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(ordered_key(F.col("v"))).collect()]
    assert all(a < b for a, b in zip(keys, keys[1:], strict=False))
    near = spark.createDataFrame([(1.0,), (math.nextafter(1.0, 2),)], "v double").coalesce(1).select(ordered_key(F.col("v"))).collect()
    assert near[1][0] - near[0][0] == 1
