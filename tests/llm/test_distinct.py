import random

from conftest import rows
from pyspark.sql import functions as F

from rillstone.llm.distinct import estimates, merged, registers, rolled_up

SETS = [("a",), ("b",), ("a", "b"), ()]


def groups():
    return {"a": F.col("a"), "b": F.col("b")}


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "clash") for r in data], "item string, a string, b int, sketch int, distinct string")


def test_estimates_within_bound(spark):
    rng = random.Random(2)
    data = [(f"u{rng.randint(0, 20000)}", rng.choice(["x", "y", None]), rng.choice([1, 2, 3])) for _ in range(40000)] + [(None, "x", 1)]
    part = registers(frame(spark, data), F.col("item"), groups())
    for r in estimates(rolled_up(part, SETS)).collect():
        names = {"all": (), "a": ("a",), "b": ("b",), "a+b": ("a", "b")}[r["grouping"]]
        own = {i for i, a, b in data if i and all(dict(a=a, b=b)[n] is not None and dict(a=a, b=b)[n] == r[n] for n in names)}
        assert abs(r["distinct"] - len(own)) <= 4 * r["standard_error"] * len(own) + 1, (r, len(own))
        assert r["lower"] <= r["distinct"] <= r["upper"]


def test_coverage_of_two_errors(spark):
    """Groups of 8 to 20 thousand, where plain means of registers are biased: two standard errors hold as they should."""
    sizes = [8000 + 75 * i for i in range(160)]
    spans = spark.createDataFrame(list(enumerate(sizes)), "g int, size int").repartition(4)
    each = spans.select("g", "size", F.explode(F.sequence(F.lit(1), "size")).alias("i")).select("g", F.concat_ws("-", "g", "i").alias("item"))
    out = {r["g"]: r for r in estimates(registers(each, F.col("item"), {"g": F.col("g")})).collect()}
    inside = sum(out[g]["lower"] <= n <= out[g]["upper"] for g, n in enumerate(sizes))
    bias = sum(out[g]["distinct"] / n - 1 for g, n in enumerate(sizes)) / len(sizes)
    assert inside >= 0.93 * len(sizes) and abs(bias) < 0.005, (inside, bias)


def test_partial_results_merge(spark):
    data = [(f"u{i % 7000}", "x" if i % 3 else "y", i % 2) for i in range(30_000)]
    whole = registers(frame(spark, data), F.col("item"), groups())
    parts = [registers(frame(spark, data[i::3]), F.col("item"), groups()) for i in range(3)]
    assert rows(estimates(merged(*parts))) == rows(estimates(whole))
    again = registers(frame(spark, data[::-1] + data), F.col("item"), groups())  # neither redelivered rows nor another order change anything
    assert rows(estimates(again)) == rows(estimates(whole))
    assert rows(estimates(rolled_up(merged(*parts), SETS))) == rows(estimates(rolled_up(whole, SETS)))


def test_small_groups_and_empty(spark):
    assert rows(estimates(registers(frame(spark, [("u", "x", 1), ("v", "x", 1), ("w", "y", 1)]), F.col("item"), {"a": F.col("a")})).select("a", "distinct")) == [("x", 2), ("y", 1)]
    assert estimates(rolled_up(registers(frame(spark, []), F.col("item"), groups()), SETS)).count() == 0
