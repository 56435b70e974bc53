"""Joins of two event streams on their keys, optionally bounded in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.scalar import display

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def joined(
    left: DataFrame, right: DataFrame, how: str = "inner", within_ms: int | None = None, unmatched: str = "row", null_safe: bool = False
) -> DataFrame:
    """Pairs of the rows (key, value, ts) of both sides: key, left_value, right_value, left_ts, right_ts, ts.

    ts is the later of both. With within_ms, a pair must be at most so far apart in time (inclusive).
    unmatched tells what outer joins do with a row whose key is on the other side, but beyond the bound:
    "row" keeps it without partner, as SQL does; "key" drops it. null_safe lets NULL keys match.

    A bounded join is an equi-join on key and time bucket: every left row meets the right rows of its
    own bucket and of the two beside it only, so a key with many rows is spread over its buckets.
    """
    if how not in HOW:
        raise ValueError(f"unknown join {how!r}")
    l = left.select(F.col("key").alias("l_key"), F.col("value").alias("left_value"), F.col("ts").alias("left_ts"))  # noqa: E741
    r = right.select(F.col("key").alias("r_key"), F.col("value").alias("right_value"), F.col("ts").alias("right_ts"))
    same = F.col("l_key").eqNullSafe(F.col("r_key")) if null_safe else F.col("l_key") == F.col("r_key")
    if within_ms is None:
        pairs = l.join(r, same, HOW[how])
    elif left.isStreaming or right.isStreaming:
        bound = F.expr(f"right_ts BETWEEN left_ts - INTERVAL {within_ms} MILLISECONDS AND left_ts + INTERVAL {within_ms} MILLISECONDS")
        pairs = l.join(r, same & bound, HOW[how])
    else:
        pairs = _bounded(l, r, same, HOW[how], within_ms, unmatched, null_safe)
    return pairs.select(F.coalesce("l_key", "r_key").alias("key"), "left_value", "right_value", "left_ts", "right_ts", F.greatest("left_ts", "right_ts").alias("ts"))


def _bounded(l: DataFrame, r: DataFrame, same: Column, how: str, within_ms: int, unmatched: str, null_safe: bool) -> DataFrame:  # noqa: E741
    wide = max(1, within_ms) * 1000
    lb = l.withColumn("l_bucket", F.floor(F.unix_micros("left_ts") / F.lit(wide)))
    rb = r.withColumn("r_bucket", F.floor(F.unix_micros("right_ts") / F.lit(wide)))
    near = (F.unix_micros("left_ts") - F.unix_micros("right_ts")).between(-within_ms * 1000, within_ms * 1000)
    if how in ("inner", "left"):  # three copies of one side, so that each pair meets exactly once
        many = rb.withColumn("m_bucket", F.explode(F.expr("array(r_bucket - 1, r_bucket, r_bucket + 1)"))).drop("r_bucket")
        out = lb.join(many, same & (F.col("l_bucket") == F.col("m_bucket")) & near, how).drop("l_bucket", "m_bucket")
        return out if unmatched == "row" or how == "inner" else _without(out, "left_ts", "l_key", "right_ts", r.select("r_key").distinct(), null_safe)
    if how == "right":
        many = lb.withColumn("m_bucket", F.explode(F.expr("array(l_bucket - 1, l_bucket, l_bucket + 1)"))).drop("l_bucket")
        out = many.join(rb, same & (F.col("m_bucket") == F.col("r_bucket")) & near, "right").drop("m_bucket", "r_bucket")
        return out if unmatched == "row" else _without(out, "right_ts", "r_key", "left_ts", l.select("l_key").distinct(), null_safe)
    left_part = _bounded(l, r, same, "left", within_ms, unmatched, null_safe)
    right_part = _bounded(l, r, same, "right", within_ms, unmatched, null_safe).where("left_ts IS NULL")
    return left_part.unionByName(right_part)


def _without(out: DataFrame, ts: str, key: str, other_ts: str, keys: DataFrame, null_safe: bool) -> DataFrame:
    """out without the rows that have no partner although their key is on the other side."""
    other = keys.columns[0]
    there = keys.withColumnRenamed(other, "__there")
    met = out.join(there, F.col(key).eqNullSafe(F.col("__there")) if null_safe else F.col(key) == F.col("__there"), "left")
    return met.where(F.col(other_ts).isNotNull() | F.col("__there").isNull()).drop("__there")


def as_tuples(pairs: DataFrame) -> DataFrame:
    """value is `(left, right)`; a missing side is `null`."""
    return _combined(pairs, F.concat(F.lit("("), display(F.col("left_value")), F.lit(", "), display(F.col("right_value")), F.lit(")")))


def sum_values(pairs: DataFrame) -> DataFrame:
    """value is the sum; a side that is missing or no number counts as 0."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return _combined(pairs, number("left_value") + number("right_value"))


def coalesce_left(pairs: DataFrame) -> DataFrame:
    return _combined(pairs, F.coalesce("left_value", "right_value"))


def coalesce_right(pairs: DataFrame) -> DataFrame:
    return _combined(pairs, F.coalesce("right_value", "left_value"))


def combine(pairs: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    return _combined(pairs, f(F.col("left_value"), F.col("right_value")))


def _combined(pairs: DataFrame, value: Column) -> DataFrame:
    return pairs.select("key", value.alias("value"), "ts")
