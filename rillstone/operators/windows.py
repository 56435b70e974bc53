"""Windows over event time: tumbling, sliding, session and count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators.ranks import running


@dataclass(frozen=True)
class Spec:
    """A kind of window; times are in ms, n is the size of a count window."""

    kind: str
    size: int = 0
    slide: int = 0
    offset: int = 0
    merge: bool = True


def tumbling(size_ms: int, offset_ms: int = 0) -> Spec:
    return Spec("tumbling", _positive(size_ms), size_ms, offset_ms)


def sliding(size_ms: int, slide_ms: int | None = None, offset_ms: int = 0) -> Spec:
    """Without a slide, half the size."""
    slide = size_ms / 2 if slide_ms is None else slide_ms
    return Spec("sliding", _positive(size_ms), _positive(slide), offset_ms)


def session(gap_ms: int, merge: bool = True) -> Spec:
    """Events at most gap apart are in one session; unmerged, each moment is a session of its own."""
    return Spec("session", _positive(gap_ms), merge=merge)


def count_window(n: int) -> Spec:
    """So many events of a key in order of time."""
    return Spec("count", _positive(n))


def _positive(n: float) -> int:
    if n <= 0:
        raise ValueError(f"a window's size, slide or gap must be positive, not {n}")
    return n


def _interval(ms: float) -> str:
    return f"{round(ms * 1000)} microseconds"


def assigned(df: DataFrame, ts: str, spec: Spec, keys: list[str] | None = None, tie: str | None = None) -> tuple[DataFrame, Column | list[Column]]:
    """df and the columns to group by so that each window is a group; see bounds() for its bounds.

    Spark's window() and session_window() where they can say it (also on streams). Windows that slide by
    more than their size leave gaps, which these can't; their starts are worked out instead, and events in a gap have no row.
    """
    if spec.kind == "tumbling" or spec.kind == "sliding" and spec.slide <= spec.size:
        w = F.window(ts, _interval(spec.size), _interval(spec.slide), _interval(spec.offset % spec.slide))
        return df, w.alias("__w")
    if spec.kind == "sliding":
        us = F.unix_micros(ts) - round(spec.offset * 1000)
        start = us - F.pmod(us, F.lit(round(spec.slide * 1000)))
        inside = df.where(us - start < round(spec.size * 1000))
        at = start + round(spec.offset * 1000)
        return inside, F.struct(F.timestamp_micros(at).alias("start"), F.timestamp_micros(at + round(spec.size * 1000)).alias("end")).alias("__w")
    if spec.kind == "session" and spec.merge:
        return df, F.session_window(ts, _interval(spec.size)).alias("__w")
    if spec.kind == "session":
        us = F.unix_micros(ts)
        return df, F.struct(F.col(ts).alias("start"), F.timestamp_micros(us + round(spec.size * 1000)).alias("end")).alias("__w")
    numbered = running(df, keys or [], [c for c in (ts, tie) if c])
    return numbered.withColumn("__nth", F.floor((F.col("__upto") - 1) / F.lit(spec.size))).drop("__upto"), [F.col("__nth")]


def aggregated(df: DataFrame, ts: str, spec: Spec, keys: list[str], aggs: dict[str, Column], tie: str | None = None) -> DataFrame:
    """The aggregates per window and keys, with window_start and window_end in epoch ms.

    A count window's bounds are its first and last event's times.
    """
    rows, by = assigned(df, ts, spec, keys, tie)
    named = [c.alias(n) for n, c in aggs.items()]
    if spec.kind == "count":
        out = rows.groupBy(*keys, *by).agg(*named, F.unix_millis(F.min(ts)).alias("window_start"), F.unix_millis(F.max(ts)).alias("window_end"))
        return out.drop("__nth")
    out = rows.groupBy(*keys, by).agg(*named)
    return out.select(*keys, *aggs, F.unix_millis("__w.start").alias("window_start"), F.unix_millis("__w.end").alias("window_end"))
