"""Trace context in event headers, as W3C's traceparent: 00-<32 hex digits of trace>-<16 of span>-<2 of flags>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillstone.functions.scalar import first_header

HEADER = "traceparent"
#: Fixed value: the form of a context of version 00.
FORM = "^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"


def _part(headers: Column, n: int) -> Column:
    found = F.regexp_extract(first_header(headers, HEADER), FORM, n)
    return F.when(found.rlike("[^0]") if n < 3 else found != "", found)  # ids of zeros are none


def trace_id(headers: Column) -> Column:
    """The trace's id; NULL without a context that can be read."""
    return F.when(_part(headers, 2).isNotNull(), _part(headers, 1))


def span_id(headers: Column) -> Column:
    return F.when(_part(headers, 1).isNotNull(), _part(headers, 2))


def sampled(headers: Column) -> Column:
    """Whether the trace is recorded; NULL without a context."""
    return F.when(trace_id(headers).isNotNull(), F.conv(_part(headers, 3), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1)


def traced(headers: Column, event_id: Column, step: str, record: bool = True) -> Column:
    """The headers with a span of one's own for a step: a child of the context in the headers, or the first of a new trace.

    Ids are hashes of the event's id, the parent and the step, so a task that runs again gives the same ones.
    """
    own = F.concat_ws("/", event_id.cast("string"), F.coalesce(span_id(headers), F.lit("")), F.lit(step))
    trace = F.coalesce(trace_id(headers), F.md5(F.concat(F.lit("trace/"), own)))
    flags = F.coalesce(_part(headers, 3), F.lit("01" if record else "00"))
    context = F.concat(F.lit("00-"), trace, F.lit("-"), F.substring(F.md5(own), 1, 16), F.lit("-"), flags)
    rest = F.filter(F.coalesce(headers, F.array().cast("array<struct<k: string, v: string>>")), lambda h: h["k"] != HEADER)
    return F.concat(rest, F.array(F.struct(F.lit(HEADER).alias("k"), context.alias("v"))))
