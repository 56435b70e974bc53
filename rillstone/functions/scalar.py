"""Scalar functions of the event dialect, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillstone.cleaning import WHITE_SPACE


def substring(s: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """From a 1-based start (below 1 counts as 1); a missing or non-positive length means to the end."""
    at = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    whole = F.length(s)
    if length is None:
        return F.substring(s, at, whole)
    n = F.lit(length) if isinstance(length, int) else length
    return F.substring(s, at, F.when(n <= 0, whole).otherwise(n))


def trim(s: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(s, F.lit(WHITE_SPACE))


def length(s: Column) -> Column:
    """In characters."""
    return F.length(s)


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def round_half_away(x: Column) -> Column:
    """To a BIGINT, halves away from zero."""
    return F.round(x).cast("bigint")


def floor(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def ceiling(x: Column) -> Column:
    return F.ceil(x).cast("bigint")


def divide(a: Column, b: Column) -> Column:
    """NULL where b is 0."""
    return F.try_divide(a, b)


def divide_whole(a: Column, b: Column) -> Column:
    """Integer division towards zero; NULL where b is 0."""
    return F.when(b != 0, ((a - F.try_mod(a, b)) / b).cast("bigint"))


def as_int(x: Column) -> Column:
    """Truncated towards zero; NULL where it isn't a number in range."""
    return x.try_cast("bigint")


def as_float(x: Column) -> Column:
    return x.try_cast("double")


def display(x: Column) -> Column:
    """As text; NULL is `null`."""
    return F.coalesce(x.cast("string"), F.lit("null"))


def first_header(headers: Column, name: str) -> Column:
    """The value of the first header of that name in an array of structs (k, v)."""
    return F.get(F.filter(headers, lambda h: h["k"] == name), F.lit(0))["v"]
