"""Rules that hold for all event tables: spelling, time unit, redelivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: An epoch above this is in milliseconds.
MS_FROM = 100_000_000_000
#: The epoch seconds of the years 1 to 9999.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def trimmed(c: Column) -> Column:
    """Without surrounding white space of any kind; NULL if nothing is left."""
    t = F.btrim(c, F.lit(WHITE_SPACE))
    return F.when(t != "", t)


def folded(c: Column) -> Column:
    """Trimmed and in lower case; a blank value is NULL."""
    return F.lower(trimmed(c))


def folded_symbol(c: Column) -> Column:
    """As folded, without whatever separates the parts: `Orb/Usd`, `orb_usd` and `ORBUSD` are one."""
    t = F.regexp_replace(F.lower(trimmed(c)), r"[^\p{L}\p{N}]", "")
    return F.when(t != "", t)


def seconds(c: Column) -> Column:
    """Epoch seconds of an epoch in seconds or milliseconds (the floor); NULL outside the years 1 to 9999."""
    ms = c.cast("bigint")
    s = F.when(ms > MS_FROM, (ms - F.pmod(ms, F.lit(1000))) / F.lit(1000)).otherwise(ms).cast("bigint")
    return F.when(s.between(FIRST_SECOND, LAST_SECOND), s)


def one_per_id(df: DataFrame, record_id: str, first_by: list[str] | None = None) -> DataFrame:
    """One row per id: the first by `first_by`, then by all other columns.

    A NULL id can't be told from another; each such row stays a record of its own, and as those rows
    are numbered they don't meet in one task either.
    """
    rest = [c for c in df.columns if c != record_id]
    order = [*(first_by or []), *(c for c in rest if c not in (first_by or []))]
    own = df.withColumn("__own", F.when(F.col(record_id).isNull(), F.monotonically_increasing_id()))
    best = own.groupBy(record_id, "__own").agg(F.min(F.struct(*order)).alias("__r"))
    return best.select(record_id, *[F.col("__r")[c].alias(c) for c in rest])
