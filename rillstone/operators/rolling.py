"""Totals over trailing periods from cumulative sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.cleaning import one_per_id

#: Values at or beyond this magnitude, NaN and infinities can't be summed exactly and count as missing.
LARGEST = 1e17
EXACT = "decimal(28,10)"


def rolling_totals(
    df: DataFrame, entity: Column, day: Column, value: Column, record_id: Column | None = None, periods: tuple[int, ...] = (7, 30)
) -> DataFrame:
    """Events, total and average of value per entity and day over trailing periods.

    One row per entity and calendar day from its first to its last day with events, days without
    events included. Columns: entity, day, n_events (of the day itself) and for each period P
    events_Pd, total_Pd, average_Pd.

    Method: daily sums are turned into prefix sums per entity, each prefix is carried forward over the
    days up to the next one with events, and a trailing total is the prefix at the day less the prefix
    P days before. Sums are decimals, so the difference of two prefixes is exact.

    Events are summed up per entity and day before anything is gathered by entity, so an entity holds
    one row per calendar day in its task however many events it has.

    Defined cases: a NULL entity or day takes no part. A NULL, NaN, infinite or huge (>= 1e17) value is
    an event without a value: it counts in events, not in total and average. A total without values
    is 0, an average NULL. Rows with the same record_id are one; rows without one count each. An
    empty table gives no rows. Other columns of df are ignored whatever their names.
    """
    v = value.cast("double")
    rows = df.select(
        entity.alias("entity"),
        day.cast("date").alias("day"),
        F.when(~F.isnan(v) & (F.abs(v) < LARGEST), v.cast(EXACT)).alias("value"),
        *([record_id.alias("record_id")] if record_id is not None else []),
    ).where("entity IS NOT NULL AND day IS NOT NULL")
    if record_id is not None:
        rows = one_per_id(rows, "record_id")
    daily = rows.groupBy("entity", "day").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0)).cast("decimal(38,10)").alias("total"), F.count("value").alias("valued")
    )
    by_day = Window.partitionBy("entity").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = daily.select(
        "entity",
        F.col("day").alias("from_day"),
        "n",
        F.lead("day").over(by_day).alias("next_day"),
        F.sum("n").over(so_far).alias("p_n"),
        F.sum("total").over(so_far).cast("decimal(38,10)").alias("p_total"),
        F.sum("valued").over(so_far).alias("p_valued"),
    )
    dense = prefixes.select(
        "entity",
        F.explode(F.expr("sequence(from_day, coalesce(date_sub(next_day, 1), from_day))")).alias("day"),
        "from_day", "n", "p_n", "p_total", "p_valued",
    )
    out = [F.col("entity"), F.col("day"), F.when(F.col("day") == F.col("from_day"), F.col("n")).otherwise(0).cast("bigint").alias("n_events")]
    for p in periods:
        def within(c: str, p: int = p) -> Column:
            return F.col(c) - F.coalesce(F.lag(c, p).over(by_day), F.lit(0).cast("decimal(38,10)" if c == "p_total" else "bigint"))

        out += [
            within("p_n").alias(f"events_{p}d"),
            within("p_total").cast("double").alias(f"total_{p}d"),
            within("p_valued").alias(f"valued_{p}d"),
        ]
    wide = dense.select(*out)
    for p in periods:
        wide = wide.withColumn(f"average_{p}d", F.when(F.col(f"valued_{p}d") > 0, F.col(f"total_{p}d") / F.col(f"valued_{p}d"))).drop(f"valued_{p}d")
    return wide
