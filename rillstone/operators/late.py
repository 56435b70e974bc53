"""Windows of event time over out-of-order events: panes, corrections, cut-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.cleaning import one_per_id

#: Defaults of the event-time configuration, in ms.
ALLOWED_LATENESS = 0
MAX_OUT_OF_ORDERNESS = 1000
#: Times beyond this, in ms, aren't taken for times.
FARTHEST = 1 << 60


def with_watermark(df: DataFrame, seq_block_bits: int = 16) -> DataFrame:
    """df(key, seq, ms, ...) with `seen`: the largest ms of the key's records that arrived before.

    A running maximum, taken within blocks of 2^bits arrivals and then over the maxima of the blocks
    before, so that a key with a third of all records is split over many tasks.
    """
    blocks = df.withColumn("block", F.shiftright("seq", seq_block_bits))
    before = Window.partitionBy("key", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = blocks.withColumn("seen_here", F.max("ms").over(before))
    of_blocks = blocks.groupBy("key", "block").agg(F.max("ms").alias("top"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = of_blocks.select("key", "block", F.max("top").over(earlier).alias("seen_earlier"))
    return within.join(tops, ["key", "block"]).withColumn("seen", F.greatest("seen_here", "seen_earlier")).drop("block", "seen_here", "seen_earlier")


def classified(events: DataFrame, configs: DataFrame, seq_block_bits: int = 16) -> DataFrame:
    """First arrivals of each record with their watermark and pane.

    events: event_id, key, value, ms, arrival_seq. configs: key (unique), window_ms, allowed_lateness,
    max_out_of_orderness and optionally slide_ms (NULL or missing: tumbling windows).
    A record with NULL key, ms or arrival_seq, with ms beyond +-2^60, or of a key without a positive
    window_ms, takes no part; one with NULL value does.
    """
    slide = F.col("slide_ms").cast("bigint") if "slide_ms" in configs.columns else F.lit(None).cast("bigint")
    c = configs.select(
        F.col("key").alias("c_key"),
        F.col("window_ms").cast("bigint").alias("window_ms"),
        F.coalesce(slide, F.col("window_ms").cast("bigint")).alias("slide_ms"),
        F.coalesce(F.col("allowed_lateness"), F.lit(ALLOWED_LATENESS)).cast("bigint").alias("lateness"),
        F.coalesce(F.col("max_out_of_orderness"), F.lit(MAX_OUT_OF_ORDERNESS)).cast("bigint").alias("disorder"),
    ).where("c_key IS NOT NULL AND window_ms > 0 AND slide_ms > 0")
    rows = events.select("event_id", F.col("arrival_seq").cast("bigint").alias("seq"), "key", F.col("ms").cast("bigint").alias("ms"), F.col("value").cast("bigint").alias("value"))
    rows = one_per_id(rows.where((F.col("key").isNotNull()) & F.col("ms").between(-FARTHEST, FARTHEST) & F.col("seq").isNotNull()), "event_id", ["seq"])
    seen = with_watermark(rows, seq_block_bits)
    joined = seen.join(c, seen["key"] == c["c_key"]).drop("c_key")
    ms, wide, step = F.col("ms"), F.col("window_ms"), F.col("slide_ms")
    # windows start at multiples of slide; the first that can hold ms starts after ms - window
    low = ms - wide + 1
    # panes lie between the starts and ends of windows: at most two to a slide
    into, cut = F.pmod(ms, step), F.pmod(wide, step)
    return joined.select(
        "event_id", "seq", "key", "ms", "value", "window_ms", "slide_ms", "lateness",
        (F.col("seen") - F.col("disorder")).alias("watermark"),
        (ms - into + F.when(into >= cut, cut).otherwise(0)).alias("pane"),
        (low + F.pmod(-low, step)).alias("first_start"),
        (ms - F.pmod(ms, step)).alias("last_start"),
    )


def _covering() -> Column:
    return F.expr("CASE WHEN first_start <= last_start THEN sequence(first_start, last_start, slide_ms) ELSE array() END")


def late_records(records: DataFrame) -> DataFrame:
    """Of classified records: each late record and window: event_id, key, seq, value, window_start, window_end, outcome.

    corrected: the window has been emitted (watermark >= end) and is emitted again; dropped: the
    watermark is beyond the cut-off (> end + lateness); ontime: only where windows overlap, for those
    that are still to be emitted.
    """
    late = records.where(F.col("watermark") >= F.col("first_start") + F.col("window_ms"))
    each = late.withColumn("window_start", F.explode(_covering())).withColumn("window_end", F.col("window_start") + F.col("window_ms"))
    wm = F.col("watermark")
    outcome = F.when(wm > F.col("window_end") + F.col("lateness"), "dropped").when(wm >= F.col("window_end"), "corrected").otherwise("ontime")
    return each.select("event_id", "key", "seq", "value", "window_start", "window_end", outcome.alias("outcome"))


def window_emissions(records: DataFrame) -> DataFrame:
    """Every emission of every window: key, window_start, window_end, revision, n, n_values, total, average, dropped.

    Records on time go into panes, non-overlapping stretches between window borders; a window is put
    together from the panes it covers (revision 0). A late record within the cut-off changes its pane,
    and each emitted window over that pane is emitted again with the next revision. `dropped` is the
    number of records lost to the window. A window that only got records after its end has its first
    emission at revision 1; one that got only dropped records has none.
    """
    ontime = records.where(F.col("watermark").isNull() | (F.col("watermark") < F.col("first_start") + F.col("window_ms")))
    panes = ontime.groupBy("key", "pane", "window_ms", "slide_ms", "first_start", "last_start").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("nv"), F.sum("value").alias("s"))
    from_panes = panes.select("key", F.explode(_covering()).alias("window_start"), "window_ms", "n", "nv", "s").select(
        "key", "window_start", (F.col("window_start") + F.col("window_ms")).alias("window_end"), "n", "nv", "s", F.lit(0).cast("bigint").alias("lost"), F.lit(None).cast("bigint").alias("seq")
    )
    late = late_records(records)
    drop, live = F.col("outcome") == "dropped", F.col("outcome") != "dropped"
    from_late = late.select(
        "key", "window_start", "window_end",
        live.cast("bigint").alias("n"), (live & F.col("value").isNotNull()).cast("bigint").alias("nv"), F.when(live, F.col("value")).alias("s"),
        drop.cast("bigint").alias("lost"), F.when(F.col("outcome") == "corrected", F.col("seq")).alias("seq"),
    )
    # first what came in time, then one step for each correction
    steps = from_panes.unionByName(from_late).groupBy("key", "window_start", "window_end", "seq").agg(F.sum("n").alias("n"), F.sum("nv").alias("nv"), F.sum("s").alias("s"), F.sum("lost").alias("lost"))
    w = Window.partitionBy("key", "window_start", "window_end")
    order = w.orderBy(F.col("seq").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(
        "key", "window_start", "window_end",
        F.sum(F.col("seq").isNotNull().cast("bigint")).over(upto).alias("revision"),
        F.sum("n").over(upto).alias("n"),
        F.sum("nv").over(upto).alias("n_values"),
        F.sum("s").over(upto).alias("total"),
        F.sum("lost").over(w).alias("dropped"),
    ).where("n > 0").withColumn("average", F.when(F.col("n_values") > 0, F.col("total") / F.col("n_values")))


def windows(records: DataFrame) -> DataFrame:
    """The last emission of each window; `corrections` is the number of times that it was corrected.

    Every record goes once to its pane or, if late, to the windows over it; both are summed up where they
    lie, and panes then go into their windows.
    """
    mark, end = F.col("watermark"), lambda start: start + F.col("window_ms")
    late = F.coalesce(mark >= end(F.col("first_start")), F.lit(False))

    def told(start: Column) -> Column:
        outcome = F.when(mark > end(start) + F.col("lateness"), 2).when(mark >= end(start), 1).otherwise(0)
        return F.struct(start.alias("start"), outcome.alias("outcome"))

    to = F.when(late, F.transform(_covering(), told)).otherwise(F.array(F.struct(F.col("pane").alias("start"), F.lit(0).alias("outcome"))))
    each = records.select("key", "value", "window_ms", "slide_ms", late.alias("late"), *[F.when(~late, F.col(c)).alias(c) for c in ("first_start", "last_start")], F.explode(to).alias("at"))
    lost = F.col("at.outcome") == 2
    sums = each.groupBy("key", "window_ms", "slide_ms", "late", "first_start", "last_start", F.col("at.start").alias("start")).agg(
        F.count_if(~lost).alias("n"), F.count(F.when(~lost, F.col("value"))).alias("n_values"), F.sum(F.when(~lost, F.col("value"))).alias("total"),
        F.count_if(F.col("at.outcome") == 1).alias("corrections"), F.count_if(lost).alias("dropped"),
    )
    start = F.explode(F.when(F.col("late"), F.array("start")).otherwise(_covering())).alias("window_start")
    whole = sums.select("key", start, "window_ms", "n", "n_values", "total", "corrections", "dropped").groupBy("key", "window_start", (F.col("window_start") + F.col("window_ms")).alias("window_end"))
    out = whole.agg(*[F.sum(c).alias(c) for c in ("corrections", "n", "n_values", "total", "dropped")]).where("n > 0")
    return out.withColumn("average", F.when(F.col("n_values") > 0, F.col("total") / F.col("n_values")))
