"""Percentiles per group by bisection over counts that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.store import written

#: Parts into which an interval is cut in a pass; 2 would be plain bisection with six times the passes.
PARTS = 64
#: More passes than 64-bit keys can need.
MAX_PASSES = 16
#: Shares into which the rows of a group are cut where they meet its intervals.
SHARES = 16


def ordered_key(x: Column) -> Column:
    """A BIGINT that orders as the finite DOUBLE x does, one for each value: its exponent and mantissa.

    -0.0 and 0.0 have one key. The next larger DOUBLE has the next larger key.
    """
    a = F.abs(x)
    least = F.lit(-1022)
    guess = F.greatest(F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1e-320)))), least)
    guess = F.least(guess, F.lit(1023))
    m = a / F.pow(F.lit(2.0), guess)
    e = F.when(m >= 2, guess + 1).when((m < 1) & (guess > least), guess - 1).otherwise(guess)
    size = (e + 1022).cast("bigint") * (1 << 52) + (a / F.pow(F.lit(2.0), e) * float(1 << 52)).cast("bigint")
    return F.when(x < 0, -size).otherwise(size)


def counts(df: DataFrame, value: Column, groups: dict[str, Column], mantissa_bits: int = 52) -> DataFrame:
    """The partial result: one row per group and value: the group columns, key, value, n.

    With fewer than 52 mantissa bits, values whose keys share the leading bits are kept together under
    the smallest of them: a percentile is then at most 2^-mantissa_bits of its size too small, and a
    group holds at most 2^mantissa_bits rows for each power of two that its values span.

    NULL, NaN and infinite values take no part; group columns may be NULL.
    """
    v = value.cast("double")
    rows = df.select(*[c.alias(g) for g, c in groups.items()], v.alias("value")).where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    drop = 52 - mantissa_bits
    key = ordered_key(F.col("value"))
    cell = F.shiftleft(F.shiftright(key, drop), drop) if drop else key
    return rows.groupBy(*groups, cell.alias("key")).agg(F.min(F.col("value") + 0.0).alias("value"), F.count(F.lit(1)).alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """Partial results of other days or partitions put together: counts add up."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*[c for c in both.columns if c not in ("n", "value")]).agg(F.min("value").alias("value"), F.sum("n").alias("n"))


def rolled_up(part: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Partial results for other sets of groups; a column that isn't in a set is NULL there.

    A row whose own value of a column in the set is NULL takes no part in that set.
    """
    names = [c for c in part.columns if c not in ("key", "value", "n")]
    kinds = dict(part.dtypes)

    def of(s: tuple[str, ...]) -> Column:
        there = F.lit(True)
        for c in s:
            there = there & F.col(c).isNotNull()
        return F.when(there, F.struct(F.lit("+".join(s) or "all").alias("grouping"), *[(F.col(c) if c in s else F.lit(None).cast(kinds[c])).alias(c) for c in names]))

    each = part.select(F.explode(F.array(*[of(s) for s in sets])).alias("g"), "key", "value", "n").where("g IS NOT NULL")
    return each.groupBy("g", "key").agg(F.min("value").alias("value"), F.sum("n").alias("n")).select("g.*", "key", "value", "n")


def percentiles(part: DataFrame, at: tuple[float, ...] = (0.5,)) -> DataFrame:
    """The percentiles of each group of a partial result: the group columns, percentile, n, value.

    The percentile p of n values is the one at rank ceil(p * n), 1 at least. It is exact if the partial
    result is.

    For every group and percentile an interval of keys is held, with the number of rows below it. Each
    pass counts the group's rows below 63 dividing points of the interval and keeps the part with the
    target rank, until that holds one key; once most rows are outside all intervals, these are left behind. Rows are counted
    where they lie and combined before they move, and meet the intervals in shares, so a group with a
    large part of all rows is no burden. Only how many intervals are open, and the rows in them, comes to the driver. 64-bit
    keys need at most 12 passes. The passes run while the result is being asked for, not when it is read.
    """
    groups = [c for c in part.columns if c not in ("key", "value", "n")]
    share = F.pmod(F.xxhash64("key"), F.lit(SHARES)).cast("tinyint").alias("share")
    part = written(part.select("*", share))
    same = [*[F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups], F.col("a.share") == F.col("b.share"), F.col("a.key").between(F.col("b.lo"), F.col("b.hi"))]
    micro = F.explode(F.array(*[F.lit(round(p * 1_000_000)) for p in at])).alias("micro")
    whole = part.groupBy(*groups).agg(F.sum("n").alias("total"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("value").alias("found"), F.count(F.lit(1)).alias("rows"))
    state = whole.select(*groups, "total", "lo", "hi", "found", "rows", micro)
    need = F.expr("CAST(ceil(CAST(micro AS DECIMAL(10,0)) * total / 1000000BD) AS BIGINT)")
    state = written(state.withColumn("rank", F.greatest(need, F.lit(1).cast("bigint"))).withColumn("below", F.lit(0).cast("bigint")))
    done = state.where("lo = hi")
    held_rows = part.count()
    for _ in range(MAX_PASSES):
        open_ = state.where("lo < hi")
        intervals, rows = open_.agg(F.count(F.lit(1)), F.sum("rows")).first()
        if not intervals:
            break
        want = open_.withColumn("share", F.explode(F.array(*[F.lit(k).cast("tinyint") for k in range(SHARES)]))).alias("b")
        if 2 * rows < held_rows:  # else leaving rows behind costs more than it spares
            part, held_rows = written(part.alias("a").join(want, same, "left_semi")), rows
        inside = part.alias("a").join(want, same)
        nth = F.expr(f"CASE WHEN b.lo < 0 AND b.hi >= 0 THEN CASE WHEN a.key < 0 THEN 0L ELSE 1L END ELSE (a.key - b.lo) DIV ((b.hi - b.lo) DIV {PARTS} + 1) END")
        held = [*[F.col(f"b.{g}").alias(g) for g in groups], *[F.col(f"b.{c}").alias(c) for c in ("total", "micro", "rank", "below")]]
        cut = inside.groupBy(*held, nth.alias("nth")).agg(F.sum("a.n").alias("n"), F.min("a.key").alias("lo"), F.max("a.key").alias("hi"), F.min("a.value").alias("found"), F.count(F.lit(1)).alias("rows"))
        by = Window.partitionBy(*groups, "micro").orderBy("nth")
        upto = F.col("below") + F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        told = cut.withColumn("upto", upto).where("upto >= rank AND upto - n < rank")
        state = written(told.select(*groups, "total", "lo", "hi", "found", "rows", "micro", "rank", (F.col("upto") - F.col("n")).alias("below")))
        done = done.unionByName(state.where("lo = hi"))
    else:
        if not state.where("lo < hi").isEmpty():
            raise RuntimeError(f"intervals are still open after {MAX_PASSES} passes")
    return done.select(*groups, (F.col("micro") / 1_000_000).alias("percentile"), F.col("total").alias("n"), F.col("found").alias("value"))
