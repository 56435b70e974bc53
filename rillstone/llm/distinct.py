"""Distinct counts from log-log registers that can be merged."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers per group: 2^12. The standard error of an estimate is 1.04 / sqrt(2^12) = 1.63 %.
PRECISION = 12


def registers(df: DataFrame, item: Column, groups: dict[str, Column], precision: int = PRECISION) -> DataFrame:
    """The partial result: one row per group: the group columns and `sketch`, the group's registers packed.

    Each item's hash picks one of 2^precision registers, which keeps the largest rank (leading zeros of
    the other bits, plus 1). A group of few items holds only the registers in use, so it takes some bytes
    per item, and no group more than about 2^precision bytes. Rows are combined where they lie before
    anything moves.

    A NULL item takes no part; group columns may be NULL. An item that occurs again changes nothing,
    so redelivered records need no care. Other columns of df are ignored whatever their names.
    """
    assert 4 <= precision <= 21
    rows = df.select(*[c.alias(name) for name, c in groups.items()], item.cast("string").alias("__item")).where("__item IS NOT NULL")
    return rows.groupBy(*groups).agg(F.hll_sketch_agg("__item", F.lit(precision)).alias("sketch"))


def merged(*parts: DataFrame) -> DataFrame:
    """Partial results of other days or partitions put together: the maximum of each register."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return _merged_by(both, [c for c in both.columns if c != "sketch"])


def _merged_by(part: DataFrame, names: list[str]) -> DataFrame:
    # without group columns, no rows give no group
    return part.groupBy(*(names or [F.lit(1).alias("__all")])).agg(F.hll_union_agg("sketch").alias("sketch")).select(*names, "sketch")


def rolled_up(part: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Registers for other sets of groups than those they were kept for, merged by maximum.

    A column that isn't in a set is NULL there, and `grouping` names the set. A row whose own value of a
    column in the set is NULL takes no part in that set.

    Each set is merged from the smallest set with its columns that is there already, or else from `part`;
    of several with as few columns, from the one named last in `sets`. So `part` is best a stored table.
    """
    names = [c for c in part.columns if c != "sketch"]
    kinds = dict(part.dtypes)
    made: dict[tuple[str, ...], DataFrame] = {tuple(names): part}
    out = None
    for s in sorted(sets, key=len, reverse=True):
        if s not in made or set(s) != set(names):
            parents = [p for p in made if set(s) < set(p)]
            if parents:
                fewest = min(map(len, parents))
                made[s] = _merged_by(made[[p for p in parents if len(p) == fewest][-1]], list(s))
        rows = made[s]
        for c in s:
            rows = rows.where(F.col(c).isNotNull())
        labelled = rows.select(F.lit("+".join(s) or "all").alias("grouping"), *[(F.col(c) if c in s else F.lit(None).cast(kinds[c])).alias(c) for c in names], "sketch")
        out = labelled if out is None else out.unionByName(labelled)
    return out


def estimates(part: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Per group: distinct (the estimate), standard_error (relative), lower and upper (two standard errors).

    The estimate comes from the registers alone, so it doesn't depend on the order of the items or on
    how partial results were put together. It has no bias, and small groups are all but exact.
    """
    names = [c for c in part.columns if c != "sketch"]
    # a sketch merged with itself has the same registers, but nothing that depends on the order of its items
    value = F.hll_sketch_estimate(F.hll_union("sketch", "sketch"))
    error = 1.04 / math.sqrt(1 << precision)
    return part.select(*names, value.alias("distinct")).select(
        *names,
        "distinct",
        F.lit(error).alias("standard_error"),
        F.floor(F.col("distinct") * (1 - 2 * error)).cast("bigint").alias("lower"),
        F.ceil(F.col("distinct") * (1 + 2 * error)).cast("bigint").alias("upper"),
    )
