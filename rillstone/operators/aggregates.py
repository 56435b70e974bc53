"""The aggregates of the event dialect."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from rillstone.operators.ranks import running

#: By name; each takes a column (count also none).
AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": lambda c=None: F.count(F.lit(1)) if c is None else F.count(c),
    "sum": lambda c: F.sum(c),
    "avg": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "median": lambda c: F.median(c),
}


def aggregate(name: str, column: Column | None = None, empty_as_zero: bool = False) -> Column:
    """One of the six; with empty_as_zero a sum or average of nothing is 0.0 instead of NULL."""
    fn = AGGREGATES.get(name.lower())
    if fn is None:
        raise ValueError(f"unknown aggregate {name!r}; there are {', '.join(AGGREGATES)}")
    out = fn() if column is None and name.lower() == "count" else fn(column)
    return F.coalesce(out.cast("double"), F.lit(0.0)) if empty_as_zero and name.lower() in ("sum", "avg") else out


def percentile_at_index(df: DataFrame, keys: list[str], column: str, at: dict[str, float]) -> DataFrame:
    """Per group and name in `at`: the value at index floor((n - 1) * p) of the group's sorted values.

    Values are counted first, so a group is as many rows as it has distinct values; the ranks are running
    sums over the sorted values, split over the tasks.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counted, keys, [column], F.col("__n"))
    sizes = upto.groupBy(*keys).agg(F.max("__upto").alias("__all")).select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], "__all")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    ranked = upto.join(sizes, same)
    index = lambda p: F.floor((F.col("__all") - 1) * F.lit(p))
    hit = lambda p: (index(p) < F.col("__upto")) & (index(p) >= F.col("__upto") - F.col("__n"))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(hit(p), F.col(column))).alias(name) for name, p in at.items()])


def custom(f: Callable[[pd.Series], Any], result: str) -> Callable[[Column], Column]:
    """An aggregate of one's own over a group's values as a pandas Series; it holds a group's values in memory.

    Use Accumulator and accumulated() for groups of any size.
    """
    return F.pandas_udf(f, result, PandasUDFType.GROUPED_AGG)


class Accumulator(Protocol):
    """An aggregate that can be worked out in parts. The state is any object that pickles."""

    def create(self) -> Any: ...

    def add(self, state: Any, values: pd.Series) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def result(self, state: Any) -> Any: ...


def accumulated(df: DataFrame, keys: list[str], value: str, acc: Accumulator, result: str) -> DataFrame:
    """Per group the result of an accumulator: states are made where the rows lie, and merged by group.

    Batches of a partition are added as they come, so a task holds one state per group it meets; groups
    move as states. NULL keys are a group; NULL values are passed to add as they are.
    """
    kinds = dict(df.dtypes)
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}
        for b in batches:
            for at, g in b.groupby(keys, dropna=False, sort=False):
                k = tuple(None if pd.isna(x) else x for x in at)
                states[k] = acc.add(states[k] if k in states else acc.create(), g[value])
        yield pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*keys, "__state"])

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        state = acc.create()
        for s in g["__state"]:
            state = acc.merge(state, pickle.loads(s))
        return g[keys].head(1).assign(result=[acc.result(state)])

    made = df.select(*keys, value).mapInPandas(parts, f"{key_schema}, __state binary")
    return made.groupBy(*keys).applyInPandas(whole, f"{key_schema}, result {result}")
