"""Running sums along an order, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.store import written


def running(df: DataFrame, keys: list[str], order: list[str], weight: Column | None = None, into: str = "__upto") -> DataFrame:
    """df with the sum of the weights (the number, without weight) of its row and those before it with the same keys.

    Rows are sorted by ranges over all tasks, so that a key with a large part of all rows, or no key at all,
    is spread over many; each range is summed up by itself, and on top of that comes the sum of the ranges
    before it, of which a key has as many as there are tasks. The ranges are written, as they must not
    change between the two steps. NULL keys are a key; rows of one order are numbered as they happen to come.
    """
    w = F.lit(1).cast("bigint") if weight is None else weight
    ranged = written(df.withColumn("__w", w).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("__w").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranged.withColumn("__here", F.sum("__w").over(within)).join(parts, same).withColumn(into, F.col("__before") + F.col("__here")).select(*df.columns, into)
