"""Writing each transaction once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen(df: DataFrame, written: DataFrame | None, transaction: str = "transaction_id") -> DataFrame:
    """The rows whose transaction hasn't been written, one for each; rows without one all pass."""
    with_id = df.where(F.col(transaction).isNotNull()).dropDuplicates([transaction])
    if written is not None:
        with_id = with_id.join(written.select(transaction).distinct(), transaction, "left_anti").select(*df.columns)
    return with_id.unionByName(df.where(F.col(transaction).isNull()))


def once(path: str, transaction: str = "transaction_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append each transaction's first row to the Parquet folder.

    Every batch goes to a folder of its own, which a repeated batch overwrites; so neither a repeated
    transaction nor a repeated batch writes rows twice.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        try:
            before = spark.read.option("basePath", path).parquet(f"{path}/batch=*").where(F.col("batch") < batch)
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            before = None
        unseen(df, before, transaction).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
