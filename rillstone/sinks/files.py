"""Writing rows to folders of JSON, CSV, text or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FORMATS = ("json", "csv", "text", "parquet")


def _shaped(df: DataFrame, fmt: str) -> DataFrame:
    if fmt != "text":
        return df
    if "value" in df.columns:
        return df.select(F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("value"))
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write(df: DataFrame, path: str, fmt: str = "json", append: bool = True) -> None:
    """Bounded rows; without append the folder is replaced. csv has a header."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; there are {', '.join(FORMATS)}")
    w = _shaped(df, fmt).write.mode("append" if append else "overwrite").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(path)


def start(df: DataFrame, path: str, checkpoint: str, fmt: str = "json", every: str | None = None) -> StreamingQuery:
    """A stream; every batch is written once, also after a restart from the checkpoint. Without `every` what there is, then it ends."""
    w = _shaped(df, fmt).writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    w = w.option("header", True) if fmt == "csv" else w
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
