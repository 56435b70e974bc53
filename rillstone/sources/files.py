"""Files of JSON lines, CSV, text or Parquet as bounded or unbounded events."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.scalar import trim
from rillstone.sources import tail

FORMATS = ("json", "csv", "text", "parquet")


def read_file(
    spark: SparkSession, path: str, fmt: str = "json", schema: str | None = None, follow: bool = False,
    key: str | None = None, event_time: str | None = None, header: bool = False, files_per_trigger: int | None = None, bytes_per_trigger: str | None = None,
) -> DataFrame:
    """The rows of a file or folder.

    json: one object per line; lines that can't be read are dropped. csv: columns field_0, field_1, ...
    as trimmed strings, or named by a header or schema. text: column value, trimmed, without blank
    lines. parquet: as it is. With follow the folder is read as a stream, new files as they come, or a single
    file of json or text, with the lines appended to it (see sources.tail); that needs a schema for json,
    csv and parquet. files_per_trigger and bytes_per_trigger bound a batch.

    `key` copies a column to `key`. `ts` is the column event_time (a timestamp, or a number of epoch ms),
    or the time of reading.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; there are {', '.join(FORMATS)}")
    if follow and schema is None and fmt != "text":
        raise ValueError(f"following {fmt} files needs a schema")
    if follow and os.path.isfile(path) and fmt in ("json", "text"):
        tail.register(spark)
        lines = spark.readStream.format("tail_file").option("path", path)
        lines = (lines.option("bytes_per_batch", bytes_per_trigger) if bytes_per_trigger else lines).load()
        if fmt == "text":
            df = lines.select(trim(F.col("value")).alias("value")).where("value <> ''")
        else:
            read = F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r")
            df = lines.where("trim(value) <> ''").select(read).where("r IS NOT NULL AND r.__bad IS NULL").select("r.*").drop("__bad")
        return _named(df, key, event_time)
    reader = spark.readStream if follow else spark.read
    if files_per_trigger and follow:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger and follow:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if schema and fmt != "text":
        reader = reader.schema(schema)
    if fmt == "json":
        df = reader.option("mode", "DROPMALFORMED").json(path)
    elif fmt == "csv":
        df = reader.option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
        if schema is None and not header:
            df = df.toDF(*[f"field_{i}" for i in range(len(df.columns))])
    elif fmt == "text":
        df = reader.text(path).select(trim(F.col("value")).alias("value")).where("value <> ''")
    else:
        df = reader.parquet(path)
    return _named(df, key, event_time)


def _named(df: DataFrame, key: str | None, event_time: str | None) -> DataFrame:
    if key:
        df = df.withColumn("key", F.col(key).cast("string"))
    if event_time is None:
        return df if "ts" in df.columns else df.withColumn("ts", F.current_timestamp())
    numeric = dict(df.dtypes)[event_time] in ("bigint", "int", "double", "float")
    return df.withColumn("ts", F.timestamp_millis(F.col(event_time).cast("bigint")) if numeric else F.col(event_time).cast("timestamp"))
