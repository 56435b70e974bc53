"""Tables of a data folder, and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors reach.

    Only a session on one machine may go without (tests): a temporary folder is then made, and removed at the
    end. On a cluster it is an error, as executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("rillstone.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="rillstone-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("rillstone.shared.dir", found)
    return found


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage, survives the loss of an executor, keeps column pruning, and, unlike a
    cache, is not computed again for every reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillstone/{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)
