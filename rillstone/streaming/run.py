"""Running a streaming plan over what there is, and keeping one running."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillstone.store import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk instead of the heap; transformWithState needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """The output of a streaming plan over all that its sources hold now, written to the shared folder and read again."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/rillstone/{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    else:
        schema = df.schema
        spark.createDataFrame([], schema).write.parquet(f"{at}/out")

        def keep(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}" if mode == "update" else f"{at}/out/batch=0")

        q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    reader = spark.read.schema(df.schema)
    return reader.option("recursiveFileLookup", True).parquet(f"{at}/out")


def supervised(begin: Callable[[], StreamingQuery], max_restarts: int = 3, delay: float = 5.0, stopped: Callable[[], bool] | None = None, poll: float = 1.0) -> int:
    """Run a query to its end; after a failure begin it anew from its checkpoint. Returns the number of restarts.

    `stopped` is asked every `poll` seconds; once it says so, the query is stopped after the batch that is running.
    """
    restarts = 0
    while True:
        try:
            query = begin()
            if stopped is None:
                query.awaitTermination()
                return restarts
            while not query.awaitTermination(poll):
                if stopped():
                    query.stop()
            return restarts
        except Exception:
            if restarts >= max_restarts:
                raise
            restarts += 1
            time.sleep(delay)
