"""What running queries do: rates and delays, and the batches of a checkpoint."""

from __future__ import annotations

import json
import threading
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent


class QueryMetrics(StreamingQueryListener):
    """Rows, batches, rate, time and watermark per query; spark.streams.addListener(metrics)."""

    def __init__(self) -> None:
        self.queries: dict[str, dict[str, float]] = {}
        self.names: dict[str, str] = {}  # of runs
        self.lock = threading.Lock()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        with self.lock:
            self._of(event.name, event.id, event.runId)["active"] = 1

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        with self.lock:
            q = self._of(p.name, p.id, p.runId)
            q["rows"] += p.numInputRows
            q["batches"] += 1
            q["busy_ms"] += p.batchDuration
            q["rows_per_second"] = p.processedRowsPerSecond
            if mark := dict(p.eventTime or {}).get("watermark"):
                q["watermark_ms"] = datetime.fromisoformat(mark.replace("Z", "+00:00")).timestamp() * 1000

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        with self.lock:
            if (name := self.names.pop(str(event.runId), None)) is not None:
                self.queries[name]["active"] = 0

    def _of(self, name: str | None, query: object, run: object) -> dict[str, float]:
        at = self.names[str(run)] = name or str(query)
        return self.queries.setdefault(at, {"rows": 0, "batches": 0, "busy_ms": 0, "rows_per_second": 0.0, "active": 1})

    def as_json(self) -> str:
        with self.lock:
            return json.dumps(self.queries, sort_keys=True)

    def text(self, prefix: str = "rillstone") -> str:
        """In Prometheus' text format."""
        with self.lock:
            names = sorted({n for q in self.queries.values() for n in q})
            return "".join(
                f"# TYPE {prefix}_query_{n} gauge\n" + "".join(f'{prefix}_query_{n}{{query="{name}"}} {q[n]:.15g}\n' for name, q in sorted(self.queries.items()) if n in q) for n in names
            )


def batches(spark: SparkSession, checkpoint: str) -> list[int]:
    """The committed batches of a checkpoint, the latest first; none if there is no checkpoint."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [PurePosixPath(str(f.getPath())).name for f in fs.listStatus(at)]
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def rewind(spark: SparkSession, checkpoint: str, batch: int) -> list[int]:
    """Take a checkpoint back to a committed batch: a query started from it goes on after that one. The batches taken back.

    Its state must still be kept (spark.sql.streaming.minBatchesToRetain), and its sink must take batches again
    (foreachBatch; file sinks leave out batches that they have written).
    """
    if batch not in (known := batches(spark, checkpoint)):
        raise ValueError(f"there is no batch {batch}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for log in ("commits", "offsets"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{log}")
        fs = folder.getFileSystem(conf)
        for f in fs.listStatus(folder):
            name = PurePosixPath(str(f.getPath())).name
            if name.isdigit() and int(name) > batch:
                fs.delete(f.getPath(), False)
    return [b for b in known if b > batch]


def forget(spark: SparkSession, checkpoint: str) -> bool:
    """Delete a checkpoint: the query begins anew. Whether there was one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(checkpoint)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
