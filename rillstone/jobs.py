"""Job files: a source, filters and projections, a query, a sink; run once or kept running."""

from __future__ import annotations

import json
import os
import time
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rillstone.plans import dialect
from rillstone.sinks import files as file_sink
from rillstone.sinks.metrics import PREFIXES, Metrics, serve
from rillstone.sources import http
from rillstone.sources.files import read_file
from rillstone.streaming.run import supervised


class JobError(ValueError):
    """A job that can't be run as it is written."""


@dataclass
class Job:
    """name; source {type: file | http, ...}; operators [{type: filter | map, expr}]; sql over the stream named by `stream`; sink {type: file | metrics (port: to serve them), ...}."""

    name: str
    source: dict
    sink: dict
    operators: list[dict] = field(default_factory=list)
    sql: str | None = None
    stream: str = "events"
    parallelism: int = 8
    batch_size: int = 1000
    buffer_size: int = 1000
    checkpoint: str | None = None
    watermark: str | None = None

    def problems(self) -> list[str]:
        out = []
        if not self.name:
            out.append("a job needs a name")
        for n in ("parallelism", "batch_size", "buffer_size"):
            if not isinstance(getattr(self, n), int) or getattr(self, n) <= 0:
                out.append(f"{n} must be a positive number")
        if self.source.get("type") not in ("file", "http"):
            out.append("source.type is file or http")
        elif self.source["type"] == "file" and not self.source.get("path"):
            out.append("a file source needs a path")
        elif self.source["type"] == "http" and not self.source.get("urls"):
            out.append("an http source needs urls")
        if self.sink.get("type") not in ("file", "metrics"):
            out.append("sink.type is file or metrics")
        elif self.sink["type"] == "file" and not self.sink.get("path"):
            out.append("a file sink needs a path")
        out += [f"operator {o.get('type')!r} isn't filter or map" for o in self.operators if o.get("type") not in ("filter", "map")]
        out += ["an operator needs expr" for o in self.operators if not o.get("expr")]
        if self.sql:
            try:
                dialect.parts(self.sql)
            except dialect.DialectError as e:
                out.append(f"sql: {e}")
        if self.unbounded and self.sink.get("type") == "file" and not self.checkpoint:
            out.append("a job that keeps running needs a checkpoint")
        return out

    # building
    def changed(self, **settings: object) -> Job:
        """The job with other settings."""
        return replace(self, **settings)

    def filter(self, expr: str) -> Job:
        return replace(self, operators=[*self.operators, {"type": "filter", "expr": expr}])

    def map(self, expr: str) -> Job:
        return replace(self, operators=[*self.operators, {"type": "map", "expr": expr}])

    @property
    def unbounded(self) -> bool:
        return self.source.get("type") == "http" or bool(self.source.get("follow"))

    def checked(self) -> Job:
        if found := self.problems():
            raise JobError("; ".join(found))
        return self

    @classmethod
    def from_dict(cls, d: dict) -> Job:
        known = set(cls.__dataclass_fields__)
        if extra := set(d) - known:
            raise JobError(f"unknown settings: {', '.join(sorted(extra))}")
        if missing := {"name", "source", "sink"} - set(d):
            raise JobError(f"missing settings: {', '.join(sorted(missing))}")
        return cls(**d)

    @classmethod
    def from_file(cls, path: str) -> Job:
        """TOML or JSON. RILLSTONE_PARALLELISM and RILLSTONE_BATCH_SIZE in the environment have precedence."""
        raw = Path(path).read_text()
        d = json.loads(raw) if path.endswith(".json") else tomllib.loads(raw)
        for n in ("parallelism", "batch_size"):
            if v := os.environ.get(f"RILLSTONE_{n.upper()}"):
                d[n] = int(v)
        return cls.from_dict(d)

    def to_file(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    # running
    def read(self, spark: SparkSession) -> DataFrame:
        s = {k: v for k, v in self.source.items() if k != "type"}
        if self.source["type"] == "file":
            names = {"path": "path", "format": "fmt", "schema": "schema", "follow": "follow", "key": "key", "event_time": "event_time", "header": "header", "files_per_trigger": "files_per_trigger", "bytes_per_trigger": "bytes_per_trigger"}
            if extra := set(s) - set(names):
                raise JobError(f"unknown settings of a file source: {', '.join(sorted(extra))}")
            return read_file(spark, **{names[k]: v for k, v in s.items()})
        http.register(spark)
        urls = s.pop("urls")
        if preset := s.pop("preset", None):
            if preset != "price_oracle":
                raise JobError(f"unknown preset {preset!r}")
            s = http.PRICE_ORACLE | s
        reader = spark.readStream.format("http_poll").option("urls", urls if isinstance(urls, str) else ",".join(urls))
        for k, v in s.items():
            reader = reader.option(k, v)
        return reader.load().selectExpr("*", "timestamp_millis(ms) AS ts")

    def plan(self, spark: SparkSession) -> DataFrame:
        df = self.read(spark)
        for o in self.operators:
            df = df.where(o["expr"]) if o["type"] == "filter" else df.selectExpr("*", o["expr"])
        if df.isStreaming and self.watermark:
            df = df.withWatermark("ts", self.watermark)
        return dialect.run(spark, self.sql, **{self.stream: df}) if self.sql else df

    def run(self, spark: SparkSession, metrics: Metrics | None = None, restarts: int = 0, delay: float = 5.0, stopped: Callable[[], bool] | None = None) -> Metrics | None:
        """Run to the end (bounded sources), or until the query ends or `stopped` says so; failures restart it from its checkpoint.

        A metrics sink with a port serves /metrics and /health on the driver while the job runs.
        """
        self.checked()
        spark.conf.set("spark.sql.shuffle.partitions", self.parallelism)
        df = self.plan(spark)
        if self.sink["type"] == "metrics":
            name = self.sink.get("preset")
            metrics = metrics or Metrics(self.sink.get("prefix") or PREFIXES.get(name, name or "rillstone"))
        server = serve(metrics, self.sink["port"]) if metrics is not None and "port" in self.sink else None
        try:
            return self._run(spark, df, metrics, restarts, delay, stopped)
        finally:
            if server is not None:
                server.shutdown()
                server.server_close()

    def _run(self, spark: SparkSession, df: DataFrame, metrics: Metrics | None, restarts: int, delay: float, stopped: Callable[[], bool] | None) -> Metrics | None:
        if not df.isStreaming:
            if self.sink["type"] == "metrics":
                metrics.update(df)
            else:
                file_sink.write(df, self.sink["path"], self.sink.get("format", "json"), self.sink.get("append", True))
            return metrics

        def begin():  # noqa: ANN202
            if self.sink["type"] == "file":
                return file_sink.start(self.plan(spark), self.sink["path"], self.checkpoint, self.sink.get("format", "json"), self.sink.get("every"))
            w = self.plan(spark).writeStream.foreachBatch(metrics.update).outputMode(self.sink.get("mode", "append"))
            w = w.option("checkpointLocation", self.checkpoint) if self.checkpoint else w
            return (w.trigger(processingTime=self.sink["every"]) if self.sink.get("every") else w.trigger(availableNow=True)).start()

        supervised(begin, restarts, delay, stopped)
        return metrics


STATES = ("queued", "running", "completed", "failed", "stopped")


class Registry:
    """The jobs that were submitted, one JSON file each in a folder."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def submit(self, job: Job) -> str:
        job.checked()
        if any(j["name"] == job.name and j["state"] == "running" for j in self.list()):
            raise JobError(f"a job {job.name!r} is running")
        at = uuid.uuid4().hex[:12]
        self._keep({"id": at, "name": job.name, "state": "queued", "submitted": time.time(), "job": asdict(job)})
        return at

    def _keep(self, entry: dict) -> None:
        part = self.folder / f".{entry['id']}.part"
        part.write_text(json.dumps(entry))
        part.replace(self.folder / f"{entry['id']}.json")

    def get(self, at: str) -> dict:
        path = self.folder / f"{at}.json"
        if not path.exists():
            raise JobError(f"no job {at}")
        return json.loads(path.read_text())

    def list(self) -> list[dict]:
        return sorted((json.loads(p.read_text()) for p in self.folder.glob("*.json")), key=lambda j: j["submitted"])

    def move(self, at: str, state: str, **more: object) -> dict:
        if state not in STATES:
            raise JobError(f"unknown state {state!r}")
        entry = self.get(at) | {"state": state, "changed": time.time()} | more
        self._keep(entry)
        return entry

    def run(self, at: str, spark: SparkSession, work: Callable[[Job], object] | None = None, restarts: int = 0) -> dict:
        job = Job.from_dict(self.get(at)["job"])
        self.move(at, "running")
        try:
            (work or (lambda j: j.run(spark, restarts=restarts, stopped=lambda: self.get(at)["state"] == "stopped")))(job)
        except Exception as e:
            return self.move(at, "failed", error=str(e)[:2000])
        return self.get(at) if self.get(at)["state"] == "stopped" else self.move(at, "completed")

    def stop(self, at: str) -> dict:
        """Mark a job as stopped; the process that runs it looks for that every second and ends the query."""
        if self.get(at)["state"] not in ("queued", "running"):
            raise JobError(f"job {at} isn't running")
        return self.move(at, "stopped")
