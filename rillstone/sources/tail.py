"""A growing file as a streaming data source: spark.readStream.format("tail_file")."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class TailFile(DataSource):
    """The lines of a file, and those that are appended later: column value.

    Options: path, bytes_per_batch (8 MB), from_end (true: only what comes later). Only whole lines are read; one
    longer than a batch makes the batch longer. A file that gets shorter was begun anew and is read from its
    start. Batches can be read again from their offsets, so no line is lost or doubled after a failure.
    """

    @classmethod
    def name(cls) -> str:
        return "tail_file"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return TailReader(dict(self.options))


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("bytes_per_batch", 8 << 20))
        self.from_end = options.get("from_end", "false") == "true"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": os.path.getsize(self.path) if self.from_end and os.path.exists(self.path) else 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["at"]
        if not os.path.exists(self.path):
            return iter([]), start
        if os.path.getsize(self.path) < at:
            at = 0
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(self.size)
            while data and b"\n" not in data and (more := f.read(self.size)):
                data += more
        end = data.rfind(b"\n") + 1
        return self._lines(data[:end]), {"at": at + end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        first = start["at"] if start["at"] <= end["at"] else 0
        with open(self.path, "rb") as f:
            f.seek(first)
            return self._lines(f.read(end["at"] - first))

    @staticmethod
    def _lines(data: bytes) -> Iterator[tuple]:
        return iter([(x.decode("utf-8", "replace").rstrip("\r"),) for x in data.split(b"\n")[:-1]])

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailFile)
