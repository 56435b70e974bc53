"""HTTP polling as a streaming data source: spark.readStream.format("http_poll")."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "url string, body string, key string, value string, ms bigint"


def at_path(body: object, path: str | None) -> object:
    """What `$.a.b` leads to in parsed JSON; None if nothing."""
    for name in (path or "$").removeprefix("$").strip(".").split("."):
        if not name:
            continue
        body = body.get(name) if isinstance(body, dict) else None
    return body


def as_text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


class HttpPoll(DataSource):
    """GET the urls in turn, one row per answer.

    Options: urls (comma-separated), timeout (seconds, 10), max_retries (3), retry_delay (seconds, 1),
    poll_interval (seconds between rounds, 1), value_path and key_path (`$.a.b` in the JSON answer),
    explode (true: one row for each item of an array), log_path (a file on the driver to which every answer is
    appended as a JSON line of value, timestamp and raw), header.NAME (request headers), polls (end after
    so many rounds; for tests). A url that can't be read after all retries is left out of that round.

    Polling can't be repeated: a round is held until it has been committed, so rows may come twice after
    a failure, but none is invented.
    """

    @classmethod
    def name(cls) -> str:
        return "http_poll"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return HttpReader(dict(self.options))


class HttpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u.strip() for u in options["urls"].split(",") if u.strip()]
        if not self.urls:
            raise ValueError("http_poll needs urls")
        self.timeout, self.retries = float(options.get("timeout", 10)), int(options.get("max_retries", 3))
        self.delay, self.interval = float(options.get("retry_delay", 1)), float(options.get("poll_interval", 1))
        self.value_path, self.key_path = options.get("value_path"), options.get("key_path")
        self.explode, self.polls = options.get("explode", "false") == "true", int(options.get("polls", 0))
        self.headers = {k.split(".", 1)[1]: v for k, v in options.items() if k.startswith("header.")}
        self.log_path = options.get("log_path")
        self.held: dict[int, list[tuple]] = {}
        self.last = 0.0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": 0}

    def get(self, url: str) -> str | None:
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as answer:
                    return answer.read().decode("utf-8", "replace")
            except OSError:
                if attempt < self.retries:
                    time.sleep(self.delay)
        return None

    def rows(self, url: str, body: str) -> Iterator[tuple]:
        now = int(time.time() * 1000)
        try:
            parsed = json.loads(body)
        except ValueError:
            yield url, body, None, body, now
            return
        for item in parsed if self.explode and isinstance(parsed, list) else [parsed]:
            yield url, body, as_text(at_path(item, self.key_path)) if self.key_path else None, as_text(at_path(item, self.value_path)), now

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["round"]
        if self.polls and n >= self.polls:
            return iter([]), start
        if n not in self.held:
            if n:
                time.sleep(max(0.0, self.last + self.interval - time.time()))
            self.held[n] = [r for u in self.urls if (body := self.get(u)) is not None for r in self.rows(u, body)]
            self.last = time.time()
            if self.log_path:
                with open(self.log_path, "a", encoding="utf-8") as log:
                    log.writelines(json.dumps({"value": v, "timestamp": ms, "raw": raw}, ensure_ascii=False) + "\n" for _, raw, _, v, ms in self.held[n])
        return iter(self.held[n]), {"round": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([r for n in range(start["round"], end["round"]) for r in self.held.get(n, [])])

    def commit(self, end: dict) -> None:
        for n in [n for n in self.held if n < end["round"]]:
            del self.held[n]


#: Options for sources of prices: where symbol and price stand.
PRICE_ORACLE = {"value_path": "$.price", "key_path": "$.symbol"}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpPoll)
