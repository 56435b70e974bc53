"""Results as metrics in Prometheus' text format."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, Row

#: Prefixes for known uses.
PREFIXES = {"ad_analytics": "ad", "price_oracle": "oracle"}
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _labels(row: Row, names: list[str]) -> str:
    def clean(v: object) -> str:
        text = str(v).lower() if isinstance(v, bool) else str(v)
        return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")

    pairs = [f'{n}="{clean(row[n])}"' for n in names if row[n] is not None]
    return "{" + ",".join(pairs) + "}" if pairs else ""


class Metrics:
    """Gauges from the numeric columns of result rows, with the string and boolean columns as labels.

    A column event_count also adds to the counter <prefix>_events_total. Rows are taken one at a time
    from the executors, at most `limit` a batch: metrics are for aggregates, and more series than that
    is an error rather than a burden to the driver.
    """

    def __init__(self, prefix: str, limit: int = 100_000):
        self.prefix, self.limit = prefix, limit
        self.gauges: dict[tuple[str, str], float] = {}
        self.counters: dict[str, float] = {}
        self.lock = threading.Lock()

    def update(self, df: DataFrame, _batch: int = 0) -> None:
        kinds = dict(df.dtypes)
        numbers = [c for c, k in kinds.items() if k.split("(")[0] in _NUMBERS]
        labels = [c for c, k in kinds.items() if k in ("string", "boolean")]
        for i, row in enumerate(df.toLocalIterator()):
            if i >= self.limit:
                raise ValueError(f"more than {self.limit} rows for metrics")
            at = _labels(row, labels)
            with self.lock:
                for c in numbers:
                    if row[c] is not None:
                        self.gauges[f"{self.prefix}_{c}", at] = float(row[c])
                        if c == "event_count":
                            self.counters[at] = self.counters.get(at, 0.0) + float(row[c])

    def lines(self) -> Iterator[str]:
        with self.lock:
            seen = None
            for (name, at), v in sorted(self.gauges.items()):
                if name != seen:
                    yield f"# TYPE {name} gauge"
                    seen = name
                yield f"{name}{at} {v:g}" if v != int(v) else f"{name}{at} {int(v)}"
            if self.counters:
                name = f"{self.prefix}_events_total"
                yield f"# TYPE {name} counter"
                for at, v in sorted(self.counters.items()):
                    yield f"{name}{at} {int(v)}"

    def text(self) -> str:
        return "".join(f"{x}\n" for x in self.lines())


def serve(metrics: Metrics, port: int = 0) -> ThreadingHTTPServer:
    """Serve /metrics and /health until shutdown() is called; port 0 takes any free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            body = {"/metrics": metrics.text, "/health": lambda: "ok\n"}.get(self.path)
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.end_headers()
            self.wfile.write((body() if body else "not found\n").encode())

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
