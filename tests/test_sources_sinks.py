import json
import threading
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from conftest import rows

from rillstone.sinks import files as sink
from rillstone.sinks.metrics import Metrics, serve
from rillstone.sinks.once import once, unseen
from rillstone.sources import tail
from rillstone.sources.files import read_file
from rillstone.sources.http import HttpReader, at_path, register
from rillstone.streaming.run import drained, supervised


def test_files(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"key": "k", "ms": 1500, "v": 1}\nnot json\n{"key": null, "ms": null, "v": 2}\n')
    df = read_file(spark, str(p), schema="key string, ms bigint, v int", event_time="ms").where("v IS NOT NULL")
    assert rows(df.selectExpr("key", "v", "unix_millis(ts)")) == [("k", 1, 1500), (None, 2, None)]
    p = tmp_path / "a.csv"
    p.write_text("a, 1 ,x\nb,2,\n")
    df = read_file(spark, str(p), "csv", key="field_0")
    assert rows(df.drop("ts")) == [("a", "1", "x", "a"), ("b", "2", None, "b")]
    p = tmp_path / "a.txt"
    p.write_text("  one \n\n \t\ntwo\n")
    assert rows(read_file(spark, str(p), "text").select("value")) == [("one",), ("two",)]
    with pytest.raises(ValueError):
        read_file(spark, str(p), "xml")
    with pytest.raises(ValueError):
        read_file(spark, str(tmp_path), "json", follow=True)


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_write_and_read_again(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1), ("b,\"c", None)], "k string, v int")
    for append, n in ((True, 2), (True, 4), (False, 2)):
        sink.write(df, f"{tmp_path}/out", fmt, append)
        assert read_file(spark, f"{tmp_path}/out", fmt, schema="k string, v int", header=True).count() == n
    stream = read_file(spark, f"{tmp_path}/out", fmt, schema="k string, v int", follow=True, header=True, files_per_trigger=1)
    for _ in range(2):  # begun again, nothing is written twice
        sink.start(stream.drop("ts"), f"{tmp_path}/copy", f"{tmp_path}/log", fmt).awaitTermination()
    assert rows(read_file(spark, f"{tmp_path}/copy", fmt, schema="k string, v int", header=True).drop("ts")) == rows(df)


def test_text_sink(spark, tmp_path):
    sink.write(spark.createDataFrame([(1.5,), (None,)], "value double"), f"{tmp_path}/t", "text")
    assert rows(spark.read.text(f"{tmp_path}/t")) == [("1.5",), ("null",)]


def test_metrics(spark):
    m = Metrics("ad")
    df = spark.createDataFrame([("x\"y", True, 2.5, 3), ("z", None, None, 4)], "campaign string, live boolean, rate double, event_count bigint")
    m.update(df)
    m.update(df)
    text = m.text()
    assert 'ad_rate{campaign="x\\"y",live="true"} 2.5' in text and 'ad_event_count{campaign="z"} 4' in text and 'ad_events_total{campaign="z"} 8' in text
    server = serve(m)
    try:
        get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}").read().decode()
        assert get("/metrics") == text and get("/health") == "ok\n"
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        Metrics("m", limit=1).update(df)


def test_once(spark, tmp_path):
    f, schema = once(str(tmp_path / "o")), "transaction_id string, v int"
    f(spark.createDataFrame([("a", 1), ("a", 1), (None, 2), (None, 2)], schema), 0)
    second = spark.createDataFrame([("a", 1), ("b", 3)], schema)
    f(second, 1)
    f(second, 1)  # the same batch again
    assert rows(spark.read.parquet(str(tmp_path / "o")).select("transaction_id", "v")) == [("a", 1), ("b", 3), (None, 2), (None, 2)]
    assert unseen(spark.createDataFrame([], schema), None).count() == 0


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        asked: list = []

        def do_GET(self):
            self.asked.append((self.path, self.headers.get("X-Key")))
            if self.path == "/flaky" and len([a for a in self.asked if a[0] == "/flaky"]) < 2:
                self.send_response(500)
                self.end_headers()
                return
            body = {"/list": [{"symbol": "a", "price": 1}, {"symbol": "b", "price": {"x": 2}}], "/text": None}.get(self.path, {"symbol": "s", "price": 1.5})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"plain" if body is None else json.dumps(body).encode())

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", Handler.asked
    s.shutdown()


def test_http(spark, server):
    url, asked = server
    options = {"urls": f"{url}/a,{url}/flaky,{url}/list,{url}/text,http://127.0.0.1:1/gone", "retry_delay": "0", "max_retries": "1", "value_path": "$.price", "key_path": "$.symbol", "explode": "true", "header.X-Key": "secret", "poll_interval": "0"}
    r = HttpReader(options)
    got, end = r.read(r.initialOffset())
    got = list(got)
    assert [x[2:4] for x in got] == [("s", "1.5"), ("s", "1.5"), ("a", "1"), ("b", '{"x": 2}'), (None, "plain")]
    assert list(r.readBetweenOffsets({"round": 0}, end)) == got
    r.commit(end)
    assert not r.held and all(k == "secret" for _, k in asked)
    assert at_path({"a": {"b": 3}}, "$.a.b") == 3 and at_path({"a": 1}, "$.a.b") is None
    register(spark)
    df = spark.readStream.format("http_poll").options(urls=f"{url}/a", polls="1", key_path="$.symbol").load()
    assert rows(drained(df).select("key", "value")) == [("s", '{"symbol": "s", "price": 1.5}')]
    with pytest.raises(ValueError):
        HttpReader({"urls": " "})


def test_supervised():
    class Q:
        left = 2

        def awaitTermination(self):
            Q.left -= 1
            if Q.left >= 0:
                raise RuntimeError("lost")

    assert supervised(Q, 3, 0) == 2
    Q.left = 9
    with pytest.raises(RuntimeError):
        supervised(Q, 1, 0)


def test_tail_of_a_growing_file(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"k": "a", "v": 1}\nbroken\n{"k": "b", "v"')
    read = lambda **kw: read_file(spark, str(path), "json", "k string, v int", follow=True, **kw)

    def go_on():
        read(key="k").select("key", "v").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.schema("key string, v int").parquet(f"{tmp_path}/out"))

    assert go_on() == [("a", 1)]  # a line that isn't whole yet waits
    with path.open("a") as f:
        f.write(': 2}\n{"k": "c", "v": 3}\n')
    assert go_on() == [("a", 1), ("b", 2), ("c", 3)]
    r = tail.TailReader({"path": str(path), "bytes_per_batch": "5"})
    first, end = r.read(r.initialOffset())
    assert list(first) == list(r.readBetweenOffsets({"at": 0}, end)) == [('{"k": "a", "v": 1}',)]
    assert tail.TailReader({"path": f"{path}.none"}).read({"at": 0})[1] == {"at": 0} and tail.TailReader({"path": str(path), "from_end": "true"}).initialOffset() == {"at": path.stat().st_size}
