import json
import socket
import threading
import time
import urllib.request

import pytest
from conftest import rows

from rillstone.__main__ import main
from rillstone.jobs import Job, JobError, Registry

TOML = """
name = "count"
sql = "SELECT k, COUNT(*) AS event_count FROM events GROUP BY k WINDOW TUMBLING 1 MINUTE"
operators = [{{type = "filter", expr = "v > 0"}}, {{type = "map", expr = "v * 2 AS w"}}]
[source]
type = "file"
path = "{path}"
schema = "k string, v int, ms bigint"
event_time = "ms"
[sink]
type = "{sink}"
path = "{path}.out"
"""


@pytest.fixture
def job_file(tmp_path):
    data = tmp_path / "in.json"
    data.write_text("".join(json.dumps({"k": k, "v": v, "ms": ms}) + "\n" for k, v, ms in [("a", 1, 5), ("a", 2, 70_000), ("a", 3, 80_000), ("b", 0, 1)]))
    p = tmp_path / "job.toml"
    p.write_text(TOML.format(path=data, sink="file"))
    return p


def test_run(spark, job_file, tmp_path):
    jobs = Registry(str(tmp_path / "jobs"))
    at = jobs.submit(Job.from_file(str(job_file)))
    assert jobs.run(at, spark)["state"] == "completed"
    out = spark.read.json(f"{tmp_path}/in.json.out")
    assert rows(out.select("k", "event_count", "window_start")) == [("a", 1, 0), ("a", 2, 60_000)]
    m = Job.from_dict(json.loads(json.dumps(Job.from_file(str(job_file)).__dict__)) | {"sink": {"type": "metrics", "preset": "ad_analytics"}}).run(spark)
    assert 'ad_events_total{k="a"} 3' in m.text()


def test_building():
    job = Job("j", {"type": "file", "path": "in"}, {"type": "file", "path": "out"}).filter("v > 1").map("v + 1 AS w").changed(parallelism=2)
    assert job.checked().operators == [{"type": "filter", "expr": "v > 1"}, {"type": "map", "expr": "v + 1 AS w"}] and job.parallelism == 2


def test_unbounded(spark, job_file, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in.json").rename(tmp_path / "in" / "a.json")
    job = Job.from_file(str(job_file))
    job.source |= {"path": str(tmp_path / "in"), "follow": True}
    with pytest.raises(JobError, match="checkpoint"):
        job.checked()
    job.checkpoint, job.watermark = str(tmp_path / "log"), "1 second"
    job.run(spark)
    assert rows(spark.read.json(f"{tmp_path}/in.json.out").select("event_count")) == [(1,)]  # the last window is open


def test_registry(spark, job_file, tmp_path):
    jobs, job = Registry(str(tmp_path / "jobs")), Job.from_file(str(job_file))
    at = jobs.submit(job)
    jobs.move(at, "running")
    with pytest.raises(JobError, match="running"):
        jobs.submit(job)
    assert jobs.stop(at)["state"] == "stopped"
    with pytest.raises(JobError):
        jobs.stop(at)
    with pytest.raises(JobError):
        jobs.get("none")

    def fail(_):
        raise RuntimeError("no disk")

    done = jobs.run(jobs.submit(job), spark, fail)
    assert done["state"] == "failed" and "no disk" in done["error"] and len(jobs.list()) == 2


@pytest.mark.parametrize(
    "change",
    [{"source": {"type": "kafka"}}, {"source": {"type": "file"}}, {"source": {"type": "http"}}, {"sink": {"type": "file"}}, {"sink": {}}, {"parallelism": 0}, {"batch_size": -1}, {"sql": "SELECT"}, {"operators": [{"type": "sort", "expr": "x"}]}, {"name": ""}],
)
def test_problems(job_file, change):
    d = Job.from_file(str(job_file)).__dict__ | change
    with pytest.raises(JobError):
        Job.from_dict(d).checked()


def test_command_line(job_file, tmp_path, capsys, monkeypatch):
    assert main(["validate", str(job_file)]) == 0
    assert main(["--registry", str(tmp_path / "r"), "list"]) == 0
    assert main(["--registry", str(tmp_path / "r"), "status", "x"]) == 1
    job_file.write_text("name = 1")
    assert main(["validate", str(job_file)]) == 1
    assert "missing settings" in capsys.readouterr().err
    with pytest.raises(JobError, match="unknown settings"):
        Job.from_dict({"name": "a", "source": {}, "sink": {}, "colour": 1})


def test_stop_ends_the_query_and_metrics_are_served(spark, job_file, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in.json").rename(tmp_path / "in" / "a.json")
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    job = Job.from_file(str(job_file))
    job.source |= {"path": str(tmp_path / "in"), "follow": True}
    job.sql, job.sink = "SELECT k, COUNT(*) AS event_count FROM events GROUP BY k", {"type": "metrics", "prefix": "p", "mode": "complete", "every": "1 second", "port": port}
    jobs = Registry(str(tmp_path / "jobs"))
    at = jobs.submit(job)
    done = []
    runner = threading.Thread(target=lambda: done.append(jobs.run(at, spark)))
    runner.start()
    text = ""
    for _ in range(120):
        try:
            text = urllib.request.urlopen(f"http://127.0.0.1:{port}/metrics").read().decode()
        except OSError:
            pass
        if "p_event_count" in text:
            break
        time.sleep(0.5)
    assert 'p_event_count{k="a"} 3' in text
    jobs.stop(at)
    runner.join(60)
    assert not runner.is_alive() and done[0]["state"] == "stopped"
    with pytest.raises(OSError):
        urllib.request.urlopen(f"http://127.0.0.1:{port}/metrics")
