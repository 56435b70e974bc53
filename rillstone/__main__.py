"""python -m rillstone submit FILE | validate FILE | list | status ID | stop ID"""

from __future__ import annotations

import argparse
import json
import sys

from rillstone.jobs import Job, JobError, Registry


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rillstone", description="Jobs over event streams")
    p.add_argument("--registry", default=".rillstone-jobs", help="folder of the submitted jobs")
    sub = p.add_subparsers(dest="verb", required=True)
    s = sub.add_parser("submit", help="run a job")
    s.add_argument("file")
    s.add_argument("--restarts", type=int, default=0, help="restarts after a failure")
    s.add_argument("--master", default=None)
    sub.add_parser("validate", help="check a job file").add_argument("file")
    sub.add_parser("list", help="all jobs")
    for verb in ("status", "stop"):
        sub.add_parser(verb).add_argument("id")
    a = p.parse_args(args)
    jobs = Registry(a.registry)
    try:
        if a.verb == "validate":
            Job.from_file(a.file).checked()
            print("valid")
        elif a.verb == "list":
            for j in jobs.list():
                print(j["id"], j["state"], j["name"])
        elif a.verb == "status":
            print(json.dumps(jobs.get(a.id), indent=2))
        elif a.verb == "stop":
            print(jobs.stop(a.id)["state"])
        else:
            from pyspark.sql import SparkSession

            at = jobs.submit(Job.from_file(a.file))
            b = SparkSession.builder.appName("rillstone").config("spark.sql.session.timeZone", "UTC")
            done = jobs.run(at, (b.master(a.master) if a.master else b).getOrCreate(), restarts=a.restarts)
            print(at, done["state"], done.get("error", ""))
            return int(done["state"] == "failed")
    except (JobError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
