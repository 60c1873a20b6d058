"""python -m gridloom: submit a job over a Parquet table, list jobs, show a result."""

from __future__ import annotations

import argparse
import json

from gridloom.plans.engine import Engine
from gridloom.session import session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    parser.add_argument("--store", required=True, help="folder of jobs and results")
    commands = parser.add_subparsers(dest="command", required=True)
    submit = commands.add_parser("submit")
    submit.add_argument("--input", required=True, help="Parquet table")
    submit.add_argument("--chunking", required=True)
    submit.add_argument("--assembly", required=True)
    submit.add_argument("--label", default="")
    submit.add_argument("--metadata", type=json.loads, default={}, help="JSON object")
    for name in ("status", "result"):
        commands.add_parser(name).add_argument("job")
    for name in ("list", "strategies"):
        commands.add_parser(name)
    asked = parser.parse_args(arguments)
    engine = Engine(session("gridloom"), asked.store)
    if asked.command == "submit":
        spec = {k: getattr(asked, k) for k in ("chunking", "assembly", "label", "metadata")}
        job = engine.submit(spec, engine.spark.read.parquet(asked.input))
        print(json.dumps(engine.status(job)))
        return int(engine.status(job)["status"] != "complete")
    if asked.command == "status":
        print(json.dumps(engine.status(asked.job)))
    elif asked.command == "result":
        engine.result(asked.job).show(truncate=False)
    elif asked.command == "list":
        engine.jobs().show(truncate=False)
    else:
        engine.registry.readiness(engine.spark).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
