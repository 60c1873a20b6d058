"""Jobs: a chunking and an assembly by name over a table, with a record of each job and its result on shared storage.

A job is one Spark plan; there is no dispatch loop. Records are one small file for each job, so several programs can
submit below one folder.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.registry import Registry, built_in
from gridloom.storage import shared_folder

_JOB = "id string, label string, chunking string, assembly string, framework string, status string, created double, completed double, rows long, result string, error string"


class Engine:
    """Jobs below ``path``: ``jobs/<id>.json`` and ``results/<id>``."""

    def __init__(self, spark: SparkSession, path: str | None = None, registry: Registry | None = None) -> None:
        self.spark, self.path, self.registry = spark, path or shared_folder(spark, "jobs"), registry or built_in()

    def violations(self, spec: dict[str, Any]) -> list[str]:
        """What a job's description lacks or has wrong."""
        found = [f"{x} is missing" for x in ("chunking", "assembly") if not spec.get(x)]
        for kind in ("chunking", "assembly"):
            if spec.get(kind) and (kind, spec[kind]) not in self.registry.items:
                found.append(f"no {kind} strategy {spec[kind]}")
        if not found and not self.registry.compatible(spec["chunking"], spec["assembly"])[0]:
            found.append(f"{spec['chunking']} does not feed {spec['assembly']}")
        if int(spec.get("k", 1)) < 1:
            found.append("k is below 1")
        return found

    def submit(self, spec: dict[str, Any], data: DataFrame) -> str:
        """Runs the job and returns its id; a failed job is recorded with its error, a wrong one raises ValueError."""
        if wrong := self.violations(spec):
            raise ValueError("; ".join(wrong))
        job = {"id": uuid.uuid4().hex, "label": spec.get("label", ""), "chunking": spec["chunking"], "assembly": spec["assembly"], "framework": spec.get("framework", "spark"), "status": "active", "created": time.time(), "completed": None, "rows": None, "result": f"{self.path}/results/", "error": None}
        job["result"] += job["id"]
        self._record(job)
        try:
            self.registry.execute(spec["chunking"], spec["assembly"], data, spec.get("metadata", {})).write.parquet(job["result"])
            job |= {"status": "complete", "rows": self.spark.read.parquet(job["result"]).count()}
        except Exception as e:
            job |= {"status": "failed", "error": str(e)[:1000]}
        self._record(job | {"completed": time.time()})
        return job["id"]

    def _record(self, job: dict) -> None:
        self.spark.createDataFrame([(json.dumps(job),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/jobs/{job['id']}")

    def jobs(self) -> DataFrame:
        """All jobs, the newest first."""
        try:
            rows = self.spark.read.text(f"{self.path}/jobs/*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _JOB)
        return rows.select(F.from_json("value", _JOB).alias("j")).select("j.*").orderBy(F.desc("created"))

    def status(self, job: str) -> dict | None:
        found = self.jobs().where(F.col("id") == job).first()
        return found.asDict() if found else None

    def result(self, job: str) -> DataFrame:
        about = self.status(job)
        if not about or about["status"] != "complete":
            raise KeyError(f"no complete job {job}")
        return self.spark.read.parquet(about["result"])

    def remove(self, keep_seconds: float) -> int:
        """Deletes jobs that ended longer ago, with their results; how many."""
        old = self.jobs().where((F.col("status") != "active") & (F.col("completed") < time.time() - keep_seconds)).select("id", "result").collect()  # one row a job
        for r in old:
            for x in (r["result"], f"{self.path}/jobs/{r['id']}"):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(x)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return len(old)
