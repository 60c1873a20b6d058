"""Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable Parquet files. Files belong to tiers by size, each tier ``FANOUT`` times the
one below. As soon as a tier holds ``FANOUT`` files or more, all of them are merged into as few files as their size
needs, up to the target size, so a row is rewritten about once a tier. Merging reads whole files and writes whole
files: nothing is shuffled, and all merges of a round are one job.

A manifest version names the files of one state of the table. It is written under a name of its own and renamed to its
version number, which fails if another writer took that number: a commit is there as a whole or not at all. (HDFS and
local folders rename so; a store that overwrites on rename needs a conditional put in ``commit``.) Readers take the
highest version. The last ``KEEP_VERSIONS`` versions stay, so a reader planned on one of them keeps its files; files that
only older ones name are deleted, and ``vacuum`` deletes those that no version names (of commits that were lost).

Defined results: rows keep every column and value, nulls and repeated rows included; their order is not kept. An empty
arrival commits a version without new files. Reading a table without rows gives the schema of the first arrival.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
FANOUT = 4
#: The upper size of the lowest tier.
SMALL_BYTES = 1 << 20
#: Merges that go into one job at most; more take several jobs.
MERGES_A_JOB = 64
#: Rows that lie side by side and come in one arrival.
RUN_ROWS = 64
KEEP_VERSIONS = 4
#: Files that no version names are left alone for so long: their writer may still commit.
ORPHAN_SECONDS = 86_400


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class ShardedTable:
    """A table below ``path``: ``data/<batch>/*.parquet`` and ``manifest/<version>.json``."""

    spark: SparkSession
    path: str
    target: int = TARGET_BYTES
    fanout: int = FANOUT

    # files and manifests: the driver handles names and sizes of files, never rows

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifest")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``schema`` and ``files`` (path, bytes) of one state; the newest unless told otherwise."""
        for _ in range(100):
            known = self.versions()
            if not known:
                return {"version": 0, "schema": None, "files": []}
            try:
                rows = self.spark.read.text(f"{self.path}/manifest/{version or known[-1]:012d}.json", wholetext=True).collect()
                return json.loads(rows[0][0])
            except Exception:  # cleaned between listing and reading: there is a newer one
                if version is not None or self.versions() == known:
                    raise
        raise RuntimeError(f"{self.path}: versions change faster than they can be read")

    def commit(self, base: dict, files: list[dict], schema: str) -> dict:
        """The state after ``base``; raises Conflict if there is one already."""
        new = {"version": base["version"] + 1, "schema": schema, "files": files}
        jvm = self.spark._jvm
        at = f"{self.path}/manifest/{new['version']:012d}.json"
        fs, temp = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        files_of = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files_of.rename(temp, jvm.org.apache.hadoop.fs.Path(at), rename)
        except Exception as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(at) from e
            raise
        return new

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self._files(folder)

    def _files(self, folder: str) -> list[dict]:
        fs, p = self._fs(folder)
        if not fs.exists(p):
            return []
        found = [(x.getPath().toString(), x.getLen()) for x in fs.listStatus(p)]
        return [{"path": name, "bytes": size} for name, size in sorted(found) if name.endswith(".parquet")]

    def _read(self, files: list[dict], schema: str) -> DataFrame:
        kind = _schema(schema)
        return self.spark.read.schema(kind).parquet(*[x["path"] for x in files]) if files else self.spark.createDataFrame([], kind)

    # what users call

    def read(self, version: int | None = None) -> DataFrame:
        state = self.manifest(version)
        return self._read(state["files"], state["schema"])

    def append(self, arrival: DataFrame) -> dict:
        """Adds ``arrival`` as small files; tries again on the newest version if another writer came first."""
        return self._append(self._write(arrival), arrival.schema.json())

    def append_dealt(self, table: DataFrame, arrivals: int) -> Iterator[dict]:
        """Adds ``table`` in so many arrivals, which one pass over it writes; yields each one's state.

        Rows are dealt out in runs, by a hash of where they lie, whatever files the table has.
        """
        number, run = (next(x for x in (f"{name}{i}" for i in range(len(table.columns) + 1)) if x not in table.columns) for name in ("arrival", "run"))
        at = F.monotonically_increasing_id()
        dealt = table.withColumn(run, at).withColumn(number, F.pmod(F.xxhash64(F.floor(F.col(run) / RUN_ROWS)), F.lit(arrivals)).cast("int")).drop(run)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        dealt.write.partitionBy(number).parquet(folder)
        for i in range(arrivals):
            yield self._append(self._files(f"{folder}/{number}={i}"), table.schema.json())

    def _append(self, files: list[dict], schema: str) -> dict:
        while True:
            base = self.manifest()
            try:
                return self.commit(base, base["files"] + files, base["schema"] or schema)
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        level, bound = 0, SMALL_BYTES
        while size > bound:
            level, bound = level + 1, bound * self.fanout
        return level

    def due(self, files: list[dict]) -> list[list[dict]]:
        """Groups of files to merge: of each tier the files below target size, if there are enough of them."""
        tiers: dict[int, list[dict]] = {}
        for x in files:
            if 2 * x["bytes"] <= self.target:
                tiers.setdefault(self.tier(x["bytes"]), []).append(x)
        groups = []
        for level in sorted(tiers):
            group = tiers[level]
            if len(group) >= self.fanout and self._outputs(group) < len(group):
                groups.append(group)
        return groups

    def _outputs(self, group: list[dict]) -> int:
        return max(1, -(-sum(x["bytes"] for x in group) // self.target))

    def compact(self) -> dict:
        """Merges until no tier is due, and commits after each round."""
        while True:
            base = self.manifest()
            groups = self.due(base["files"])[:MERGES_A_JOB]
            if not groups:
                return base
            merged = [self._read(g, base["schema"]).coalesce(self._outputs(g)) for g in groups]
            files = self._write(reduce(DataFrame.unionByName, merged))
            gone = {x["path"] for g in groups for x in g}
            while True:
                try:
                    new = self.commit(base, [x for x in base["files"] if x["path"] not in gone] + files, base["schema"])
                    break
                except Conflict:  # arrivals came meanwhile; merged files still must all be there
                    base = self.manifest()
                    if not gone <= {x["path"] for x in base["files"]}:
                        return self.compact()
            self.clean()
            if len(new["files"]) >= len(base["files"]):
                return new

    def clean(self, keep: int = KEEP_VERSIONS) -> None:
        """Drops all versions but the last ``keep`` and the files that only they name."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        needed = {x["path"] for v in kept for x in self.manifest(v)["files"]}
        for v in old:
            for x in self.manifest(v)["files"]:
                if x["path"] not in needed:
                    fs, p = self._fs(x["path"])
                    fs.delete(p, False)
            fs, p = self._fs(f"{self.path}/manifest/{v:012d}.json")
            fs.delete(p, False)

    def vacuum(self, older_than: float = ORPHAN_SECONDS) -> list[str]:
        """Deletes data files that no version names and that are older than so many seconds; returns their names."""
        fs, p = self._fs(f"{self.path}/data")
        if not fs.exists(p):
            return []
        named = {x["path"] for v in self.versions() for x in self.manifest(v)["files"]}
        found, gone, now = fs.listFiles(p, True), [], time.time()
        while found.hasNext():
            x = found.next()
            name = x.getPath().toString()
            if name.endswith(".parquet") and name not in named and now - x.getModificationTime() / 1000 > older_than:
                fs.delete(x.getPath(), False)
                gone.append(name)
        return gone

    def shards(self) -> DataFrame:
        """``file, rows``: what the newest version's files hold."""
        return self.read().groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def ingest(table: DataFrame, path: str, arrivals: int, target: int = TARGET_BYTES) -> ShardedTable:
    """Appends ``table`` in so many arrivals, compacting after each as tiers fall due."""
    out = ShardedTable(table.sparkSession, path, target)
    for _ in out.append_dealt(table, arrivals):
        out.compact()
    return out
