"""Files of bytes: output artifacts with size and hash, stored inputs, and stages that a later run takes up again."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.sources.dense import opened
from gridloom.storage import shared_folder


def write_artifacts(chunks: DataFrame, path: str, combined: list[str] | None = None) -> DataFrame:
    """chunks(output, seq, data binary) as one file ``<output>.bin`` for each output: (output, path, bytes, sha256).

    A file's bytes are its chunks in the order of seq, and its hash is of these bytes. With ``combined``, the named
    outputs go one after another into the single file ``output.bin``. A file is written by one task, batch by batch, under
    another name and then renamed, so it is there as a whole or not at all, and a second try writes the same.
    """
    if combined:
        place = F.array_position(F.array(*[F.lit(x) for x in combined]), F.col("output"))
        chunks = chunks.where(place > 0).select(F.lit("output").alias("output"), F.struct(place.alias("place"), "seq").alias("seq"), "data")
    dealt = chunks.repartition("output").sortWithinPartitions("output", "seq").select("output", "data")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(path)
        store.create_dir(folder, recursive=True)
        now, out, size, digest, temp = None, None, 0, None, ""

        def end() -> pa.RecordBatch:
            out.close()
            store.move(temp, f"{folder}/{now}.bin")
            return pa.RecordBatch.from_pydict({"output": [now], "path": [f"{folder}/{now}.bin"], "bytes": pa.array([size], pa.int64()), "sha256": [digest.hexdigest()]})

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now:
                    if out:
                        yield end()
                    now, size, digest, temp = name, 0, hashlib.sha256(), f"{folder}/{name}.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(temp)
                out.write(data or b"")
                digest.update(data or b"")
                size += len(data or b"")
        if out:
            yield end()

    return dealt.mapInArrow(write, "output string, path string, bytes long, sha256 string")


def keep_inputs(inputs: DataFrame, path: str, max_files: int = 10, max_bytes: int = 1 << 30) -> DataFrame:
    """inputs(job, name, data binary), each stored under its name and hash: (job, name, bytes, sha256, accepted, path).

    Names lose what a file name can't hold. A job's inputs beyond ``max_files`` (by name) and those of more than
    ``max_bytes`` are not accepted and not stored; their rows say so.
    """
    place = F.row_number().over(Window.partitionBy("job").orderBy("name"))
    judged = inputs.select("job", F.regexp_replace("name", "[^A-Za-z0-9._-]", "_").alias("name"), "data", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha256"))
    judged = judged.withColumn("accepted", (place <= max_files) & (F.col("bytes") <= max_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(path)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            paths = []
            for name, data, digest, accepted in zip(*[batch.column(c).to_pylist() for c in ("name", "data", "sha256", "accepted")], strict=True):
                paths.append(f"{folder}/{name}-{digest}" if accepted else None)
                if accepted:
                    temp = f"{paths[-1]}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(temp) as out:
                        out.write(data)
                    store.move(temp, paths[-1])
            yield batch.drop_columns(["data"]).append_column("path", pa.array(paths, pa.string()))

    kind = inputs.schema["job"].dataType.simpleString()
    return judged.mapInArrow(write, f"job {kind}, name string, bytes long, sha256 string, accepted boolean, path string")


class StageStore:
    """Results of named stages below a folder, each with its parameters and a hash of its rows."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or shared_folder(spark, "stages")

    def _hash(self, df: DataFrame) -> list:
        """Rows and the sum of their hashes: the same in any order."""
        found = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        return [found["n"], str(found["h"])]

    def save(self, name: str, df: DataFrame, parameters: dict) -> DataFrame:
        at = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        about = json.dumps({"name": name, "parameters": parameters, "path": at, "hash": self._hash(out)})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}.manifest")
        return out

    def load(self, name: str, parameters: dict) -> DataFrame | None:
        """The stage's rows; None if it wasn't saved with these parameters or its rows have changed."""
        try:
            about = json.loads(self.spark.read.text(f"{self.path}/{name}.manifest").first()[0])
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        out = self.spark.read.parquet(about["path"])
        return out if about["parameters"] == parameters and self._hash(out) == about["hash"] else None

    def resume(self, name: str, parameters: dict, make) -> DataFrame:
        """The saved stage, or what ``make()`` gives, saved."""
        found = self.load(name, parameters)
        return self.save(name, make(), parameters) if found is None else found
