"""Inputs and reports in text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.series import iso


def multi_inputs(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Each input of a payload: a JSON object of base64 texts by name, or one plain text as the input ``input``."""
    is_object = F.col(payload).startswith("{")
    inputs = F.when(is_object, F.from_json(payload, "map<string,string>")).otherwise(F.create_map(F.lit("input"), F.col(payload)))
    return df.select(*[c for c in df.columns if c != payload], F.explode(inputs).alias("name", "data")).withColumn("bytes", F.unbase64("data"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; fields that hold commas, quotes or JSON are quoted."""
    df.write.mode("append").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_outputs(df: DataFrame, path: str, output: str = "output") -> DataFrame:
    """One folder for each named output, committed as a whole; returns (output, rows, bytes, hash) as manifest.

    The hash is the sum of the rows' hashes: the same in any order, and no task sees all rows of an output.
    """
    df.write.partitionBy(output).parquet(path)
    read = df.sparkSession.read.parquet(path)
    data = F.to_json(F.struct(*[c for c in read.columns if c != output]))
    return read.groupBy(F.col(output).cast("string").alias(output)).agg(F.count("*").alias("rows"), F.sum(F.length(data)).alias("bytes"), F.sum(F.xxhash64(data).cast("decimal(38,0)")).cast("string").alias("hash"))


def files_with_hash(spark, path: str, max_files: int = 10, max_bytes: int = 1 << 30) -> DataFrame:
    """(path, length, hash, accepted) of whole files; files beyond ``max_files`` (by path) or ``max_bytes`` stay as rows."""
    from gridloom.operators.sorting import global_rank

    files = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("hash"))
    return global_rank(files, F.asc("path")).select("path", "length", "hash", ((F.col("length") <= max_bytes) & (F.col("place") <= max_files)).alias("accepted"))


def _fixed(x: Column) -> Column:
    """Two digits after the point, nothing for null."""
    return F.when(x.isNotNull(), F.format_string("%.2f", x)).otherwise("")


def chunk_times(chunks: DataFrame) -> DataFrame:
    """The report of a job's chunks, as text: chunks(task_id, chunk_id, chunking, client, round_trip, started, completed)."""
    return chunks.select("task_id", "chunk_id", _fixed(F.col("chunking")).alias("chunking_time_ms"), _fixed(F.col("client")).alias("client_processing_time_ms"), _fixed(F.col("round_trip")).alias("round_trip_time_ms"), iso(F.col("started")).alias("start_timestamp"), F.coalesce(iso(F.col("completed")), F.lit("")).alias("completed_timestamp"))


def job_times(jobs: DataFrame, parameters: list[str]) -> DataFrame:
    """The summary line of each job, its parameters as one JSON text:
    jobs(task_id, label, strategy, framework, total, chunks, started, completed, and the parameters)."""
    known = lambda c: F.coalesce(F.col(c), F.lit("Unknown")).alias(c)
    return jobs.select("task_id", known("label"), known("strategy"), known("framework"), F.to_json(F.struct(*parameters)).alias("parameters"), _fixed(F.col("total")).alias("total_time_ms"), F.col("chunks").alias("chunks_count"), iso(F.col("started")).alias("start_timestamp"), F.coalesce(iso(F.col("completed")), F.lit("")).alias("completed_timestamp"))


def job_descriptor(times: DataFrame) -> DataFrame:
    """(job, descriptor): each job's breakdown as one JSON text."""
    return times.select("job", F.to_json(F.struct(*[c for c in times.columns if c != "job"])).alias("descriptor"))
