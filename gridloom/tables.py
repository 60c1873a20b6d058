"""Input tables, and the record tables that the control-plane queries read, derived from them by projection only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> str:
    """SQL for microseconds since 1970 of a timestamp without zone."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk, client, seq, payload, server_hash, reported_hash: one row for each result that a worker sent."""
    return load(spark, sf_dir, "events").select(
        (F.col("event_id") % 500).alias("chunk"), F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.col("props").alias("payload"),
        F.sha2("props", 256).alias("server_hash"), F.sha2(F.when(F.col("event_type") == "error", F.concat("props", F.lit("!"))).otherwise(F.col("props")), 256).alias("reported_hash"),
    )


SUBMISSIONS_SQL = """(SELECT event_id % 500 AS chunk, user_id AS client, event_id AS seq, props AS payload, sha256(props) AS server_hash,
    sha256(CASE WHEN event_type = 'error' THEN props || '!' ELSE props END) AS reported_hash FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, process, us, power: telemetry with power in whole hundredths."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("process"), F.col("event_id").alias("sample"), F.expr(micros("ts")).alias("us"), F.round(F.col("value") * 100).cast("long").alias("power"))


SAMPLES_SQL = "(SELECT user_id AS session, event_type AS process, event_id AS sample, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS power FROM events)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, chunk, status (O open, P dispatched, F finished), created in microseconds."""
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("chunk"), F.col("o_orderstatus").alias("status"), F.expr(micros("o_orderdate")).alias("created"), F.col("o_orderpriority").alias("framework"))


CHUNKS_SQL = "(SELECT o_custkey AS parent, o_orderkey AS chunk, o_orderstatus AS status, epoch_us(o_orderdate) AS created, o_orderpriority AS framework FROM orders)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, k, v: the embeddings as a matrix of thousandths."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("k", "x"))
    return vectors.select("i", "k", F.round(F.col("x").cast("double") * 1000).cast("long").alias("v"))


CELLS_SQL = "(SELECT i, CAST(k - 1 AS INTEGER) AS k, CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id AS i, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings))"


def whole_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, row: the same matrix, one array a row."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("row"))
