"""Checksum votes over redundant results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(submissions: DataFrame) -> DataFrame:
    """Those whose reported checksum is the one of the bytes that came."""
    return submissions.where(F.col("reported_hash") == F.col("server_hash"))


def votes(submissions: DataFrame) -> DataFrame:
    """(chunk, server_hash, votes, first_seq): distinct clients for each valid checksum."""
    return valid(submissions).groupBy("chunk", "server_hash").agg(F.countDistinct("client").alias("votes"), F.min("seq").alias("first_seq"))


def winners(submissions: DataFrame, k: int) -> DataFrame:
    """For each chunk the checksum with at least ``k`` votes: the most votes, then the earliest."""
    enough = votes(submissions).where(F.col("votes") >= k)
    best = F.min(F.struct((-F.col("votes")).alias("order"), "first_seq", "server_hash", "votes")).alias("w")
    return enough.groupBy("chunk").agg(best).select("chunk", "w.server_hash", "w.votes", "w.first_seq")


def first_to_k(submissions: DataFrame, k: int) -> DataFrame:
    """For each chunk the checksum that was the first to have ``k`` distinct clients, and the deciding submission."""
    first_votes = valid(submissions).groupBy("chunk", "server_hash", "client").agg(F.min("seq").alias("seq"))
    counted = first_votes.withColumn("n", F.row_number().over(Window.partitionBy("chunk", "server_hash").orderBy("seq"))).where(F.col("n") == k)
    return counted.groupBy("chunk").agg(F.min(F.struct("seq", "server_hash")).alias("w")).select("chunk", "w.server_hash", F.col("w.seq").alias("decided_at"))


def deduplicated(submissions: DataFrame) -> DataFrame:
    """The first submission of each client for each checksum of a chunk."""
    return submissions.groupBy("chunk", "client", "server_hash").agg(F.min("seq").alias("seq"), F.count("*").alias("times"))


def winning_rows(submissions: DataFrame, k: int) -> DataFrame:
    """The submission that stands for each decided chunk: the first one with the winning checksum."""
    best = winners(submissions, k).select("chunk", F.col("first_seq").alias("seq"))
    return submissions.join(best, ["chunk", "seq"])


def in_time(submissions: DataFrame, k: int) -> DataFrame:
    """Submissions up to the one that decides their chunk; those that come after it are ignored."""
    decided = first_to_k(submissions, k).select("chunk", "decided_at")
    both = submissions.join(decided, "chunk", "left")
    return both.where(F.col("decided_at").isNull() | (F.col("seq") <= F.col("decided_at"))).select(*submissions.columns)
