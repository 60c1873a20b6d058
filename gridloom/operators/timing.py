"""Where a job's time went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def breakdown(rows: DataFrame, job: str, total: str, parts: list[str]) -> DataFrame:
    """By job the sum of each part (nulls count 0) and what of the total no part explains."""
    sums = [F.sum(F.coalesce(F.col(p), F.lit(0))).alias(p) for p in parts]
    out = rows.groupBy(job).agg(F.count("*").alias("chunks"), F.max(total).alias(total), *sums)
    return out.withColumn("communication", F.col(total) - sum((F.col(p) for p in parts[1:]), F.col(parts[0])))


def means_null_as_zero(rows: DataFrame, job: str, parts: list[str]) -> DataFrame:
    """By job each part's mean over all rows, a null counting as 0 rather than left out."""
    return rows.groupBy(job).agg(F.count("*").alias("chunks"), *[(F.sum(F.coalesce(F.col(p), F.lit(0))) / F.count("*")).alias(p) for p in parts])
