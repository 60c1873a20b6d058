"""Generated inputs: uniform and normal numbers that a seed fixes, series, matrices and sort data, times as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import wide

#: Steps of the generator s = (9301 s + 49297) mod this number.
LCG_RANGE = 233_280
_HEX = 13


def uniform(key: Column, seed: str) -> Column:
    """In [0, 1), 52 bits of a hash of seed and key: the same wherever and in whatever order rows are made."""
    digest = F.sha2(F.concat(F.lit(f"{seed}/"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") / float(16**_HEX)


def normal(key: Column, seed: str, scale: float = 1.0) -> Column:
    """Normal numbers from two uniform ones."""
    u, v = uniform(key, f"{seed}/u"), uniform(key, f"{seed}/v")
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * F.pi() * v) * scale


def sine(index: Column, step: float = 0.01) -> Column:
    return F.sin(index * step)


def sort_data(spark: SparkSession, n: int, seed: str, high: float = 1000.0) -> DataFrame:
    """(idx, v): numbers to sort, below ``high``."""
    return spark.range(n).select(F.col("id").alias("idx"), (uniform(F.col("id"), seed) * high).alias("v"))


def random_matrix(spark: SparkSession, size: int, seed: int, kind: str = "float", low: float = 0, high: float | None = None) -> DataFrame:
    """(i, k, v): the generator's matrix, of floats in [low, high) or of whole numbers from low to high."""
    share = F.col("state") / float(LCG_RANGE)
    states = wide.lcg_matrix(spark, size, seed, "state")
    if kind == "float":
        return states.select("i", "k", (share * ((1 if high is None else high) - low) + low).cast("float").alias("v"))
    if kind != "int":
        raise ValueError(f"{kind}: neither float nor int")
    return states.select("i", "k", (F.floor(share * ((1000 if high is None else high) - low + 1)) + low).cast("int").alias("v"))


def iso(ts: Column) -> Column:
    """A time without zone as ISO text with Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def random_id() -> Column:
    """A random identifier (version 4); another one for each row and each run."""
    return F.expr("uuid()")
