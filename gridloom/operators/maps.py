"""Elementwise maps, positional zips and partition plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def square(df: DataFrame, value: str = "v") -> DataFrame:
    return df.withColumn(value, F.col(value) * F.col(value))


def sum_and_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(idx, v) and b(idx, v) by position: (idx, total, product)."""
    both = a.select("idx", F.col("v").alias("a")).join(b.select("idx", F.col("v").alias("b")), "idx")
    return both.select("idx", (F.col("a") + F.col("b")).alias("total"), (F.col("a") * F.col("b")).alias("product"))


def index_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"))


def partition_by_elements(df: DataFrame, index: str, size: int) -> DataFrame:
    """(chunk, first, last, n): contiguous ranges of ``size`` indexes."""
    return df.groupBy(F.floor(F.col(index) / size).alias("chunk")).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n"))


def byte_ranges(spark: SparkSession, total: int, parts: int) -> DataFrame:
    """(chunk, first, bytes): a buffer of ``total`` bytes in ``parts`` ranges, the last ones shorter or empty."""
    size = -(-total // parts)
    first = F.least(F.col("id") * size, F.lit(total))
    return spark.range(parts).select(F.col("id").alias("chunk"), first.alias("first"), (F.least((F.col("id") + 1) * size, F.lit(total)) - first).alias("bytes"))


def constant_colour(spark: SparkSession, width: int, height: int, colour: tuple[float, float, float, float]) -> DataFrame:
    """(x, y, r, g, b, a): every pixel alike."""
    return spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"), *[F.lit(c).alias(n) for n, c in zip("rgba", colour, strict=True)])


def chunk_plan(jobs: DataFrame, chunk_bytes: int, element_bytes: int = 4) -> DataFrame:
    """jobs(job, elements) with elements a chunk (rounded down, one at least) and chunks."""
    size = max(1, chunk_bytes // element_bytes)
    return jobs.withColumn("per_chunk", F.lit(size).cast("long")).withColumn("chunks", F.ceil(F.col("elements") / size))


def output_sizes(jobs: DataFrame) -> DataFrame:
    """jobs(job, given array, total array, chunks): a chunk's output sizes as given, else the totals divided, rounded up."""
    return jobs.withColumn("sizes", F.coalesce("given", F.transform("total", lambda t: F.ceil(t / F.col("chunks")))))


#: Fixed order: parameters that come first.
UNIFORMS = ["matrix_n", "matrixSize", "tile_start_row", "tile_start_col", "tile_rows", "tile_cols", "tile_size", "tileSize"]


def uniforms(numbers: Column) -> Column:
    """The values of a map of numbers: the known names in their order, then all others in the map's."""
    known = F.array(*[F.lit(x) for x in UNIFORMS])
    first = F.filter(F.transform(known, lambda k: F.try_element_at(numbers, k)), lambda v: v.isNotNull())
    rest = F.transform(F.filter(F.map_keys(numbers), lambda k: ~F.array_contains(known, k)), lambda k: F.element_at(numbers, k))
    return F.concat(first, F.filter(rest, lambda v: v.isNotNull()))
