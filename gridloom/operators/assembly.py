"""Putting partial results together, and what is missing for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import sorting


def ordered_concat(df: DataFrame, by: list[str], order: str, value: str, name: str = "joined") -> DataFrame:
    """By group the values in order, as one text. A group is one assembled output and as large as that."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["v"]), ",").alias(name))


def numeric_suffix(chunk_id: Column) -> Column:
    """The trailing digits of a chunk's id as its number; 0 without any."""
    digits = F.regexp_extract(chunk_id, "([0-9]+)$", 1)
    return F.coalesce(F.when(digits != "", digits.cast("long")), F.lit(0).cast("long"))


def completeness(parts: DataFrame, steps: int) -> DataFrame:
    """parts(bi, bj, bk): for each block how many partial products came and whether all did."""
    return parts.groupBy("bi", "bj").agg(F.countDistinct("bk").alias("have"), F.min("bk").alias("first"), F.max("bk").alias("last")).withColumn("complete", F.col("have") == steps)


def missing(expected: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(have.select(*on).distinct(), on, "left_anti")


def progress(chunks: DataFrame, by: str, done: Column) -> DataFrame:
    """(by, done, total, percent): whole percents, rounded down."""
    n = F.count("*")
    return chunks.groupBy(by).agg(F.sum(done.cast("long")).alias("done"), n.alias("total")).withColumn("percent", F.floor(F.col("done") * 100 / F.col("total")))


def verdict(parts: DataFrame, blocks: int, steps: int) -> DataFrame:
    """One row about a whole product: parts and blocks that came, complete blocks, and whether all are as planned."""
    found = completeness(parts, steps).agg(F.count("*").alias("blocks"), F.sum("have").alias("parts"), F.sum((F.col("complete") & (F.col("first") == 0) & (F.col("last") == steps - 1)).cast("long")).alias("complete"))
    return found.withColumn("valid", (F.col("blocks") == blocks) & (F.col("parts") == blocks * steps) & (F.col("complete") == blocks))


def order_index(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """``chunks`` with ``index`` from 0, by the number that ends the id, then by the id."""
    ranked = sorting.global_rank(chunks.withColumn("number", numeric_suffix(F.col(chunk_id))), F.asc("number"), F.asc(chunk_id), name="index")
    return ranked.withColumn("index", F.col("index") - 1)


def with_descriptors(results: DataFrame, descriptors: DataFrame, on: str = "chunk") -> DataFrame:
    """Each result with its chunk's descriptor; results of unknown chunks fall out."""
    return results.join(descriptors, on)


def digests(values: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """By output: how many values, their mean, and the first 16 digits of the hash of the values as text in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))), lambda x: x["v"]), ",")
    return values.groupBy(by).agg(F.count("*").alias("n"), (F.sum(value).cast("double") / F.count("*")).alias("mean"), F.substring(F.sha2(text, 256), 1, 16).alias("hash"))
