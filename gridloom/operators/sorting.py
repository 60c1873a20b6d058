"""Distributed sort: range partitions, each sorted, and ranks from the sizes of the partitions before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.storage import stored

#: Rows of a part that a window reads in one task.
PART_ROWS = 1 << 16


def global_rank(df: DataFrame, *keys: Column, name: str = "place") -> DataFrame:
    """``df`` in the order of ``keys`` (which leave no ties) with each row's number from 1.

    No step sees all rows in one task. The rows are sorted by range and written once with a number that counts inside
    their partition; each partition's start is the sum of the sizes before it, of which there is one for a partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the number's upper half is the partition, the lower 33 bits count its rows
    numbered = stored(dealt.select(F.struct(*dealt.columns).alias("row"), F.monotonically_increasing_id().alias("at")), "ranked")
    part = F.shiftright("at", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + 1).alias("start"))  # one row a partition
    both = numbered.withColumn("part", part).join(F.broadcast(starts), "part")
    return both.select("row.*", (F.col("start") + F.col("at") - F.shiftleft("part", 33)).alias(name))


def rank_in_groups(df: DataFrame, group: str, *keys: Column, name: str = "place") -> DataFrame:
    """Each row's number in its group's order, where groups may be few and large: from one sort of all rows."""
    ranked = global_rank(df, F.asc(group), *keys, name=name)
    firsts = ranked.groupBy(group).agg(F.min(name).alias("first"))
    return ranked.join(firsts.withColumnRenamed(group, "of"), F.col(group).eqNullSafe(F.col("of"))).select(*df.columns, (F.col(name) - F.col("first") + 1).alias(name))


def rank_in_chunks(df: DataFrame, chunk: Column, *keys: Column, name: str = "place") -> DataFrame:
    """Each row's number in its chunk's order; chunks are of bounded size."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(chunk).orderBy(*keys)))


def top_k(df: DataFrame, k: int, *keys: Column, name: str = "place") -> DataFrame:
    """The first ``k`` rows with their number; Spark keeps k rows a partition and merges them."""
    return df.orderBy(*keys).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*keys)))


def descents(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """By group: rows, rows whose value is below the one before, and whether the count is a power of two.

    Neighbours are compared in parts of ``PART_ROWS`` rows of one sort of all rows, and the parts' edges with each other.
    """
    rows = stored(global_rank(df.select(group, order, value), F.asc(group), F.asc(order)), "ordered").withColumn("part", F.floor((F.col("place") - 1) / PART_ROWS))
    w = Window.partitionBy("part").orderBy("place")
    inside = rows.select(group, ((F.lag(group).over(w) == F.col(group)) & (F.col(value) < F.lag(value).over(w))).alias("down"))
    first, last = F.min_by(F.struct(group, value), "place"), F.max_by(F.struct(group, value), "place")
    edges = rows.groupBy("part").agg(first.alias("first"), last.alias("last"))
    ends = edges.select((F.col("part") + 1).alias("part"), "last")
    across = edges.select("part", "first").join(ends, "part").where((F.col(f"first.{group}") == F.col(f"last.{group}")) & (F.col(f"first.{value}") < F.col(f"last.{value}"))).select(F.col(f"first.{group}").alias(group), F.lit(True).alias("down"))
    counted = inside.select(group, F.col("down").cast("long"), F.lit(1).alias("n")).union(across.select(group, F.col("down").cast("long"), F.lit(0)))
    found = counted.groupBy(group).agg(F.sum("n").alias("n"), F.coalesce(F.sum("down"), F.lit(0)).alias("descents"))
    return found.withColumn("power_of_two", (F.col("n") > 0) & (F.col("n").bitwiseAND(F.col("n") - 1) == 0))


def percentile(df: DataFrame, group: str, value: str, percent: int) -> DataFrame:
    """(group, n, p): the exact percentile, interpolated between the two nearest ranks. Groups may be few and large."""
    ranked = stored(rank_in_groups(df.select(group, value).withColumn("tie", F.monotonically_increasing_id()), group, F.asc(value), F.asc("tie")), "ranked")
    sizes = ranked.groupBy(group).agg(F.max("place").alias("n"))
    at = (F.col("n") - 1) * percent
    low = ranked.join(sizes.withColumnRenamed(group, "of"), F.col(group).eqNullSafe(F.col("of"))).where((F.col("place") - 1 == F.floor(at / 100)) | (F.col("place") - 1 == F.ceil(at / 100)))
    share = (at % 100) / 100.0
    return low.groupBy(group, "n").agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b")).select(group, "n", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("p"))
