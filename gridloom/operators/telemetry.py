"""Summaries of power samples: samples(session, process, sample, us, power)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import sorting

_ORDER = ["us", "sample"]


def energy(samples: DataFrame) -> DataFrame:
    """By session the trapezoid integral of power over time, doubled so that it stays whole, the span and the mean.

    Units are power times microseconds; the mean is 0 without a span.
    """
    w = Window.partitionBy("session").orderBy(*_ORDER)
    steps = samples.select("session", "us", "power", ((F.lag("power").over(w) + F.col("power")) * (F.col("us") - F.lag("us").over(w))).alias("area"))
    sums = steps.groupBy("session").agg(F.count("*").alias("samples"), (F.max("us") - F.min("us")).alias("span"), F.coalesce(F.sum("area"), F.lit(0)).cast("long").alias("twice_energy"), F.max("power").alias("peak"))
    return sums.withColumn("mean_power", F.when(F.col("span") > 0, F.floor(F.col("twice_energy") / F.col("span") / 2)).otherwise(0).cast("long"))


def energy_by_process(samples: DataFrame) -> DataFrame:
    """By session and process: each step's area goes to the process of its later sample, with its mean power."""
    w = Window.partitionBy("session").orderBy(*_ORDER)
    steps = samples.withColumn("area", F.coalesce((F.lag("power").over(w) + F.col("power")) * (F.col("us") - F.lag("us").over(w)), F.lit(0)))
    return steps.groupBy("session", "process").agg(F.sum("area").cast("long").alias("twice_energy"), F.floor(F.sum("power") / F.count("*")).cast("long").alias("mean_power"), F.count("*").alias("samples"))


def energy_by_percent(samples: DataFrame) -> DataFrame:
    """By session and process, from samples that hold a map ``percents`` of process to percent of the device.

    Each step between two samples has an area; a process gets the share that the later sample's percent names. Energy is
    two hundred times the area, so that it stays whole; the mean percent counts the samples that have the process.
    """
    w = Window.partitionBy("session").orderBy(*_ORDER)
    steps = samples.withColumn("area", F.coalesce((F.lag("power").over(w) + F.col("power")) * (F.col("us") - F.lag("us").over(w)), F.lit(0)))
    shares = steps.select("session", "area", F.explode("percents").alias("process", "percent"))
    return shares.groupBy("session", "process").agg(F.sum(F.col("area") * F.col("percent")).cast("long").alias("energy_200"), F.count("*").alias("samples"), F.floor(F.sum("percent") / F.count("*")).cast("long").alias("mean_percent"))


def by_chunk(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Each sample with the chunk that its session was at: spans(session, chunk, first, last) do not overlap in a session.

    Spans and samples of a session are merged in time order, so a session's rows meet once and no pairs are made.
    """
    marks = spans.select("session", F.col("first").alias("us"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("sample"), F.struct("chunk", "last").alias("span"), F.lit(None).cast("long").alias("power"))
    both = marks.unionByName(samples.select("session", "us", F.lit(1).alias("kind"), "sample", F.lit(None).cast(marks.schema["span"].dataType).alias("span"), "power"))
    w = Window.partitionBy("session").orderBy("us", "kind", "sample").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("span", F.last("span", ignorenulls=True).over(w)).where("kind = 1")
    return found.where(F.col("us") <= F.col("span.last")).select("session", F.col("span.chunk").alias("chunk"), "sample", "us", "power")


def summary(samples: DataFrame, by: str) -> DataFrame:
    """Mean, 95th percentile (interpolated) and peak; means of nothing are 0. Groups may be few and large."""
    sums = samples.groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.round(F.sum("power").cast("double") / F.count("power"), 4), F.lit(0.0)).alias("mean"), F.max("power").alias("peak"))
    p95 = sorting.percentile(samples.where("power IS NOT NULL"), by, "power", 95).select(F.col(by).alias("of"), F.round("p", 4).alias("p95"))
    return sums.join(p95, F.col(by).eqNullSafe(F.col("of")), "left").select(by, "n", "mean", "p95", "peak")


def head_and_tail(samples: DataFrame, n: int = 3) -> DataFrame:
    """The first and the last ``n`` samples of each session; a short session's rows come in both parts."""
    first = Window.partitionBy("session").orderBy(*_ORDER)
    last = Window.partitionBy("session").orderBy(F.desc("us"), F.desc("sample"))
    head = samples.withColumn("at", F.row_number().over(first)).where(F.col("at") <= n).withColumn("part", F.lit("head"))
    tail = samples.withColumn("at", F.row_number().over(last)).where(F.col("at") <= n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail).select("session", "part", "at", "sample", "power")


def since_start(samples: DataFrame) -> DataFrame:
    """Each sample's time since its session's first one."""
    return samples.select("session", "sample", (F.col("us") - F.min("us").over(Window.partitionBy("session"))).alias("since"))
