"""Workers, queues, retention and timeouts as queries over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import sorting


def match_workers(workers: DataFrame, work: DataFrame) -> DataFrame:
    """(client, chunk): open chunks whose framework the worker supports; ``frameworks`` is an array.

    Each chunk goes to one worker: chunks and workers of a framework are numbered and dealt round. Frameworks are few, so
    their workers are numbered by one sort of all.
    """
    able = workers.select("client", F.explode("frameworks").alias("framework"))
    n = able.groupBy("framework").agg(F.count("*").alias("n"))
    seats = sorting.rank_in_groups(able, "framework", F.asc("client"), name="seat").withColumn("seat", F.col("seat") - 1)
    dealt = work.join(n, "framework").select("chunk", "framework", F.pmod("chunk", F.col("n")).alias("seat"))
    return dealt.join(seats, ["framework", "seat"]).select("client", "chunk", "framework")


def eligible(work: DataFrame, dispatches: DataFrame, k: int, done: Column) -> DataFrame:
    """Chunks that aren't done and were sent to fewer than ``k`` workers, with how often they were."""
    sent = dispatches.groupBy("chunk").agg(F.countDistinct("client").alias("sent"))
    return work.where(~done).join(sent, "chunk", "left").withColumn("sent", F.coalesce("sent", F.lit(0).cast("long"))).where(F.col("sent") < k)


def unassigned(pairs: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Pairs of worker and chunk that weren't sent yet."""
    return pairs.join(dispatches.select("client", "chunk").distinct(), ["client", "chunk"], "left_anti")


def open_of_gone(dispatches: DataFrame, gone: DataFrame) -> DataFrame:
    """Dispatches to workers that have left."""
    return dispatches.join(gone.select("client").distinct(), "client", "left_semi")


def queue_positions(work: DataFrame, queue: str, order: list[str], name: str = "position") -> DataFrame:
    return work.withColumn(name, F.row_number().over(Window.partitionBy(queue).orderBy(*order)))


def queue_statistics(work: DataFrame, queue: str, created: str, now: int, attempts: str | None = None) -> DataFrame:
    """(queue, size, oldest_age, mean_age): ages in whole seconds; with ``attempts`` their hundredfold mean too."""
    if attempts:
        tried = work.groupBy(queue).agg(F.floor(F.sum(attempts) * 100 / F.count("*")).alias("mean_attempts"))
        return queue_statistics(work, queue, created, now).join(tried, queue)
    age = F.lit(now) - F.col(created)
    return work.groupBy(queue).agg(F.count("*").alias("size"), F.floor(F.max(age) / 1_000_000).alias("oldest_age"), F.floor(F.sum(age) / F.count("*") / 1_000_000).alias("mean_age"))


def queue_totals(statistics: DataFrame) -> DataFrame:
    """Of all queues together: how many, their chunks, the largest and the oldest age."""
    return statistics.agg(F.count("*").alias("queues"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("chunks"), F.max("size").alias("largest"), F.max("oldest_age").alias("oldest_age"))


def first_workers(workers: DataFrame, work: DataFrame) -> DataFrame:
    """(client, chunk): each open chunk with the first worker (by client) that supports its framework."""
    able = workers.select("client", F.explode("frameworks").alias("framework"))
    first = able.groupBy("framework").agg(F.min("client").alias("client"))
    return work.join(first, "framework").select("client", "chunk", "framework")


def evict_oldest(work: DataFrame, queue: str, order: list[str], cap: int, percent: int = 10) -> DataFrame:
    """What a full queue (``cap`` or more) would drop: the oldest ``percent`` in a hundred, rounded up."""
    size = F.count("*").over(Window.partitionBy(queue))
    placed = queue_positions(work.withColumn("size", size), queue, order).where(F.col("size") >= cap)
    return placed.where(F.col("position") <= F.ceil(F.col("size") * percent / 100))


def expired(work: DataFrame, since: str, now: int, limit_us: int) -> DataFrame:
    """Rows older than the limit, with how many microseconds they are over it."""
    return work.where(F.lit(now) - F.col(since) > limit_us).withColumn("over", F.lit(now) - F.col(since) - limit_us)


def failure_rate(work: DataFrame, by: str, failed: Column, counted: Column, floor_: int = 10) -> DataFrame:
    """(by, failed, counted, percent, abort): abort above a half and more than ``floor_`` failures."""
    sums = work.groupBy(by).agg(F.sum(failed.cast("long")).alias("failed"), F.sum(counted.cast("long")).alias("counted"))
    return sums.withColumn("percent", F.when(F.col("counted") > 0, F.floor(F.col("failed") * 100 / F.col("counted"))).otherwise(0)).withColumn("abort", (F.col("failed") * 2 > F.col("counted")) & (F.col("failed") > floor_))


def schema_violations(fields: DataFrame, max_inputs: int = 4, max_outputs: int = 3) -> DataFrame:
    """fields(schema_id, kind, name, binding): one row for each broken limit."""
    counts = fields.groupBy("schema_id").agg(
        F.sum((F.col("kind") == "input").cast("long")).alias("inputs"), F.sum((F.col("kind") == "output").cast("long")).alias("outputs"),
        F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.countDistinct("binding").alias("bindings"),
    )
    found = F.array(
        F.when(F.col("inputs") > max_inputs, "too many inputs"), F.when(F.col("outputs") > max_outputs, "too many outputs"),
        F.when(F.col("inputs") == 0, "no input"), F.when(F.col("names") < F.col("n"), "names repeat"), F.when(F.col("bindings") < F.col("n"), "bindings repeat"),
    )
    return counts.select("schema_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("violation"))


def available(workers: DataFrame, busy: DataFrame, connected: Column) -> DataFrame:
    """Workers that are connected and have no open work."""
    return workers.where(connected).join(busy.select("client").distinct(), "client", "left_anti")


def descriptor_violations(descriptors: DataFrame, max_inputs: int = 4) -> DataFrame:
    """descriptors(id, inputs array, sizes array): one row for each broken rule."""
    found = F.array(
        F.when(F.size("inputs") > max_inputs, "too many inputs"), F.when(F.size("sizes") == 0, "no output"),
        F.when(F.size("inputs") != F.size("sizes"), "lengths differ"), F.when(~F.forall("sizes", lambda x: x > 0), "size not positive"),
    )
    return descriptors.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("violation"))


def merged_settings(left: Column, right: Column) -> Column:
    """Two maps as one; where both have a key the right one's value stands."""
    only_left = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(only_left, right)


def memory_plan(bytes_: Column, limit: int) -> Column:
    """Where a result of this size is kept: in memory, in memory with spill, or in files."""
    return F.when(bytes_ * 4 <= limit, "memory").when(bytes_ <= limit, "spill").otherwise("files")


def kernel_kind(kind: Column, source: Column) -> Column:
    """The declared kind, else the first known word in the source, in this order."""
    guess = F.lit("unknown")
    for word, name in reversed([("conv", "convolution"), ("matrix", "matmul"), ("sort", "sort"), ("ecm", "ecm")]):
        guess = F.when(F.lower(source).contains(word), name).otherwise(guess)
    return F.coalesce(F.when(kind != "", F.lower(kind)), guess)
