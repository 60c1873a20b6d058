"""Structured Streaming forms: running block sums, sessions, and the exact rule for repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def block_sums(parts: DataFrame, steps: int) -> DataFrame:
    """parts(i, j, k, v), a stream: (i, j, v, have, complete), updated with every part that comes."""
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("have")).withColumn("complete", F.col("have") == steps)


def sessions(samples: DataFrame) -> DataFrame:
    """samples(session, us, power), a stream: each session's first and last time, samples and peak."""
    return samples.groupBy("session").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("samples"), F.max("power").alias("peak"))


def _accept(rows: pd.DataFrame, last: int | None, gap_us: int) -> tuple[list[int], int | None]:
    kept = []
    for at, us in zip(rows.index, rows["us"], strict=True):
        if last is None or us - last >= gap_us:
            kept.append(at)
            last = us
    return kept, last


def deduplicated(events: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Rows that come at least ``gap_us`` after the last accepted row of their key; batch form.

    The rule is sequential in a key. Spark sorts each partition by key and time; a task reads its rows once, batch by
    batch, and holds no more than the last accepted time, so a key of any size needs no memory.
    """
    dealt = events.repartition(*keys).sortWithinPartitions(*keys, "us", "event")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keep = []
            for now, us in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column("us").to_pylist(), strict=True):
                if now != key:
                    key, last = now, None
                keep.append(last is None or us - last >= gap_us)
                if keep[-1]:
                    last = us
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, events.schema)


def deduplicated_stream(events: DataFrame, keys: list[str], gap_us: int, expire: str = "60 seconds") -> DataFrame:
    """The same rule over a stream: the state of a key is the time of its last accepted row.

    ``events`` has a column ``ts`` with a watermark. A key's state goes when the watermark has passed its last accepted
    row by the gap or by ``expire``, whichever is longer: no later row can be held back by it then.
    """
    out = [f for f in events.schema if f.name != "ts"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out)
    hold_ms = max(gap_us // 1000, int(pd.Timedelta(expire).total_seconds() * 1000))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "event"]).reset_index(drop=True)
        kept, last = _accept(rows, state.get[0] if state.exists else None, gap_us)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + hold_ms, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[kept, [f.name for f in out]]

    return events.groupBy(*keys).applyInPandasWithState(run, kinds, "last long", "append", GroupStateTimeout.EventTimeTimeout)
