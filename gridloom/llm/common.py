"""What the operators of this subpackage share: reading tables, the shared folder, Arrow batches, a worker's memory."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may go without that setting or a checkpoint folder; it gets a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if not root:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
            root = context.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again, which cuts its lineage.

    Small results get few files: partitions are joined up to the advisory size, not only down to one for each core.
    """
    spark, name_ = df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    path, before = path or new_folder(spark, name), spark.conf.get(name_)
    spark.conf.set(name_, "false")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(name_, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Stored tables that are dropped together once nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_folder(df.sparkSession, name))
        return stored(df, name, self.paths[-1])

    def drop(self, spark: SparkSession) -> None:
        for path in self.paths:
            delete(spark, path)
        self.paths = []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bounds of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lowers the session's bounds of an Arrow batch to these, where they are higher.

    Spark reads them when a plan runs, after the operator has returned it, so they are only ever lowered: each plan
    gets batches of the size that its operator asked for, or smaller ones.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(name)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def extended(docs: DataFrame, more: str) -> StructType:
    """The columns of ``docs`` and more, given as in SQL."""
    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])


_held: dict[Any, Any] = {}


def held(name: Any, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a Python worker between batches (a model, a cache).

    Spark uses its workers again, for other operators too; a worker holds the things of one operator only.
    """
    if name not in _held:
        _held.clear()
        gc.collect()
        _held[name] = make()
    return _held[name]


class WordTable:
    """Numbers that were computed for words before, of bounded size: an open hash table in arrays.

    A word is known by two hashes (96 bits together). Once the table has ``most`` words no others are taken in: words
    that come often are met early.
    """

    def __init__(self, most: int, kind: str = "<u4") -> None:
        self.most, self.mask = most, np.uint64((1 << (2 * most - 1).bit_length()) - 1)
        slots = int(self.mask) + 1
        self.hashes, self.checks, self.sizes = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint32), np.zeros(slots, dtype=np.uint16)
        self.starts, self.pool, self.used, self.words = np.zeros(slots, dtype=np.uint32), np.zeros(1 << 16, dtype=kind), 0, 0

    @staticmethod
    def codes(words: list[str] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each word; the first is never 0."""
        words = np.asarray(words, dtype=object)
        first = pd.util.hash_array(words, hash_key="words-0123456789", categorize=False)
        second = pd.util.hash_array(words, hash_key="check-0123456789", categorize=False)
        return np.maximum(first, np.uint64(1)), second.astype(np.uint32)

    def find(self, codes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The slot of each word; -1 where it isn't there."""
        h, check = codes
        out, open_, at = np.full(len(h), -1, dtype=np.int64), np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(open_):
            there = self.hashes[at]
            same = (there == h[open_]) & (self.checks[at] == check[open_])
            out[open_[same]] = at[same]
            on = ~same & (there != 0)
            open_, at = open_[on], (at[on] + 1) & int(self.mask)
        return out

    def add(self, codes: tuple[np.ndarray, np.ndarray], values: np.ndarray, sizes: np.ndarray) -> None:
        """Takes in distinct words that aren't there: the next ``sizes[i]`` of ``values`` are those of word i."""
        some = max(0, self.most - self.words)
        h, check, sizes = codes[0][:some], codes[1][:some], sizes[:some]
        if not len(h) or int(sizes.max()) > 0xFFFF:
            return
        n = int(sizes.sum())
        if self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(n, self.used // 2), dtype=self.pool.dtype)])
        self.pool[self.used : self.used + n] = values[:n]
        starts = self.used + np.cumsum(sizes) - sizes
        open_, at = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(open_):
            free = self.hashes[at] == 0
            self.hashes[at[free]] = h[open_[free]]
            self.checks[at[free]] = check[open_[free]]  # of words that want one slot the last one wrote all of it
            self.starts[at[free]], self.sizes[at[free]] = starts[open_[free]], sizes[open_[free]]
            on = ~((self.hashes[at] == h[open_]) & (self.checks[at] == check[open_]))
            open_, at = open_[on], (at[on] + 1) & int(self.mask)
        self.used, self.words = self.used + n, self.words + len(h)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their bytes reach ``size``."""
    some, now = [], 0
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            now += batch.nbytes
        if now >= size:
            yield pa.concat_batches(some)
            some, now = [], 0
    if some:
        yield pa.concat_batches(some)


def take(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``pool[starts[i] : starts[i] + sizes[i]]`` one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
