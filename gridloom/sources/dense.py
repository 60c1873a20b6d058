"""Dense binary files: a count or size as unsigned 32-bit integer, then little-endian 32-bit floats.

``densemat`` reads and writes a file of two square matrices, ``densearray`` reads files of one array. Partitions are
ranges of bytes that a task reads by position, so no file is ever a row. Paths are local ones or addresses of stores
that pyarrow can open (file, hdfs, s3, gs); executors must reach them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER = 4


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(path.replace(":", "://", 1))


@dataclass
class BlockRow(InputPartition):
    matrix: str
    first: int
    last: int


class DenseReader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def _size(self) -> int:
        store, path = opened(self.path)
        with store.open_input_file(path) as f:
            n = int(np.frombuffer(f.read_at(HEADER, 0), "<u4")[0])
            if f.size() != HEADER + 8 * n * n:
                raise ValueError(f"{self.path}: not two {n} x {n} matrices")
        return n

    def partitions(self) -> list[BlockRow]:
        n = self._size()
        return [BlockRow(m, i, min(i + self.rows, n)) for m in "AB" for i in range(0, n, self.rows)]

    def read(self, part: BlockRow) -> Iterator[pa.RecordBatch]:
        n = self._size()
        at = HEADER + 4 * n * (part.first + (n if part.matrix == "B" else 0))
        store, path = opened(self.path)
        with store.open_input_file(path) as f:
            v = np.frombuffer(f.read_at(4 * n * (part.last - part.first), at), "<f4")
        i = np.repeat(np.arange(part.first, part.last), n)
        yield pa.RecordBatch.from_pydict({"mat": pa.array([part.matrix] * len(v)), "i": pa.array(i, pa.int64()), "k": pa.array(np.tile(np.arange(n), part.last - part.first), pa.int64()), "v": pa.array(v)})


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: list[tuple[str, int]]


class DenseWriter(DataSourceWriter):
    """Rows (mat, i, data) in the order of mat and i: each task writes its rows as one part, the commit joins them."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> Part:
        import uuid

        store, path = opened(self.path)
        name, held = f"{path}.{uuid.uuid4().hex}.part", []
        with store.open_output_stream(name) as out:
            for row in rows:
                out.write(bytes(row.data))
                held.append((row.mat, row.i))
        return Part(name, held)

    def commit(self, messages: list) -> None:
        store, path = opened(self.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.rows[0])
        rows = [r for m in parts for r in m.rows]
        n = sum(mat == "A" for mat, _ in rows)
        if rows != [(mat, i) for mat in "AB" for i in range(n)]:
            self.abort(messages)
            raise ValueError(f"{self.path}: not the rows of two square matrices in order")
        with store.open_output_stream(f"{path}.part") as out:
            out.write(np.array([n], "<u4").tobytes())
            for m in parts:
                with store.open_input_stream(m.path) as data:
                    while block := data.read(1 << 20):
                        out.write(block)
        store.move(f"{path}.part", path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m:
                store.delete_file(m.path)


class DenseSource(DataSource):
    """Options: ``path``; ``rows``, the rows of a partition (256)."""

    @classmethod
    def name(cls) -> str:
        return "densemat"

    def schema(self) -> str:
        return "mat string, i long, k long, v float"

    def reader(self, schema) -> DenseReader:
        return DenseReader(self.options["path"], int(self.options.get("rows", "256")))

    def writer(self, schema, overwrite: bool) -> DenseWriter:
        return DenseWriter(self.options["path"])


@dataclass
class Range(InputPartition):
    path: str
    chunk: int
    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, elements: int) -> None:
        self.path, self.elements = path, elements

    def partitions(self) -> list[Range]:
        store, path = opened(self.path)
        found = store.get_file_info(path)
        files = [found] if found.is_file else sorted((x for x in store.get_file_info(fs.FileSelector(path)) if x.is_file), key=lambda x: x.path)
        parts = []
        for x in files:
            with store.open_input_file(x.path) as f:
                n = int(np.frombuffer(f.read_at(HEADER, 0), "<u4")[0])
            parts += [Range(x.path, i // self.elements, i, min(i + self.elements, n)) for i in range(0, n, self.elements)]
        return parts

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(part.path) as f:
            v = np.frombuffer(f.read_at(4 * (part.last - part.first), HEADER + 4 * part.first), "<f4")
        yield pa.RecordBatch.from_pydict({"file": [part.path] * len(v), "chunk": pa.array([part.chunk] * len(v), pa.int64()), "pos": pa.array(np.arange(part.first, part.last), pa.int64()), "v": v})


class ArraySource(DataSource):
    """Options: ``path`` (a file or a folder of files); ``elements``, the numbers of a partition."""

    @classmethod
    def name(cls) -> str:
        return "densearray"

    def schema(self) -> str:
        return "file string, chunk long, pos long, v float"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], int(self.options.get("elements", "16384")))


def read_pair(spark: SparkSession, path: str, rows: int = 256) -> DataFrame:
    """(mat, i, k, v) of a file of two matrices."""
    spark.dataSource.register(DenseSource)
    return spark.read.format("densemat").option("path", path).option("rows", str(rows)).load()


def write_pair(cells: DataFrame, path: str) -> None:
    """cells(mat, i, k, v), with mat A and B, as one file; tasks write its parts."""
    spark = cells.sparkSession
    spark.dataSource.register(DenseSource)
    rows = encode_rows(cells).select("mat", "i", "data")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "mat", "i").sortWithinPartitions("mat", "i").write.format("densemat").option("path", path).mode("append").save()


def array_chunks(spark: SparkSession, path: str, elements: int) -> DataFrame:
    """(file, chunk, pos, v) of files with a count and so many floats; the last chunk is short."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("densearray").option("path", path).option("elements", str(elements)).load()


def encode_rows(cells: DataFrame) -> DataFrame:
    """cells(mat, i, k, v) as (mat, i, data): each row's floats in order of k, as bytes."""
    from gridloom.functions.hashing import floats_to_bytes

    rows = cells.groupBy("mat", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("row"))
    return rows.select("mat", "i", floats_to_bytes("row").alias("data"))


def decode_rows(rows: DataFrame) -> DataFrame:
    """The inverse of ``encode_rows``."""
    from gridloom.functions.hashing import bytes_to_floats

    return rows.select("mat", "i", F.posexplode(bytes_to_floats("data")).alias("k", "v"))
