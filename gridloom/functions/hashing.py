"""Checksums of results and base64 at the edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def outputs_hash(outputs: DataFrame, by: str, order: str, data: str) -> DataFrame:
    """(by, hash): over the outputs' bytes one after another in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    return outputs.groupBy(by).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["d"].cast("string")), ""), 256).alias("hash"))


@F.pandas_udf(T.BinaryType())
def floats_to_bytes(rows: pd.Series) -> pd.Series:
    """An array of numbers as little-endian 32-bit floats."""
    import numpy as np

    return rows.map(lambda x: np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bytes_to_floats(data: pd.Series) -> pd.Series:
    import numpy as np

    return data.map(lambda x: np.frombuffer(x, dtype="<f4"))


def fnv1a(column: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, wrapped at 32 bits after each step (a cache key only)."""

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out = []
            for text in part:
                h = 0x811C9DC5
                for b in (text or "").encode():
                    h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
                out.append(h)
            yield pd.Series(out, dtype="int64")

    return run(column)
