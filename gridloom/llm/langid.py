"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, a blank at word edges), most frequent
first. A document's own profile is compared to each language's: the out-of-place distance adds up by how many ranks
each n-gram of the document is displaced, and the greatest displacement where the language lacks it. The nearest
language wins; equal distances go to the alphabetically first.

Profiles are learned from a sample of about ``SAMPLE_DOCS`` labelled documents for each language, drawn from all parts
of the table by a hash of the key, of the ``MAX_LANGUAGES`` most frequent labels; every document is judged by its whole
text.

Defined results: a null text, or one without any letter, is ``und`` with score 0, and so is every text if nothing could
be learned. Rows without a label are not learned from. Repeated rows are judged each for themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import extended, small_batches

PROFILE = 400
SAMPLE_DOCS = 1500
#: Labels that are learned at most, the most frequent ones: a label column may be dirty.
MAX_LANGUAGES = 1000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of one to three characters: 21 bits a character, the last one lowest."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    c = np.concatenate([[32], np.where(letter, points, 32), [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != 32], two, three[c[1:-1] != 32]])


def profile(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, ties to the smaller code."""
    codes, counts = np.unique(grams(text), return_counts=True)
    if len(codes) > 4 * size:  # those that can be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:size]]


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order, all their n-grams in order, and each n-gram's rank in each language."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int = PROFILE

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text, self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = np.where((self.codes[at] == own)[:, None], self.ranks[at], self.size)
        off = np.where(rank == self.size, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.languages[best], 1.0 - float(off[best]) / (self.size * len(own))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS, size: int = PROFILE) -> Model:
    """Profiles of all values of ``lang``, without the held-out documents."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return Model([], np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.int64), size)
    # of each language a share by hash; the more documents, the smaller
    part = F.pmod(F.xxhash64(F.col(key), F.lit("learn")), F.lit(1_000_000))
    bound = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, math.ceil(1_000_000 * min(1.0, sample / n)))])[F.col(lang)]
    some = rows.where(part < bound).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for l, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(l, []).append(grams(t))
            for l, parts in found.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [l] * len(codes), "code": codes, "n": n})
            found = {}

    summed = some.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = summed.withColumn("place", place).where(F.col("place") <= size).select("lang", "code", "place").collect()  # size rows a language
    languages = sorted({r["lang"] for r in top})
    codes = np.array(sorted({r["code"] for r in top}), dtype=np.int64)
    ranks = np.full((len(codes), len(languages)), size, dtype=np.int64)
    for r in top:
        ranks[np.searchsorted(codes, r["code"]), languages.index(r["lang"])] = r["place"] - 1
    return Model(languages, codes, ranks, size)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (1: profiles alike, 0: nothing in common)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {"lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

    return docs.mapInArrow(run, extended(docs, "lang_pred string, score double"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, held_out, lang_pred, score`` for each document; neither label nor key take part in a prediction."""
    model = fit(docs, key, text, lang)
    found = predict(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model)
    return found.select(F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "lang_pred", "score")
