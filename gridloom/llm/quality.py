"""Quality rules as a short-circuit cascade.

Each rule reads features of a text that are computed when first asked for. On a sample of bounded size the cascade
measures what each rule costs and which documents it rejects. The rule with the most rejections per second comes first;
the next one is chosen by what it rejects of the documents that are left then, and so on. The rules run in this order
and stop at the first that rejects, so features of later rules are never computed for rejected documents. The order
changes the time only: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words and all counts 0; the base rule rejects it. Repeated rows are judged
each for themselves. All columns but the text pass through untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import extended, small_batches

#: Documents on which costs and rejections are measured, about; the order of the rules is all that hangs on them.
SAMPLE_DOCS = 400
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 8
_UP, _ALL = bytes(set(range(256)) - set(range(65, 91))), bytes(set(range(256)) - set(range(65, 91)) - set(range(97, 123)))
_DIGITS = bytes(set(range(256)) - set(range(48, 58)))
BULLETS, ELLIPSES = ("-".encode(), "*".encode(), "•".encode()), ("...".encode(), "…".encode())


class Features:
    """What the rules read of one text; each is computed once, when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # of bytes: at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw.translate(None, _UP))

    @cached_property
    def n_letters(self) -> int:
        return len(self.raw.translate(None, _ALL))

    @cached_property
    def n_digits(self) -> int:
        return len(self.raw.translate(None, _DIGITS))

    @cached_property
    def n_braces(self) -> int:
        return self.text.count("{") + self.text.count("}")

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip().startswith(BULLETS) for x in self.lines)

    @cached_property
    def n_trailing_off(self) -> int:
        return sum(x.rstrip().endswith(ELLIPSES) for x in self.lines)

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated(self.words)


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more; ``width`` is a power of two."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    span, n = 1, len(seen)
    while True:  # codes of windows twice as wide, from pairs; only windows that come again are of interest
        pairs = codes[:-span] * n + codes[span:]
        order = np.argsort(pairs, kind="stable")
        new = np.concatenate([[True], pairs[order][1:] != pairs[order][:-1]])
        span *= 2
        group = np.cumsum(new) - 1
        n = int(group[-1]) + 1
        if n == len(pairs):
            return 0
        codes = np.empty_like(pairs)
        codes[order] = group
        if span == width:
            break
    again = np.bincount(codes)[codes] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


BASE = Rule("base", lambda x: x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)
#: Thresholds in whole numbers, so that every engine decides alike.
RULES = [
    Rule("symbols", lambda x: 100 * x.n_symbols > 10 * x.n_words),
    Rule("duplicate_lines", lambda x: 100 * x.n_dup_lines > 50 * len(x.lines)),
    Rule("short_words", lambda x: 10 * x.word_chars < 25 * x.n_words),
    Rule("long_words", lambda x: x.word_chars > 15 * x.n_words),
    Rule("capitals", lambda x: 100 * x.n_upper > 60 * x.n_letters),
    Rule("digits", lambda x: 100 * x.n_digits > 40 * x.word_chars),
    Rule("braces", lambda x: 100 * x.n_braces > 5 * x.word_chars),
    Rule("bullets", lambda x: len(x.lines) >= 3 and 100 * x.n_bullets > 90 * len(x.lines)),
    Rule("trailing_off", lambda x: len(x.lines) >= 3 and 100 * x.n_trailing_off > 30 * len(x.lines)),
]


@dataclass(frozen=True)
class Measured:
    """Of a sample: seconds of each rule, and how many documents each set of rules rejects (bit i: rule i)."""

    seconds: dict[str, float]
    rejected: dict[int, int]


def measure(docs: DataFrame, rules: list[Rule], text: str = "text", sample: int = SAMPLE_DOCS, seed: int = 7, known: tuple[str, ...] = ()) -> Measured:
    """Over about ``sample`` documents from all parts of the table; features that are ``known`` anyway cost nothing."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seconds, sets = batch.column(0).to_pylist(), [0.0] * len(rules), {}
            for t in texts:
                bits = 0
                for i, rule in enumerate(rules):
                    x = Features(t)
                    for name in known:
                        getattr(x, name)
                    began = time.perf_counter()
                    bits |= rule.rejects(x) << i
                    seconds[i] += time.perf_counter() - began
                sets[bits] = sets.get(bits, 0) + 1
            yield pa.RecordBatch.from_pydict({"rule": [*range(len(rules)), *[-1] * len(sets)], "bits": pa.array([0] * len(rules) + list(sets), pa.int64()), "s": [*seconds, *map(float, sets.values())]}, schema=pa.schema([("rule", pa.int32()), ("bits", pa.int64()), ("s", pa.float64())]))

    some = docs.select(F.col(text).alias("t")).sample(fraction=min(1.0, sample / max(1, n)), seed=seed)
    found = some.mapInArrow(run, "rule int, bits long, s double").groupBy("rule", "bits").agg(F.sum("s").alias("s")).collect()  # a row for each rule, and for each set of rules in the sample
    return Measured({rules[r["rule"]].name: r["s"] for r in found if r["rule"] >= 0}, {r["bits"]: int(r["s"]) for r in found if r["rule"] < 0})


def ordered(rules: list[Rule], measured: Measured) -> list[Rule]:
    """Most rejections per second first, of the documents that the rules before have left; then the cheapest first."""
    left, chain, open_ = dict(measured.rejected), [], list(range(len(rules)))
    seconds = lambda i: max(measured.seconds.get(rules[i].name, 0.0), 1e-9)
    while open_:
        gain = {i: sum(n for bits, n in left.items() if bits >> i & 1) for i in open_}
        best = min(open_, key=lambda i: (-gain[i] / seconds(i), seconds(i), i))
        chain.append(rules[best])
        open_.remove(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return chain


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", order: list[Rule] | None = None, features: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``kept`` (boolean), ``failed`` (the rule that rejected it first, or null) and the named features.

    Columns of these names that ``docs`` has already are replaced.
    """
    small_batches(docs.sparkSession)
    rules = rules if rules is not None else [BASE, *RULES]
    chain = order if order is not None else ordered(rules, measure(docs, rules, text))
    docs = docs.drop("kept", "failed", *features)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, values = [], {f: [] for f in features}
            for t in batch.column(text).to_pylist():
                x = Features(t)
                failed.append(next((r.name for r in chain if r.rejects(x)), None))
                for f in features:
                    values[f].append(getattr(x, f))
            out = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(out | {"kept": pa.array([x is None for x in failed]), "failed": pa.array(failed, pa.string())} | {f: pa.array(v, pa.int64()) for f, v in values.items()})

    return docs.mapInArrow(run, extended(docs, "kept boolean, failed string" + "".join(f", {f} long" for f in features)))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The cascade's verdict beside the base measures: ``key, n_words, word_chars, ..., base_failed, kept``."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    small_batches(docs.sparkSession)
    chain = ordered(RULES, measure(docs, RULES, text, known=names))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, base, kept = [], [], []
            for t in batch.column("t").to_pylist():
                x = Features(t)
                rows.append([getattr(x, f) for f in names])
                base.append(BASE.rejects(x))
                kept.append(not base[-1] and not any(r.rejects(x) for r in chain))
            values = np.array(rows, dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_pydict({key: batch.column("k")} | {f: pa.array(values[:, i]) for i, f in enumerate(names)} | {"base_failed": pa.array(base, pa.bool_()), "kept": pa.array(kept, pa.bool_())})

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{f} long" for f in names) + ", base_failed boolean, kept boolean")
