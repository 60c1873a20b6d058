"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi search.

The automaton reads a word once. At each position its output links give all pieces that end there, the longest first;
each relaxes the best score of that position from the best score of where the piece begins. Characters that no piece
covers cost ten more than the worst piece and are written as byte pieces. This is the search that the SentencePiece
library makes over a unigram model with the same pieces and scores; with a model whose scores are merge ranks (as in
the given file) the segmentation is the one of the highest score sum, not the one that merging would give.

No piece has a blank after another character, so a text is cut before each run of blanks and words are searched alone;
so are lines, if no piece has a newline. Words that a worker hasn't met are searched together, in one pass of the
automaton.

Defined results: a null or empty text has no ids and decodes to the empty text. Any other text decodes to itself,
whatever it holds (the blank's own mark, U+2581, is written in bytes). Other columns pass through; repeated rows are
encoded each for themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordTable, extended, gathered, held, small_batches, take

BLANK = "▁"
#: Words whose ids a worker keeps at most (some 25 bytes each), and the longest word that is searched together with others.
KEPT_WORDS, LONG_WORD = 500_000, 48
#: Words that are searched in one pass.
TOGETHER = 16_384
#: Texts are encoded together until they have this size.
GATHER_BYTES = 1 << 20
#: Parts words that are searched together; words that hold it are searched alone.
_END = "\x00"
#: Where a text is cut; texts that hold it are cut by the expression.
_MARK = "\x01"
UNKNOWN_PENALTY = 10.0
_CUT = re.compile(r" *[^ ]+| +")


class Codec:
    """Pieces of one model file: the automaton, byte pieces, and each id's bytes."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.lengths, self.scores = np.zeros(n, dtype=np.int64), np.zeros(n)
        self.single: set[str] = set()
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.lengths[i], self.scores[i] = len(piece), model.get_score(i)
                self.automaton.add_word(piece, i)
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.cuts_lines = not any("\n" in piece for piece in self.automaton.keys())
        self.known = WordTable(KEPT_WORDS, "<u2" if n <= 1 << 16 else "<u4")

    def search(self, word: str) -> list[int]:
        """Ids of the best segmentation of a word in which blanks are marked."""
        n = len(word)
        best, start, by = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here are final

        def pass_to(end: int) -> None:
            nonlocal done
            while done < end:
                if word[done] not in self.single and best[done] + self.unknown > best[done + 1]:
                    best[done + 1], start[done + 1], by[done + 1] = best[done] + self.unknown, done, -1
                done += 1

        lengths, scores = self.lengths, self.scores
        for last, i in self.automaton.iter(word):
            if done < last:
                pass_to(last)
            at, length = last + 1, int(lengths[i])
            score = float(scores[i]) + best[at - length]
            if score > best[at]:
                best[at], start[at], by[at] = score, at - length, i
        pass_to(n)
        ids: list[int] = []
        while n:
            if by[n] >= 0:
                ids.append(by[n])
            else:
                ids += [self.byte_ids[b] for b in reversed(word[start[n] : n].encode("utf-8", "surrogatepass"))]
            n = start[n]
        return ids[::-1]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same search over many short words at once: all ids, how many each word has, and which words it left out.

        One pass of the automaton meets the pieces of all words; position by position from the words' beginnings, each
        position of every word takes the best of the pieces that end there (the longest of equal ones). Words with a
        character that no piece covers are left out.
        """
        size = np.array([len(w) for w in words], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        joined = _END.join(words)
        met = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), dtype=np.int64)
        ends, ids = met[0::2] + 1, met[1::2]
        place = ends - np.repeat(first, size + 1)[ends - 1]
        by_place = np.argsort(place, kind="stable")  # of one end the longest piece comes first
        ends, ids, place = ends[by_place], ids[by_place], place[by_place]
        starts, scores = ends - self.lengths[ids], self.scores[ids]
        best, by = np.full(len(joined) + 1, -np.inf), np.full(len(joined) + 1, -1, dtype=np.int64)
        best[first] = 0.0
        longest = int(size.max())
        cuts = np.searchsorted(place, np.arange(1, longest + 2))
        for t in range(longest):
            here = slice(cuts[t], cuts[t + 1])
            end, score = ends[here], scores[here] + best[starts[here]]
            if len(end):
                new = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
                top = np.maximum.reduceat(score, new)
                group = np.cumsum(np.concatenate([[0], (end[1:] != end[:-1]).astype(np.int64)]))
                hits = np.flatnonzero(score == top[group])[::-1]
                pick = np.empty(len(new), dtype=np.int64)
                pick[group[hits]] = hits  # the last written is the first that has the best score
                best[end[new]], by[end[new]] = top, cuts[t] + pick
        # a position that no piece reaches: unknown characters
        inside = np.ones(len(joined) + 1, dtype=bool)
        inside[first] = False
        out = np.zeros(len(words), dtype=bool)
        lost = np.flatnonzero(inside & np.isinf(best))
        out[np.searchsorted(first, lost, side="right") - 1] = True
        at, word, found = (first + size)[~out], np.flatnonzero(~out), []
        counts = np.zeros(len(words), dtype=np.int64)
        while len(at):
            found.append((word, ids[by[at]]))
            counts[word] += 1
            at = starts[by[at]]
            on = at > first[word]
            at, word = at[on], word[on]
        values = np.zeros(int(counts.sum()), dtype=np.int64)
        last = np.cumsum(counts)
        for step, (word, i) in enumerate(found):
            values[last[word] - 1 - step] = i
        return values, counts, out

    def _alone(self, word: str) -> list[int]:
        if BLANK not in word:
            return self.search(word.replace(" ", BLANK))
        mark = [self.byte_ids[b] for b in BLANK.encode()]  # the mark itself is no blank here
        parts = word.split(BLANK)
        ids = self.search(parts[0].replace(" ", BLANK))
        for part in parts[1:]:
            ids += mark + self.search(part.replace(" ", BLANK))
        return ids

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        short = np.array([len(w) <= LONG_WORD and _END not in w and BLANK not in w for w in words], dtype=bool)
        # a character that no piece has leaves its word to the plain search
        counts, parts = np.zeros(len(words), dtype=np.int64), {}
        together, many = np.zeros(0, dtype=np.int64), np.flatnonzero(short)
        some = []
        for first in range(0, len(many), TOGETHER):
            at = many[first : first + TOGETHER]
            found, counts[at], out = self._together([words[i].replace(" ", BLANK) for i in at.tolist()])
            some.append(found)
            short[at[out]] = False
        if some:
            together = np.concatenate(some)
        for i in np.flatnonzero(~short).tolist():
            parts[i] = np.array(self._alone(words[i]), dtype=np.int64)
            counts[i] = len(parts[i])
        if not parts:
            return together, counts
        values, ends = np.empty(int(counts.sum()), dtype=np.int64), np.cumsum(counts)
        values[np.repeat(short, counts)] = together
        for i, x in parts.items():
            values[ends[i] - counts[i] : ends[i]] = x
        return values, counts

    def _cut(self, text: str) -> list[str]:
        """The text, with a blank before it, cut before each run of blanks and, where no piece has them, around newlines."""
        if "  " in text or text[0] == " " or text[-1] == " " or _MARK in text:
            return _CUT.findall(" " + text)
        if "\n" not in text or not self.cuts_lines:
            return [" " + x for x in text.split(" ")]
        return list(filter(None, (" " + text).replace(" ", _MARK + " ").replace("\n", f"{_MARK}\n{_MARK}").split(_MARK)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where the texts begin and end."""
        words, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                cut = self._cut(t)
                words += cut
                sizes[i] = len(cut)
        order, distinct = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, dtype=np.int64), [])
        codes = WordTable.codes(distinct)
        slot = self.known.find(codes)
        new = np.flatnonzero(slot < 0)
        fresh, counts = self.words([distinct[i] for i in new.tolist()])
        pool = np.concatenate([self.known.pool[: self.known.used].astype("<i4"), fresh.astype("<i4")])
        starts, n = self.known.starts[slot].astype(np.int64), self.known.sizes[slot].astype(np.int64)
        starts[new], n[new] = self.known.used + np.cumsum(counts) - counts, counts
        ids = take(pool, starts[order], n[order])
        ends = np.concatenate([[0], np.cumsum(n[order])])
        short = np.fromiter((len(distinct[i]) <= LONG_WORD for i in new.tolist()), dtype=bool, count=len(new))
        self.known.add((codes[0][new[short]], codes[1][new[short]]), fresh[np.repeat(short, counts)], counts[short])
        return ids, ends[np.concatenate([[0], np.cumsum(sizes)])]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids])[1:].decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return held(("pieces", path), lambda: Codec(path))


def _with(docs: DataFrame, column: str, kind: str, make) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.drop(column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, GATHER_BYTES):
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {column: make(batch)})

    return docs.mapInArrow(run, extended(docs, f"{column} {kind}"))


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int); ``model`` is the path of a SentencePiece model file."""

    def make(batch: pa.RecordBatch) -> pa.Array:
        ids, bounds = codec(model).encode(batch.column(text).to_pylist())
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))

    return _with(docs, "ids", "array<int>", make)


def decode(docs: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``: the texts of the ids."""

    def make(batch: pa.RecordBatch) -> pa.Array:
        column = batch.column(ids)
        return pa.array([codec(model).decode(x.values.to_pylist() if x.is_valid else []) for x in column], pa.string())

    return _with(docs, "decoded", "string", make)


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_pieces, exact, ids``: whether the ids decode to the very text. One pass encodes and decodes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, GATHER_BYTES):
            texts, pieces = batch.column("text").to_pylist(), codec(model)
            ids, bounds = pieces.encode(texts)
            exact = [pieces.decode(ids[a:b].tolist()) == (t or "") for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({key: batch.column("key"), "n_pieces": pa.array(np.diff(bounds), pa.int64()), "exact": pa.array(exact, pa.bool_()), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_pieces long, exact boolean, ids array<int>")
