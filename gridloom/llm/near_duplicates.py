"""N-gram Jaccard join with several global token orders.

A document's set holds its distinct word shingles as 64-bit hashes. Under any order of all shingles, two sets whose
Jaccard similarity reaches the threshold share a shingle among the first ``n - ceil(threshold * n) + 1`` of each (its
prefix). Three orders are used; all put shingles that many documents share last (by counts over the whole corpus, kept
in hashed buckets) and differ in how they order the others. A pair must share a prefix shingle under the first order to
be met at all, and must also share one under the second and third before the whole sets are compared. The two sizes of
a pair say how far its own prefixes reach: of sets of one size only about half of the prefix that other partners need.

Sets that are equal are one node, named by the hash of the set. Pairs inside a prefix shingle's list are not all
formed. First every node of a list is compared to the list's leader, the node with the fewest edits; a group of copies
mostly collapses to one component then. What is left are pairs in different components, and for near copies of one
leader those are found by their differences from it (see ``_left_pairs``), so a group's pairs aren't formed either.
A long list that holds a second group, strangers to its leader, gets a further leader first.
Every two different texts that reach the threshold end in one component, and nothing is capped.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing. A text with
fewer words than a shingle has its whole sequence as only shingle. Rows without a key get no component. Repeated rows
are equal sets. Rows that share a key but not the text are one document for the component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.common import Scratch, small_batches, stored

#: Words whose hashes a worker keeps at most.
#: Buckets for shingle counts: about so many for each document, within these bounds (powers of two). Any order is exact;
#: better counts make shorter lists.
BUCKETS_A_DOC = 16
BUCKET_BITS = (14, 22)
#: Shingles that are counted together.
COUNTED = 1 << 20
CHUNK = 4096
SALTS = 8
#: Prefixes of at most so many shingles keep 16 bits of each for the second and third order, longer ones 32.
SHORT_PREFIX = 64
#: Rows of a key and a number that are broadcast at most; beyond, Spark shuffles, with hot keys salted.
BROADCAST_KEYS = 500_000
JOIN_SALTS = 16
#: Lists in which nodes outside the largest component, times all nodes, exceed this get so many further leaders at most,
#: one after another; what is left after them is compared by the general way.
HEAVY_PAIRS, MORE_LEADERS = 16_384, 2
#: Names of sets that a task remembers, so that it writes the prefixes of a copied text once.
SEEN = 1 << 16

_U = np.uint64
#: Odd multipliers.
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93]
#: Bytes of a text that are hashed at once; longer words are hashed alone.
HASHED = 1 << 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ _U(_ODD[seed % 5])) * _U(_ODD[(seed + 1) % 5])
    return h ^ (h >> _U(29))


def _powers(base: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(HASHED, base, dtype=_U))])


#: A number for each byte, powers of an odd number and of its inverse modulo 2**64.
_BYTES, _POWERS, _BACK = _mixed(_mixed(np.arange(1, 257, dtype=_U) * _U(_ODD[4]), 1), 2), _powers(_ODD[0]), _powers(pow(_ODD[0], -1, 1 << 64))


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word: ASCII letters lower case, words parted by ASCII white space.

    A word's hash is the sum of its bytes' numbers times the power of their place in it, so all words come out of one
    running sum over the text.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    out = np.empty(len(starts), dtype=_U)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + HASHED, side="right"))
        if last == first:
            out[first] = xxhash.xxh64_intdigest(data[starts[first] : ends[first]].tobytes())
            first += 1
            continue
        base = starts[first]
        some = _BYTES[data[base : ends[last - 1]]]
        sums = np.zeros(len(some) + 1, dtype=_U)
        np.cumsum(some * _POWERS[: len(some)], out=sums[1:])
        out[first:last] = (sums[ends[first:last] - base] - sums[starts[first:last] - base]) * _BACK[starts[first:last] - base]
        first = last
    return _mixed(out, 3)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The text's set of shingles: sorted distinct 64-bit hashes."""
    codes = word_codes(text)
    if not len(codes):
        return codes
    if len(codes) < width:
        return np.array([xxhash.xxh64_intdigest(codes.tobytes(), seed=width)], dtype=_U)
    n = len(codes) - width + 1
    h = np.zeros(n, dtype=_U)
    for i in range(width):
        h = _mixed(h ^ codes[i : i + n], i)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def node_of(found: np.ndarray) -> int:
    """The name of a set: 64 bits, signed. Of 10**9 different sets two share a name with a chance of 1 in 40."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


@dataclass(frozen=True)
class Join:
    """Settings: shingles of ``width`` words, linked when ``den * intersection >= num * union``."""

    width: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def first(self, found: np.ndarray, ranks: np.ndarray, order: int) -> np.ndarray:
        """The prefix of a set under an order, in it: the rank of a shingle's bucket, then the order's own hash."""
        p = self.prefix(len(found))
        place = (ranks[(found & _U(len(ranks) - 1)).astype(np.int64)].astype(_U) << _U(56)) | (_mixed(found, order) >> _U(8))
        if p < len(found):
            some = np.argpartition(place, p - 1)[:p]
            found, place = found[some], place[some]
        return found[np.lexsort((found, place))]

    def overlap(self, n: int, other_n: int) -> int:
        """How many shingles linked sets of these sizes share at least."""
        return -(-self.num * (n + other_n) // (self.den + self.num))

    def reach(self, n, at, other_n, other_at):
        """Whether sets whose first common shingle has these places may still share enough from there on."""
        least = F.ceil(self.num * (n + other_n) / (self.den + self.num))
        return (n - at >= least) & (other_n - other_at >= least)

    def packed(self, prefix: np.ndarray) -> bytes:
        return prefix.astype("<u2" if len(prefix) <= SHORT_PREFIX else "<u4").tobytes()

    def may_share(self, a: bytes, n: int, b: bytes, other_n: int) -> bool:
        """Whether two packed prefixes have a shingle in common, as far as this pair's prefixes reach."""
        least = self.overlap(n, other_n)
        sides = [np.frombuffer(x, "<u2" if self.prefix(m) <= SHORT_PREFIX else "<u4")[: max(0, m - least + 1)] for x, m in ((a, n), (b, other_n))]
        if sides[0].dtype != sides[1].dtype:
            sides = [x.astype("<u2") for x in sides]
        return len(np.intersect1d(*sides)) > 0

    def shared(self, d, other_d, n, other_n):
        """Of two near copies' ``d`` and ``other_d`` differences from a third set, how many a link needs them to share.

        Linked sets of sizes n and other_n differ in (n + other_n) * (den - num) / (den + num) shingles at most.
        """
        return F.ceil((d + other_d - F.floor((n + other_n) * (self.den - self.num) / (self.den + self.num))) / 2).cast("int")

    def may_link(self, a, b):
        """By size alone."""
        return (self.den * F.least(a, b)) >= (self.num * F.greatest(a, b))


def _buckets(docs: int) -> int:
    return 1 << min(BUCKET_BITS[1], max(BUCKET_BITS[0], (BUCKETS_A_DOC * max(1, docs) - 1).bit_length()))


def nodes(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """``key, n, node`` of each row of ``docs`` (``key, text``), and how often each bucket's shingles occur, in chunks."""
    size = _buckets(docs.count())
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salt, some, held = np.zeros(size, dtype=np.int64), 0, [], 0
        for batch in batches:
            sets = [shingles(t, join.width) for t in batch.column("text").to_pylist()]
            if not sets:
                continue
            some += [(s & _U(size - 1)).astype(np.int32) for s in sets]
            held += sum(map(len, sets))
            if held >= COUNTED:
                counts += np.bincount(np.concatenate(some), minlength=size)
                some, held = [], 0
            names = [node_of(s) for s in sets]
            salt = names[0] % SALTS
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for s in sets], pa.int32()), pa.array(names, pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names=["key", "n", "node", "chunk", "salt", "counts"])
        if some:
            counts += np.bincount(np.concatenate(some), minlength=size)
        chunks = [(i // CHUNK, counts[i : i + CHUNK]) for i in range(0, size, CHUNK) if counts[i : i + CHUNK].any()]
        if chunks:
            none = pa.nulls(len(chunks))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(chunks), key_type), none.cast(pa.int32()), none.cast(pa.int64()), pa.array([c for c, _ in chunks], pa.int32()), pa.array([salt] * len(chunks), pa.int32()), pa.array([_pack(x) for _, x in chunks], pa.binary())], names=["key", "n", "node", "chunk", "salt", "counts"])

    key_type = to_arrow_type(docs.schema["key"].dataType)
    found = stored(docs.mapInArrow(run, f"key {kind}, n int, node long, chunk int, salt int, counts binary"), "shingle-sets")
    return found.where(F.col("chunk").isNull()).select("key", "n", "node"), found.where(F.col("chunk").isNotNull()).select("chunk", "salt", "counts")


def _pack(counts: np.ndarray) -> bytes:
    """A chunk of counts: the bytes of each (most counts are small), then all of them compressed."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + pa.compress(counts.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def _unpack(counts: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts[1:], counts[0] * CHUNK, codec="zstd", asbytes=True), f"<u{counts[0]}").astype(np.int64)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, dtype=np.int64)
    for x in pdf["counts"]:
        total += _unpack(x)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [_pack(total)]})


def bucket_ranks(counts: DataFrame, size: int) -> np.ndarray:
    """For each bucket how common its shingles are, in steps of a factor of 1.4 over the mean; of fixed size."""
    partial = counts.groupBy("chunk", "salt").applyInPandas(_add, "chunk int, counts binary")
    rows = partial.groupBy("chunk").applyInPandas(_add, "chunk int, counts binary").toArrow()  # size * 4 bytes at most
    total = np.zeros(max(size, CHUNK), dtype=np.float64)
    for c, x in zip(rows.column("chunk").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        total[c * CHUNK : (c + 1) * CHUNK] = _unpack(x)
    total = total[:size]
    return np.clip(np.floor(2 * np.log2(np.maximum(total, 1e-9) / max(total.mean(), 1e-9))), 0, 120).astype(np.uint8)


def prefixes(docs: DataFrame, join: Join, ranks: np.ndarray) -> DataFrame:
    """For each document of ``docs`` (``text``): ``node, n, first`` (array: order 0) and ``second, third`` (binary).

    The latter hold the low bits of the shingles (``SHORT_PREFIX``): enough to tell most pairs that share none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = [s for t in batch.column("text").to_pylist() if len(s := shingles(t, join.width))]
            names = [node_of(s) for s in sets]
            new = dict(zip(reversed(names), reversed(range(len(names))), strict=True))
            names, sets = [x for x in new if x not in seen], [sets[i] for x, i in new.items() if x not in seen]
            seen = {*seen, *names} if len(seen) < SEEN else set(names)
            low = lambda o: [join.packed(join.first(s, ranks, o)) for s in sets]
            yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "first": pa.array([join.first(s, ranks, 0).view(np.int64) for s in sets], pa.list_(pa.int64())), "second": pa.array(low(1), pa.binary()), "third": pa.array(low(2), pa.binary())})

    return docs.select("text").mapInArrow(run, "node long, n int, first array<bigint>, second binary, third binary")


def compared(pairs: DataFrame, marks: DataFrame, docs: DataFrame, keyed: DataFrame, join: Join, kept: Scratch | None = None) -> DataFrame:
    """``a, b, linked, delta`` of the pairs (``a, b``) that pass the other orders' prefixes, by the whole sets.

    ``delta`` holds the shingles that only one of the two has, or null where they are too many to be near copies.
    """
    scratch, kept = Scratch(), kept or Scratch()
    ends = scratch.stored(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
    if not (n_ends := ends.count()):
        return docs.sparkSession.createDataFrame([], "a long, b long, linked boolean, delta array<bigint>")
    marks = marks.join(F.broadcast(ends) if n_ends <= BROADCAST_KEYS else ends, "node", "left_semi")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that share a prefix shingle under the second and the third order too."""
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("an", "bn", "a2", "b2", "a3", "b3")]
            keep = [join.may_share(a2, an, b2, bn) and join.may_share(a3, an, b3, bn) for an, bn, a2, b2, a3, b3 in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: marks.select(F.col("node").alias(s), F.col("n").alias(f"{s}n"), F.col("second").alias(f"{s}2"), F.col("third").alias(f"{s}3"))
    close = scratch.stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(share, "a long, b long").distinct(), "pairs")
    wanted = close.select(F.col("a").alias("node")).union(close.select(F.col("b").alias("node"))).distinct()
    keys = scratch.stored(keyed.groupBy("node").agg(F.min("key").alias("key")).join(wanted, "node", "left_semi").select("key"), "keys")
    some = docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, join.width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": pa.array([node_of(s) for s in sets], pa.int64()), "items": pa.array([s.tobytes() for s in sets], pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, deltas = [], []
            for a, b in zip(batch.column("ai").to_pylist(), batch.column("bi").to_pylist(), strict=True):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                delta = np.setxor1d(a, b, assume_unique=True)
                both = (len(a) + len(b) - len(delta)) // 2
                linked.append(join.den * both >= join.num * (both + len(delta)))
                deltas.append(delta.view(np.int64) if len(delta) * join.num <= 4 * len(a) * (join.den - join.num) else None)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_()), "delta": pa.array(deltas, pa.list_(pa.int64()))})

    sets = scratch.stored(some.select("text").mapInArrow(build, "node long, items binary"), "sets")
    if sets.count() > sets.select("node").distinct().count():  # repeated rows
        sets = scratch.stored(sets.dropDuplicates(["node"]), "sets")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("items").alias(f"{s}i"))
    out = kept.stored(close.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ai", "bi").mapInArrow(compare, "a long, b long, linked boolean, delta array<bigint>"), "compared")
    scratch.drop(docs.sparkSession)
    return out


def connected(links: DataFrame, kept: Scratch | None = None) -> DataFrame:
    """``node, root`` for each node of ``links`` (``a, b``); the root is the component's smallest node.

    Alternates large stars (each node's larger neighbours move to its smallest) and small stars (the smaller ones do)
    until nothing changes; the number of rounds grows with the logarithm of the components' size.
    """
    now, before = Scratch(), Scratch()
    edges = now.stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state, n = None, edges.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _labelled(both.where(F.col("v") > F.col("u")), least, "u", "v", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _labelled(large, least, "u", "v", n).where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before.drop(links.sparkSession)
        now, before = before, now
        edges = now.stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = sums[0]
        if sums == state:
            break
        state = sums
    before.drop(links.sparkSession)
    if kept:
        kept.paths += now.paths
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _labelled(rows: DataFrame, labels: DataFrame, key: str, salt: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``labels`` (one row a key, ``n`` at most), where a key may have any share of the rows.

    A small ``labels`` is broadcast. A larger one is repeated for each salt, and a key's rows are dealt out by ``salt``.
    """
    if n <= BROADCAST_KEYS:
        return rows.join(F.broadcast(labels), key, how)
    many = labels.withColumn("salted", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    return rows.withColumn("salted", F.pmod(F.xxhash64(salt), F.lit(JOIN_SALTS)).cast("int")).join(many, [key, "salted"], how).drop("salted")


def _ordered(x, y) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _rooted(df: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    known = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return df.join(F.broadcast(known) if roots.count() <= BROADCAST_KEYS else known, node, "left").withColumn(root, F.coalesce(root, node))


def _left_pairs(lists: DataFrame, by_leader: DataFrame, roots: DataFrame, join: Join, scratch: Scratch) -> DataFrame:
    """Pairs of a list that may be linked, lie in different components and weren't compared yet: ``a, b``.

    In a list of near copies most nodes were compared to the leader, and two nodes' sets differ where one but not both
    of them differs from the leader. For a link that must be few shingles, so the two must share differences, at least
    ``o`` (``Join.shared``). That is a prefix filter again, among the differences, the rarest of a leader's first. One of
    the two (a stray) is outside the leader's component, so its differences are many, and hardly any pair is left. Pairs
    with a node that has no differences from the leader on record, or too few to bound ``o``, are formed from the list.
    """
    pivots = lists.select(F.col("leader").alias("pivot")).distinct()
    sided = by_leader.where("delta IS NOT NULL").select("a", "b", "delta")
    members = sided.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "delta").union(sided.select(F.col("b").alias("pivot"), F.col("a").alias("node"), "delta")).join(pivots, "pivot", "left_semi")
    members = members.join(lists.select("node", "n").distinct(), "node")
    members = _rooted(_rooted(members, roots), roots, "pivot", "pivot_root").withColumn("d", F.size("delta")).withColumn("stray", F.col("root") != F.col("pivot_root"))
    bounds = members.groupBy("pivot").agg(F.min("d").alias("least"), F.min(F.when(F.col("stray"), F.col("d"))).alias("least_stray"), F.max("n").alias("largest")).where("least_stray IS NOT NULL")
    shared = join.shared(F.col("d"), F.when(F.col("stray"), F.col("least")).otherwise(F.col("least_stray")), F.col("n"), F.col("largest"))
    members = scratch.stored(members.join(bounds, "pivot").withColumn("o", shared).select("pivot", "node", "n", "root", "stray", "delta", "d", "o"), "members")
    bounded = members.where("o >= 1")

    items = bounded.select("pivot", "node", F.explode("delta").alias("item"))
    rare = items.groupBy("pivot", "item").agg(F.count("*").alias("c"))
    first = items.join(rare, ["pivot", "item"]).groupBy("pivot", "node").agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("items"))
    firsts = bounded.where("o <= d").select("pivot", "node", "n", "root", "stray", "d", (F.col("d") - F.col("o") + 1).alias("p")).join(first, ["pivot", "node"])
    firsts = firsts.select("pivot", "node", "n", "root", "stray", "d", F.posexplode(F.slice("items", 1, F.col("p"))).alias("at", "i")).select("pivot", "node", "n", "root", "stray", "d", (F.col("at") + 1).alias("at"), F.col("i.item").alias("item"))
    one = firsts.where("stray").select("pivot", "item", F.col("node").alias("s"), F.col("n").alias("sn"), F.col("root").alias("sroot"), F.col("d").alias("sd"), F.col("at").alias("sat"))
    # the pair's own bound: the shared item must lie in both prefixes, and enough must be left beside it
    o = join.shared(F.col("d"), F.col("sd"), F.col("n"), F.col("sn"))
    able = (F.col("at") <= F.col("d") - o + 1) & (F.col("sat") <= F.col("sd") - o + 1) & (F.least("at", "sat") + F.least(F.col("d") - F.col("at"), F.col("sd") - F.col("sat")) >= o)
    near = one.join(firsts, ["pivot", "item"]).where((F.col("root") != F.col("sroot")) & join.may_link(F.col("n"), F.col("sn")) & able).select(*_ordered(F.col("s"), F.col("node")))

    sizes = lists.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("token", F.col("m.root").alias("main"))
    known = bounded.select(F.col("pivot").alias("leader"), "node", F.lit(True).alias("known"))
    mixed = lists.join(sizes, "token").join(known, ["leader", "node"], "left").withColumn("known", F.coalesce("known", F.col("node") == F.col("leader")))
    mixed = scratch.stored(mixed.select("token", "node", "n", "at", "root", "main", "known"), "mixed")
    strays = mixed.where("root <> main").select("token", F.col("node").alias("s"), F.col("n").alias("sn"), F.col("at").alias("sat"), F.col("root").alias("sroot"), F.col("known").alias("sknown"))
    fits = (F.col("root") != F.col("sroot")) & join.may_link(F.col("n"), F.col("sn")) & join.reach(F.col("n"), F.col("at"), F.col("sn"), F.col("sat"))
    cross = lambda x, y: x.join(y, "token").where(fits).select(*_ordered(F.col("s"), F.col("node")))
    return near.union(cross(strays.where("NOT sknown"), mixed)).union(cross(strays.where("sknown"), mixed.where("NOT known"))).distinct()


def components(docs: DataFrame, join: Join, key: str = "doc_id", text: str = "text", one_by_key: bool = True) -> DataFrame:
    """``key, n_shingles, component_id`` (the smallest key that links reach) for each row of ``docs``.

    Without ``one_by_key``, different texts of one key are not linked by it.
    """
    spark = docs.sparkSession
    small_batches(spark, 512)
    scratch = Scratch()
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    keyed, counts = nodes(docs, join)
    ranks = bucket_ranks(counts, _buckets(keyed.count()))
    marks = scratch.stored(prefixes(docs, join, ranks), "prefixes")
    lists = marks.select(F.posexplode("first").alias("at", "token"), "node", "n").select("token", "node", "n", "at")
    shared = lists.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token")
    lists = scratch.stored(lists.join(shared, "token", "left_semi").distinct(), "lists")
    marks = marks.select("node", "n", "second", "third").dropDuplicates(["node"])

    # the leader of a list: the node with the fewest prefix shingles of its own, so with the fewest edits
    own = scratch.stored(lists.groupBy("node").agg((F.expr(f"first(n) - ({join.num} * first(n) + {join.den} - 1) div {join.den} + 1") - F.count("*")).alias("own")), "own")
    drawn = F.struct("own", F.xxhash64("node", F.lit("leader")).alias("h"), F.col("node").alias("node"), F.col("n").alias("n"), F.col("at").alias("at"))
    leaders = lists.join(own, "node").groupBy("token").agg(F.min(drawn).alias("l"), F.count("*").alias("size")).select("token", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n"), F.col("l.at").alias("leader_at"), "size")
    lists = scratch.stored(lists.join(leaders, "token"), "lists")
    met = lists.where((F.col("node") != F.col("leader")) & join.may_link(F.col("n"), F.col("leader_n")) & join.reach(F.col("n"), F.col("at"), F.col("leader_n"), F.col("leader_at")))
    pairs = scratch.stored(met.select(*_ordered(F.col("node"), F.col("leader"))).distinct(), "candidates")
    by_leader = compared(pairs, marks, docs, keyed, join, scratch)
    links = by_leader.where("linked").select("a", "b")
    # keys with several nodes, and one of these that is not the empty set
    several = keyed.where(F.lit(one_by_key) & F.col("key").isNotNull()).groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.when(F.col("n") > 0, F.col("node"))).alias("one"))
    several = stored(several.where("low <> high AND one IS NOT NULL").select("key", "one"), "several")
    repeated = one_by_key and not several.isEmpty()
    if repeated:
        links = links.union(scratch.stored(keyed.where("n > 0").join(several, "key").where("node <> one").select(*_ordered(F.col("one"), F.col("node"))).distinct(), "same-key"))
    roots = scratch.stored(connected(links, scratch), "roots")

    # a list of two has no other pair
    lists = lists.where("size > 2").select("token", "node", "n", "at", "leader", "size")
    rooted = scratch.stored(_rooted(lists, roots), "lists")
    # a long list may hold a second group of near copies, which are strangers to its leader: it gets a leader of its own
    tried = None
    for _ in range(MORE_LEADERS):
        sizes = rooted.where(F.col("size") * F.col("size") > HEAVY_PAIRS).groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("m"))
        heavy = scratch.stored(sizes.where((F.col("all") - F.col("m.c")) * F.col("all") > HEAVY_PAIRS).select("token", F.col("m.root").alias("main")), "heavy")
        if heavy.isEmpty():
            break
        some = scratch.stored(rooted.join(heavy, "token").join(own, "node"), "lists")
        drawn = F.min(F.struct("own", F.xxhash64("node", F.lit("next")).alias("h"), F.col("node").alias("next"), F.col("n").alias("next_n"), F.col("at").alias("next_at"), F.col("root").alias("next_root"))).alias("l")
        strays = some.where("root <> main")
        leaders = (strays if tried is None else strays.join(tried, ["token", "node"], "left_anti")).groupBy("token").agg(drawn).select("token", "l.next", "l.next_n", "l.next_at", "l.next_root")
        leaders = scratch.stored(leaders, "leaders")
        named = leaders.select("token", F.col("next").alias("node"))
        tried = named if tried is None else tried.union(named)
        met = some.join(leaders, "token").where((F.col("root") != F.col("next_root")) & join.may_link(F.col("n"), F.col("next_n")) & join.reach(F.col("n"), F.col("at"), F.col("next_n"), F.col("next_at")))
        new = scratch.stored(met.select(*_ordered(F.col("node"), F.col("next"))).distinct().join(pairs, ["a", "b"], "left_anti"), "candidates")
        pairs = pairs.union(new)
        more = compared(new, marks, docs, keyed, join, scratch).where("linked").select("a", "b")
        if not more.isEmpty():
            links = links.union(more)
            roots = scratch.stored(connected(links, scratch), "roots")
            rooted = scratch.stored(_rooted(lists, roots), "lists")
    rest = scratch.stored(_left_pairs(rooted, by_leader, roots, join, scratch).join(pairs, ["a", "b"], "left_anti"), "candidates")
    more = compared(rest, marks, docs, keyed, join, scratch).where("linked").select("a", "b")
    if not more.isEmpty():
        roots = scratch.stored(connected(links.union(more), scratch), "roots")

    if repeated:  # a row without words belongs to its key's other rows
        keyed = keyed.join(several, "key", "left").select("key", "n", F.when((F.col("n") > 0) | F.col("one").isNull(), F.col("node")).otherwise(F.col("one")).alias("node"), ((F.col("n") > 0) | F.col("one").isNotNull()).alias("linked"))
    else:
        keyed = keyed.withColumn("linked", F.col("n") > 0)
    # the least key of a set, of a component, and back: partial sums first, so that a large group is a few rows
    own = keyed.where("linked AND key IS NOT NULL").groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("members"))
    n_roots = roots.count()
    own = scratch.stored(_labelled(own, roots, "node", "least", n_roots, "left").select("node", F.coalesce("root", "node").alias("root"), "least", "members"), "members")
    groups = scratch.stored(own.groupBy("root").agg(F.min("least").alias("least"), F.sum("members").alias("members")).where("members > 1").select("root", "least"), "groups")
    labels = stored(_labelled(own.select("node", "root"), groups, "root", "node", groups.count()).select("node", "least"), "labels")
    scratch.drop(spark)
    found = _labelled(keyed.select("key", "n", F.when(F.col("linked"), F.col("node")).alias("node")), labels, "node", "key", labels.count(), "left")
    return found.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("least", "key")).alias("component_id"))


def one_of_each(docs: DataFrame, join: Join, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id (rows without one come first).

    A row is known by its id and the hash of its text, so different texts of one id are judged each for itself. Rows
    that agree in both are copies of each other; of these the one stays whose JSON text comes first. Texts without
    words are in no group and all stay. Columns stay as they are.
    """
    spark = docs.sparkSession
    row = F.struct(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    named = docs.select(row.alias("name"), F.struct(*docs.columns).alias("row"))
    found = stored(components(named.select("name", F.col("row")[text].alias("text")), join, "name", "text", one_by_key=False).where("n_shingles > 0"), "components")
    gone = stored(found.where(F.col("component_id") < F.col("name")).select("name").distinct(), "gone")
    # names are compared null-safe, by their two parts
    parts = lambda c: [F.coalesce(F.col(f"{c}.id").cast("string"), F.lit("-")).alias("a"), F.col(f"{c}.tie").alias("b")]
    marked = named.select(*parts("name"), "row")
    kept = marked.join(F.broadcast(gone.select(*parts("name"))) if gone.count() <= BROADCAST_KEYS else gone.select(*parts("name")), ["a", "b"], "left_anti")
    again = stored(found.groupBy("name").count().where("count > 1").select(*parts("name")), "repeated")
    if again.isEmpty():
        return kept.select("row.*")
    again = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    first = kept.join(again, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.join(again, ["a", "b"], "left_anti").select("row.*").unionByName(first.select("row.*"))
