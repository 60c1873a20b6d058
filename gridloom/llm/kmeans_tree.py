"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a sample of bounded size. Leaves that hold many vectors of the whole table are split again, each on
a sample of its own, until leaves are small or the tree has ``MAX_NODES`` nodes (it is sent to all tasks); so its depth
grows with the table. The leaves hold all vectors.

A search keeps the tree's nodes in a priority queue, by the query's inner product with a node's centre plus a share of
the query's length times the node's radius, opens the best one, and so meets the leaves best first. That share, and how
many leaves are visited, are calibrated: for some queries the true neighbours are found by brute force, and visits are
widened until the wanted share of those neighbours lies in the visited leaves.

Spark deals vectors out by shelf (neighbouring leaves, or part of a large one, of bounded size) and the queries of a
shelf by blocks of bounded size; a task compares one block with one shelf, so neither a crowded leaf nor many queries
meet in one task. Each pair gives a query's best ``k``, and Spark keeps the best of all.

Of equal vectors only the ``k + 1`` smallest ids can be among a query's neighbours, so only these are dealt out.

Defined results: vectors that are null, all zero, or hold null or non-finite parts take no part, nor do rows without an
id. Vectors of different lengths have no inner product: each length is searched by itself. Rows that repeat both id and
vector count once. Equal scores go to the smaller id. An empty table has no neighbours. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, stored

#: Vectors that the tree is fitted on, at most about; children of a node; sampled vectors in a leaf, about.
FIT_VECTORS = 20_000
BRANCH = 8
LEAF_VECTORS = 64
#: Leaves with more vectors are split again, on about so many of them, while the tree has room.
SPLIT_VECTORS, SPLIT_SAMPLE = 2048, 2000
MAX_NODES = 32_768
#: Queries that visits are calibrated on, about, and the share of their true neighbours that visits must reach.
CALIBRATION_QUERIES = 128
RECALL = 0.95
#: Shares of the radius that are tried.
RADIUS_SHARES = (0.0, 0.25, 0.5, 1.0)
#: Vectors of a shelf, and queries of a block, that one task holds at once, about.
PART_VECTORS, BLOCK_QUERIES = 8192, 512
#: Queries that are compared in one product, and spare candidates that are scored exactly.
AT_ONCE, SPARE = 256, 16


@dataclass
class Tree:
    """Nodes in one list: centre, radius, children (none: a leaf, with its number)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    radius: np.ndarray | None = None
    share: float = 1.0

    @property
    def leaf_nodes(self) -> np.ndarray:
        """The node of each leaf."""
        nodes = np.flatnonzero(self.leaf >= 0)
        return nodes[np.argsort(self.leaf[nodes])]

    def split(self, leaf: int, below: Tree) -> None:
        """Puts the tree ``below`` in the place of a leaf; leaves are numbered anew."""
        node, first = int(self.leaf_nodes[leaf]), len(self.centres)
        self.centres = np.concatenate([self.centres, below.centres[1:]])
        self.children += [[kid + first - 1 for kid in kids] for kids in below.children[1:]]
        self.children[node] = [kid + first - 1 for kid in below.children[0]]
        self.leaf = np.concatenate([self.leaf, np.zeros(len(below.centres) - 1, dtype=np.int64)])

    def number(self) -> None:
        """Numbers the leaves so that those below one node come together."""
        self.leaf = np.full(len(self.centres), -1, dtype=np.int64)
        work, n = [0], 0
        while work:
            node = work.pop()
            if self.children[node]:
                work += self.children[node][::-1]
            else:
                self.leaf[node], n = n, n + 1

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree by the nearest centre."""
        at, out = np.zeros(len(vectors), dtype=np.int64), np.full(len(vectors), -1, dtype=np.int64)
        while (open_ := np.flatnonzero(out < 0)).size:
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                if self.leaf[node] >= 0:
                    out[rows] = self.leaf[node]
                else:
                    kids = np.array(self.children[node])
                    at[rows] = kids[_nearest(vectors[rows], self.centres[kids])]
        return out

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        length, bounds = float(np.linalg.norm(query)), self.centres @ query
        bounds = bounds + self.share * length * self.radius
        queue = [(-bounds[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (-bounds[kid], kid))


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def fit_tree(sample: np.ndarray, branch: int = BRANCH, leaf_vectors: int = LEAF_VECTORS, rounds: int = 8, seed: int = 11) -> Tree:
    """Splits the sample by k-means again and again, until a part has few vectors or its vectors are all alike."""
    rng = np.random.default_rng(seed)
    centres, children, leaf, n_leaves = [sample.mean(axis=0)], [[]], [-1], 0
    work = [(0, sample)]
    while work:
        node, rows = work.pop()
        own = None
        if len(rows) > leaf_vectors:
            distinct = np.unique(rows, axis=0)
            if len(distinct) > 1:
                own = distinct[rng.choice(len(distinct), min(branch, len(distinct)), replace=False)]
                for _ in range(rounds):
                    near = _nearest(rows, own)
                    own = np.array([rows[near == i].mean(axis=0) for i in np.unique(near)])
                near = _nearest(rows, own)
                own = own[np.unique(near)]
        if own is None or len(own) < 2:
            leaf[node], n_leaves = n_leaves, n_leaves + 1
            continue
        near = _nearest(rows, own)
        for i, centre in enumerate(own):
            if (near == i).any():
                children[node].append(len(centres))
                work.append((len(centres), rows[near == i]))
                centres.append(centre)
                children.append([])
                leaf.append(-1)
    out = Tree(np.array(centres), children, np.array(leaf))
    out.number()
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (array of double): the rows that take part, repeated ones once."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False))).dropDuplicates(["id", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` with the same rows of ``b``, in double precision, added in the order of the parts."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def top_k(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, able: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, ids and exact scores of each query's best ``k`` of ``vectors`` other than its own row.

    ``able`` says which vectors a query may have. A fast product picks some more candidates than are wanted; where their
    last one is clearly worse than what is wanted, no other can be better, else all close ones are scored exactly.
    """
    rough = queries @ vectors.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if able is not None:
        rough[~able] = -np.inf
    n, many = len(ids), min(len(ids), k + SPARE)
    picked = np.argpartition(rough, n - many, axis=1)[:, n - many :]
    value = np.take_along_axis(rough, picked, 1)
    wanted = np.partition(value, max(0, many - k), axis=1)[:, max(0, many - k)]
    finite = np.where(np.isfinite(rough), np.abs(rough), 0).max(axis=1, initial=0)
    least = np.where(np.isfinite(wanted), wanted - 1e-9 * (1 + finite), -np.inf)
    unsure = np.flatnonzero((value.min(axis=1) >= least) & (many < n) & np.isfinite(wanted))
    sure = np.ones(len(queries), dtype=bool)
    sure[unsure] = False
    rows, cols = np.repeat(np.arange(len(queries))[sure], many), picked[sure].ravel()
    for q in unsure:
        near = np.flatnonzero(rough[q] >= least[q])
        rows, cols = np.append(rows, np.full(len(near), q)), np.append(cols, near)
    real = np.isfinite(rough[rows, cols])
    rows, cols = rows[real], cols[real]
    score = exact_scores(queries[rows], vectors[cols])
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = place < k
    return rows[best], ids[cols[best]], score[best]


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query with their rank; Spark drops the rest before it shuffles."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_PAIR = "query_id long, vec_id long, score double"
_FOUND = "query_id long, rank int, vec_id long, score double"


def brute_force(vectors: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """True neighbours of a bounded set of queries among all ``vectors`` (``id, v``), block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, i, s = top_k(queries, query_ids, _matrix(batch.column("v")), batch.column("id").to_numpy(), k)
                yield pa.RecordBatch.from_pydict({"query_id": query_ids[q], "vec_id": i, "score": s})

    return _best(vectors.mapInArrow(run, _PAIR), k)


def search(vectors: DataFrame, is_query, k: int, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row for which ``is_query(id)`` holds."""
    small_batches(vectors.sparkSession, 1024)
    rows = stored(usable(vectors, key, vector), "vectors")
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().collect()]  # one row for each length
    found = [_search(rows.where(F.size("v") == n) if len(lengths) > 1 else rows, is_query, k, recall) for n in sorted(lengths)]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], _FOUND)


def _share(n: int, of: int, salt: str):
    """About ``n`` of ``of`` rows, by a hash of the id."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, n / max(of, 1))) + 1


def _place(rows: DataFrame, tree: Tree) -> tuple[DataFrame, np.ndarray]:
    """``id, v, leaf, off`` (the distance from the leaf's centre), and how many vectors each leaf has. Sets the radii."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            leaf = tree.assign(v)
            off = np.linalg.norm(v - tree.centres[tree.leaf_nodes[leaf]], axis=1) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": batch.column("v"), "leaf": pa.array(leaf, pa.int64()), "off": pa.array(off)})

    placed = stored(rows.mapInArrow(place, "id long, v array<double>, leaf long, off double"), "leaves")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("off").alias("off")).toArrow()  # one row a leaf
    count, radius = np.zeros(tree.leaves, dtype=np.int64), np.zeros(tree.leaves)
    count[sizes.column("leaf").to_numpy()], radius[sizes.column("leaf").to_numpy()] = sizes.column("n").to_numpy(), sizes.column("off").to_numpy()
    tree.radius = _radii(tree, radius)
    return placed, count


def _grown(tree: Tree, placed: DataFrame, count: np.ndarray) -> bool:
    """Splits each large leaf on a sample of its own vectors, while the tree has room; whether it did."""
    room = (MAX_NODES - len(tree.centres)) * LEAF_VECTORS // (2 * SPLIT_SAMPLE)
    large = [int(i) for i in np.argsort(-count, kind="stable") if count[i] > SPLIT_VECTORS][: max(0, room)]
    if not large:
        return False
    shares = placed.sparkSession.createDataFrame([(i, float(min(1.0, SPLIT_SAMPLE / count[i]))) for i in large], "leaf long, share double")  # a row for each leaf that is split
    some = placed.join(F.broadcast(shares), "leaf").where(F.pmod(F.xxhash64("id", F.lit("split")), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("leaf", "v")

    leaf_vectors = LEAF_VECTORS

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        below = fit_tree(np.stack(pdf["v"].to_numpy()), leaf_vectors=leaf_vectors)
        parent = np.full(len(below.centres), -1)
        for node, kids in enumerate(below.children):
            parent[kids] = node
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[0], "node": np.arange(len(parent)), "parent": parent, "centre": list(below.centres)})

    trees = some.groupBy("leaf").applyInPandas(fit, "leaf long, node int, parent int, centre array<double>").toPandas()  # bounded by MAX_NODES
    split = False
    for leaf, nodes in trees.groupby("leaf"):
        nodes = nodes.sort_values("node")
        if len(nodes) > 1:
            children: list[list[int]] = [[] for _ in range(len(nodes))]
            for node, parent in zip(nodes["node"], nodes["parent"], strict=True):
                if parent >= 0:
                    children[parent].append(int(node))
            tree.split(int(leaf), Tree(np.stack(nodes["centre"].to_numpy()), children, np.zeros(0)))
            split = True
    tree.number()
    return split


def _search(rows: DataFrame, is_query, k: int, recall: float) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.where(_share(FIT_VECTORS, rows.count(), "fit")).orderBy("id").toArrow()  # bounded by FIT_VECTORS
    if not sample.num_rows:  # a few rows, none of them in the sample
        sample = rows.orderBy("id").limit(LEAF_VECTORS).toArrow()
    tree = fit_tree(_matrix(sample.column("v").combine_chunks()), leaf_vectors=LEAF_VECTORS)
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = stored(rows.withColumn("n", first).where(F.col("n") <= k + 1).select("id", "v"), "distinct")
    placed, count = _place(distinct, tree)
    while _grown(tree, placed, count):
        placed, count = _place(distinct, tree)

    queries = rows.where(is_query(F.col("id")))
    some = queries.where(_share(CALIBRATION_QUERIES, queries.count(), "calibrate")).dropDuplicates(["id"]).toArrow()
    visits = calibrate(tree, placed, _matrix(some.column("v").combine_chunks()), some.column("id").to_numpy(), k, recall) if some.num_rows else tree.leaves

    # shelves: leaves side by side up to PART_VECTORS, or a part of a larger leaf
    parts = np.maximum(1, -(-count // PART_VECTORS))
    shelf_of, shelf, held = np.zeros(tree.leaves, dtype=np.int64), 0, 0
    for leaf in range(tree.leaves):
        if held and (parts[leaf] > 1 or held + count[leaf] > PART_VECTORS):
            shelf, held = shelf + 1, 0
        shelf_of[leaf] = shelf
        held += count[leaf]
        if parts[leaf] > 1:
            shelf, held = shelf + parts[leaf], 0

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shelves, lists = [], [], []
            for i, q in enumerate(_matrix(batch.column("v"))):
                met, taken = 0, []
                for j, leaf in enumerate(tree.order(q)):
                    if j >= visits and met > k:
                        break
                    if count[leaf]:
                        taken.append(leaf)
                        met += count[leaf]
                taken = np.sort(np.array(taken, dtype=np.int64))
                on = shelf_of[taken]
                for x in np.unique(on):
                    mine = taken[on == x]
                    for part in range(parts[mine[0]]):
                        at.append(i)
                        shelves.append(x + part)
                        lists.append(mine)
            a = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict({"query_id": batch.column("id").take(a), "qv": batch.column("v").take(a), "shelf": pa.array(shelves, pa.int64()), "leaves": pa.array(lists, pa.list_(pa.int64()))})

    visited = stored(queries.select("id", "v").mapInArrow(visit, "query_id long, qv array<double>, shelf long, leaves array<bigint>"), "visits")
    blocks = visited.groupBy("shelf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))  # a row for each shelf
    visited = visited.join(F.broadcast(blocks), "shelf").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    where = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(tree.leaves), "first": shelf_of, "parts": parts}))
    shelved = placed.join(F.broadcast(where), "leaf").select("id", "v", "leaf", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shelf"))
    shelved = shelved.join(F.broadcast(blocks), "shelf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        v = v.sort_values("id")
        own, vectors, ids = q["query_id"].to_numpy(), np.stack(v["v"].to_numpy()), v["id"].to_numpy()
        kinds, kind = np.unique(v["leaf"].to_numpy(), return_inverse=True)
        out = []
        for i in range(0, len(own), AT_ONCE):
            some = slice(i, i + AT_ONCE)
            lists = q["leaves"].to_numpy()[some]
            visits_ = np.zeros((len(lists), len(kinds)), dtype=bool)
            row, leaf = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
            there = np.minimum(np.searchsorted(kinds, leaf), len(kinds) - 1)
            true = kinds[there] == leaf
            visits_[row[true], there[true]] = True
            a, b, s = top_k(np.stack(q["qv"].to_numpy()[some]), own[some], vectors, ids, k, visits_[:, kind])
            out.append(pd.DataFrame({"query_id": own[some][a], "vec_id": b, "score": s}))
        return pd.concat(out)

    pairs = visited.select("query_id", "qv", "leaves", "shelf", "block").groupBy("shelf", "block").cogroup(shelved.select("id", "v", "leaf", "shelf", "block").groupBy("shelf", "block")).applyInPandas(compare, _PAIR)
    return _best(pairs, k)


def _radii(tree: Tree, leaf_radius: np.ndarray) -> np.ndarray:
    """For each node how far from its centre a vector below it may lie."""
    out = np.zeros(len(tree.centres))
    for node in range(len(tree.centres) - 1, -1, -1):  # children come after their parents
        if tree.leaf[node] >= 0:
            out[node] = leaf_radius[tree.leaf[node]]
        else:
            kids = np.array(tree.children[node])
            out[node] = (np.linalg.norm(tree.centres[kids] - tree.centres[node], axis=1) + out[kids]).max()
    return out


def calibrate(tree: Tree, placed: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that the wanted share of the queries' true neighbours lies in them; sets the tree's share."""
    true = brute_force(placed.select("id", "v"), queries, ids, k).select("query_id", F.col("vec_id").alias("id"))
    where = placed.select("id", "leaf").join(F.broadcast(true), "id").select("query_id", "leaf").toArrow()  # k rows a query
    if not where.num_rows:
        return tree.leaves
    wanted, best = list(zip(where.column("query_id").to_pylist(), where.column("leaf").to_pylist(), strict=True)), (tree.leaves + 1, 1.0)
    for tree.share in RADIUS_SHARES:
        place = {int(i): {leaf: n for n, leaf in enumerate(tree.order(q))} for i, q in zip(ids, queries, strict=True)}
        ranks = np.sort([place[q][leaf] for q, leaf in wanted])
        best = min(best, (int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1, tree.share))
    tree.share = best[1]
    return best[0]
