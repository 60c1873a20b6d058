"""Token ids as binary shards with a minimal perfect hash index from document keys to places in them.

Layout, below one folder:

``shards``    One file a shard, in ascending key order; one row is a block: ``shard``, ``block`` (its number in the
              shard), ``keys`` (array), ``offsets`` (array, one more than keys: where documents begin in the block) and
              ``payload`` (the ids as raw little-endian unsigned 32-bit integers).
``manifest``  For each block its file and the number of ids in all blocks before it.
``index``     One row for each bucket of keys, in bucket order: the level bit arrays of a minimal perfect hash, and by
              its slots a fingerprint and a place (``PLACE``): the shard and block, the number in the block of the key's
              first document, how many documents follow it there under the same key, and the first one's global start.
``more``      The further places of keys whose documents lie in several blocks (no rows where keys are unique).

A lookup hashes a key to its bucket, walks the bucket's levels to the slot and compares the stored fingerprint. It takes
constant time. Reading then opens only the files of the shards that the places name, joins their blocks on (shard, block)
and cuts the named documents out of the payload. A key that isn't there is told by its fingerprint (but for one in
2**32), and by the block's own keys in any case. Keys whose hashes agree in all 128 bits share an exact list.

Defined results: a null text counts as empty and gives only the end id. A null key is a key like others and sorts
first. Documents that share a key lie next to each other (ordered by the hash of their text) and are all found. An empty
table gives empty shards and an empty index. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.common import WordTable, gathered, held, new_folder, partitions, small_batches, stored, take

#: Keys of an index bucket, on average; a bucket is built in one Python call.
BUCKET_KEYS = 4096
#: A block is closed at this many ids; only a longer document makes a longer block.
BLOCK_IDS = 1 << 20
#: Words whose ids a worker keeps at most (some 30 bytes each), and the longest of them.
KEPT_WORDS, LONG_WORD = 900_000, 48
#: Texts are encoded together until they have this size.
GATHER_BYTES = 2 << 20
#: Places that are sent to all tasks at most (16 bytes each); beyond, Spark shuffles the blocks.
BROADCAST_PLACES = 500_000
#: Buckets by which the index's files are pruned at most.
PRUNE_BUCKETS = 64
#: A special token of the vocabulary; where the vocabulary lacks it, parts are encoded one by one.
MARK = "<|endoftext|>"
#: Bits of a level for each key that comes to it, and levels at most; keys beyond them go to an exact list.
GAMMA, MAX_LEVELS = 2.0, 48
END_ID = 2
#: Fixed order: what a slot holds of a place.
PLACE = {"shard": "<i4", "block": "<i4", "at": "<i4", "docs": "<i4", "start": "<i8"}

_CUT = "\x01"
#: White space beside white space or at an edge: such texts are encoded as they are.
_UNEVEN = re.compile(r"\s\s|^\s|\s$")
#: White space other than spaces and newlines.
_RARE = re.compile(r"[^\S \n]")


class Words:
    """A tokenizer, and the ids of words met before.

    The vocabulary's pre-tokenizer always starts a new pre-token at a single space between two other characters, and
    before and after a single newline. So words are encoded alone, and those that come often once only.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = WordTable(KEPT_WORDS, "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, each text's followed by ``end``, and where the texts begin and end.

        They are the ids that ``encode(text, add_special_tokens=False)`` gives.
        """
        words: list[str] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            cut = _words(t or "")
            words += cut
            sizes[i] = len(cut)
        order, distinct = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object))
        codes = WordTable.codes(distinct)
        slot = self.known.find(codes)
        new = np.flatnonzero(slot < 0)
        fresh = _encode_parts(self.tokenizer, distinct[new].tolist())
        counts = np.array([len(x) // 4 for x in fresh], dtype=np.int64)
        values = np.frombuffer(b"".join(fresh), dtype="<u4")
        used = self.known.used
        starts, n = self.known.starts[slot].astype(np.int64), self.known.sizes[slot].astype(np.int64)
        starts[new], n[new] = used + np.cumsum(counts) - counts, counts
        pool = np.concatenate([self.known.pool[:used].astype("<u4"), values, np.array([end or 0], dtype="<u4")])
        if end is not None:
            starts, n = np.append(starts, len(pool) - 1), np.append(n, 1)
            order = np.insert(order, np.cumsum(sizes), len(starts) - 1)
            sizes = sizes + 1
        ids = take(pool, starts[order], n[order])
        ends = np.concatenate([[0], np.cumsum(n[order])])
        short = np.fromiter((len(x) <= LONG_WORD for x in distinct[new]), dtype=bool, count=len(new))
        self.known.add((codes[0][new[short]], codes[1][new[short]]), values[np.repeat(short, counts)], counts[short])
        return ids, ends[np.concatenate([[0], np.cumsum(sizes)])]


def words(path: str) -> Words:
    return held(("tokens", path), lambda: Words(path))


def _words(text: str) -> list[str]:
    """Parts whose ids do not depend on what stands beside them: the text cut before single spaces and around single newlines."""
    if not text:
        return []
    if _CUT in text or "  " in text or "\n " in text or " \n" in text or text[0].isspace() or text[-1].isspace():
        return [text]
    if _RARE.search(text) and _UNEVEN.search(text):
        return [text]
    cut = text.replace(" ", _CUT + " ")
    if "\n" in text and "\n\n" not in text:
        cut = cut.replace("\n", f"{_CUT}\n{_CUT}")
    return cut.split(_CUT)


def _raw(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _encode_parts(tokenizer, parts: list[str]) -> list[bytes]:
    """Ids of each part alone. Many go to the tokenizer as one string, between newlines or marks that it never merges over."""
    mark, line = tokenizer.token_to_id(MARK), tokenizer.token_to_id("\u010a")  # the vocabulary's name of a newline
    out: list[bytes] = [b""] * len(parts)
    by_line, by_mark = [], []
    for first in range(0, len(parts), 1000):
        group = range(first, min(first + 1000, len(parts)))
        if line is not None and _apart([parts[i] for i in group]):
            by_line.append(list(group))
            continue
        plain = [i for i in group if line is not None and _apart([parts[i]])]
        marked = [i for i in group if i not in set(plain) and mark is not None and MARK not in parts[i]]
        by_line += [plain] if plain else []
        by_mark += [marked] if marked else []
        for i in set(group) - {*plain, *marked}:
            out[i] = _raw(tokenizer, parts[i])
    for groups, between, cut in ((by_line, "\n", line), (by_mark, MARK, mark)):
        for group, e in zip(groups, tokenizer.encode_batch_fast([between.join([parts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == cut), len(ids)) * 4
            whole, starts = ids.tobytes(), [0, *(ends[:-1] + 4).tolist()]
            for i, a, b in zip(group, starts, ends.tolist(), strict=True):
                out[i] = whole[a:b]
    return out


def _apart(parts: list[str]) -> bool:
    """Whether no part is blank or has white space but one leading space, and none holds the mark."""
    joined, bare = "\n".join(parts), [x.strip() for x in parts]
    return MARK not in joined and len(joined.split()) == len(parts) and all(y and (x == y or x == " " + y) for x, y in zip(parts, bare, strict=True))


def _blocks(schema: pa.Schema, path: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 0
        for batch in gathered(batches, GATHER_BYTES):
            ids, bounds = words(path).encode(batch.column("text").to_pylist(), end)
            keys, shard, first = batch.column("key"), batch.column("shard")[0].as_py(), 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK_IDS, side="right")) - 1)
                offsets, payload = bounds[first : last + 1] - bounds[first], ids[bounds[first] : bounds[last]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), keys[first:last]), pa.array([offsets], pa.list_(pa.int64())), pa.array([payload], pa.binary())], schema=schema)
                block, first = block + 1, last

    return encode


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """64 bits from 64 bits; one function for each seed."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return h ^ (h >> np.uint64(32))


def _at(h: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    """A hash's bit on a level. The second hash takes part, so that keys which share the first one part."""
    return (_mix(h ^ _mix(second, level + 1000), level) % np.uint64(size)).astype(np.int64)


def build_levels(h: np.ndarray, second: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all levels' bits, and which keys found no bit, for keys with the 64-bit hashes ``h`` and ``second``.

    On each level a key takes the bit that it alone maps to; those that collide go to the next level. The slot of a
    key is the number of set bits before its own. Keys that agree in both hashes collide on every level; they, and
    whatever else is left after ``MAX_LEVELS``, come after the slots, as an exact list.
    """
    sizes, bits, left = [], [], np.arange(len(h))
    while len(left) and len(sizes) < MAX_LEVELS:
        size = max(64, int(len(left) * GAMMA) + 63 & ~63)
        at = _at(h[left], second[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool), left


def slots(h: np.ndarray, second: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 where no level has its bit."""
    ranks = np.cumsum(bits) - 1
    out = np.full(len(h), -1, dtype=np.int64)
    base, open_ = 0, np.arange(len(h))
    for level, size in enumerate(sizes):
        at = _at(h[open_], second[open_], level, size) + base
        hit = bits[at]
        out[open_[hit]] = ranks[at[hit]]
        open_, base = open_[~hit], base + size
    return out


def _u64(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype=np.int64).view(np.uint64)


def _build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    h, second = _u64(pdf["h"]), _u64(pdf["second"])
    sizes, bits, left = build_levels(h, second)
    slot = slots(h, second, sizes, bits)
    slot[left] = np.iinfo(np.int64).max  # after the slots
    order = np.argsort(slot, kind="stable")
    rest = pdf.iloc[order[len(h) - len(left) :]]
    out = {"bucket": [pdf["bucket"].iloc[0]], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()], "rest": [rest[["h", "second"]].to_numpy(dtype="<i8").tobytes()]}
    out["prints"] = [second[order].astype("<u4").tobytes()]
    return pd.DataFrame(out | {c: [pdf[c].to_numpy()[order].astype(kind).tobytes()] for c, kind in PLACE.items()})


_FOUND = "h long, second long, shard int, block int, at int, docs int, start long"


def _find(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(keys) or not len(index):
        return pd.DataFrame({c: [] for c in ("h", "second", *PLACE)}).astype("int64")
    row = index.iloc[0]
    sizes = [int(x) for x in row["sizes"]]
    bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=sum(sizes)).astype(bool)
    h, second = _u64(keys["h"]), _u64(keys["second"])
    prints, rest = np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["rest"], "<i8").reshape(-1, 2)
    at, who = slots(h, second, sizes, bits), np.arange(len(h))
    same = (at >= 0) & (prints[np.maximum(at, 0)] == second.astype("<u4"))
    who, at = who[same], at[same]
    for i, (a, b) in enumerate(rest.tolist()):  # hardly ever any
        hits = np.flatnonzero((h.view(np.int64) == a) & (second.view(np.int64) == b))
        who, at = np.append(who, hits), np.append(at, np.full(len(hits), len(prints) - len(rest) + i))
    return pd.DataFrame({"h": keys["h"].to_numpy()[who], "second": keys["second"].to_numpy()[who]} | {c: np.frombuffer(row[c], kind)[at] for c, kind in PLACE.items()})


def _hash(key):
    return F.xxhash64(key, F.lit("slot"))


def _second(key):
    """Its low 32 bits are the fingerprint."""
    return F.xxhash64(F.lit("fingerprint"), key)


@dataclass(frozen=True)
class TokenStore:
    """Shards, manifest and index below ``path``."""

    spark: SparkSession
    path: str
    buckets: int

    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/shards")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def more(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/more")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The places of each distinct ``key`` of ``keys`` that the index has: ``key, shard, block, at, docs, start``."""
        asked = keys.select("key").distinct().select("key", _hash(F.col("key")).alias("h"), _second(F.col("key")).alias("second"))
        asked = asked.withColumn("bucket", F.pmod("h", F.lit(self.buckets)))
        index = self.index()
        named = [r[0] for r in asked.select("bucket").distinct().limit(PRUNE_BUCKETS + 1).collect()]
        if len(named) <= PRUNE_BUCKETS:
            index = index.where(F.col("bucket").isin(named))
        found = asked.select("h", "second", "bucket").groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_find, _FOUND)
        more = self.more()
        if not more.isEmpty():
            found = found.union(asked.select("h", "second").join(more, ["h", "second"]).select(found.columns))
        return asked.join(found, ["h", "second"]).select("key", *PLACE)

    def fetch(self, keys: DataFrame, digest_only: bool = False) -> DataFrame:
        """The documents of ``keys``: ``key, start, n_tokens, crc`` and, unless ``digest_only``, ``ids`` (binary).

        Only the files and the ranges of ids that the index names are read.
        """
        spark = self.spark
        at = stored(self.lookup(keys), "places")
        manifest = self.manifest()
        # as many files at most as there are shards
        files = [r[0] for r in manifest.join(at.select("shard").distinct(), "shard", "left_semi").select("file").distinct().collect()]
        shards = self.shards()
        key_type = shards.schema["keys"].dataType.elementType
        kind = f"key {key_type.simpleString()}, start long, n_tokens long, crc long" + ("" if digest_only else ", ids binary")
        if not files:
            return spark.createDataFrame([], kind)
        wanted = at.groupBy("shard", "block").agg(F.collect_set(F.struct("at", "docs", "start", "key")).alias("p"))
        wanted = wanted.select("shard", "block", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("at", "docs", "start", "key")])
        wanted = F.broadcast(wanted) if at.count() <= BROADCAST_PLACES else wanted
        named = spark.read.schema(shards.schema).parquet(*files).join(wanted, ["shard", "block"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    offsets, own = batch.column("offsets")[i].values.to_numpy(zero_copy_only=False), batch.column("keys")[i].values
                    payload = memoryview(batch.column("payload")[i].as_buffer())
                    first, docs, start, key = (batch.column(f"p_{c}")[i].values for c in ("at", "docs", "start", "key"))
                    first, docs, start = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (first, docs, start))
                    place = np.repeat(np.arange(len(first)), docs)
                    number = take(np.arange(len(own)), first, docs)
                    begin, end = offsets[number], offsets[number + 1]
                    mine = own.take(pa.array(number))
                    # a fingerprint may fit another key by chance: the block itself knows
                    true = np.array([a == b for a, b in zip(mine.to_pylist(), key.take(pa.array(place)).to_pylist(), strict=True)], dtype=bool)
                    parts = [payload[a * 4 : b * 4] for a, b in zip(begin[true].tolist(), end[true].tolist(), strict=True)]
                    out = {"key": mine.filter(pa.array(true)), "start": pa.array((start[place] + begin - offsets[first][place])[true]), "n_tokens": pa.array((end - begin)[true]), "crc": pa.array([zlib.crc32(x) for x in parts], pa.int64())}
                    yield pa.RecordBatch.from_pydict(out if digest_only else out | {"ids": pa.array([bytes(x) for x in parts], pa.binary())})

        return named.select("keys", "offsets", "payload", "p_at", "p_docs", "p_start", "p_key").mapInArrow(cut, kind)


def write_store(docs: DataFrame, key: str, text: str, tokenizer: str, path: str | None = None, end: int = END_ID) -> TokenStore:
    """Encodes ``docs`` and writes shards, manifest and index; ``tokenizer`` is the path of a tokenizers file."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    small_batches(spark)
    arrow, kind = to_arrow_type(docs.schema[key].dataType), docs.schema[key].dataType.simpleString()
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("keys", pa.list_(arrow)), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = pairs.repartitionByRange(partitions(spark), F.asc_nulls_first("key"), "tie").sortWithinPartitions(F.asc_nulls_first("key"), "tie")
    blocks = dealt.select(F.spark_partition_id().alias("shard"), "key", "text").mapInArrow(_blocks(schema, tokenizer, end), f"shard int, block int, keys array<{kind}>, offsets array<bigint>, payload binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards")

    sizes = shards.select("shard", "block", F.element_at("offsets", -1).alias("n"), F.size("keys").alias("n_keys"), F.input_file_name().alias("file"))
    totals = sizes.groupBy("shard").agg(F.sum("n").alias("total"))
    # one row for each shard: the only step in one task, over as many rows as there are shards
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_base"))
    inner = Window.partitionBy("shard").orderBy("block")
    manifest = sizes.withColumn("before", F.sum("n").over(inner) - F.col("n")).join(bases, "shard").select("shard", "block", (F.col("shard_base") + F.col("before")).alias("base"), "n", "n_keys", "file")
    manifest.write.parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")

    n = manifest.agg(F.sum("n_keys")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_KEYS))
    # in a block, documents of one key lie side by side: each run of them is a place
    firsts = F.expr("filter(sequence(0, size(keys) - 1), i -> i = 0 OR NOT keys[i] <=> keys[i - 1])")
    runs = shards.where(F.size("keys") > 0).join(manifest.select("shard", "block", "base"), ["shard", "block"]).withColumn("firsts", firsts)
    runs = runs.select("shard", "block", F.posexplode(F.expr("transform(firsts, (f, j) -> named_struct('key', keys[f], 'at', f, 'docs', coalesce(get(firsts, j + 1), size(keys)) - f, 'start', base + offsets[f]))")).alias("j", "r"))
    places = runs.select(F.col("r.key").alias("key"), F.struct("shard", "block", F.col("r.at").alias("at"), F.col("r.docs").alias("docs"), F.col("r.start").alias("start")).alias("place"))
    keyed = stored(places.groupBy("key").agg(F.min("place").alias("place"), F.count("*").alias("places")).select(_hash(F.col("key")).alias("h"), _second(F.col("key")).alias("second"), "key", "place", "places"), "keys")
    several = keyed.where("places > 1")
    more = places.join(several.select("key", "h", "second", F.col("place").alias("first")), places["key"].eqNullSafe(several["key"])).where("place <> first").select("h", "second", "place.*")
    more = more if not several.isEmpty() else spark.createDataFrame([], "h long, second long, shard int, block int, at int, docs int, start long")
    more.write.parquet(f"{path}/more")
    entries = keyed.select("h", "second", "place.*", F.pmod("h", F.lit(buckets)).alias("bucket")).repartitionByRange(max(1, min(buckets, partitions(spark))), "bucket")
    index = entries.groupBy("bucket").applyInPandas(_build_bucket, "bucket long, sizes array<int>, bits binary, rest binary, prints binary, " + ", ".join(f"{c} binary" for c in PLACE))
    index.write.parquet(f"{path}/index")
    return TokenStore(spark, path, buckets)
