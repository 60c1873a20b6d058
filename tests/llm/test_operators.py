"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import compaction, kmeans_tree, langid, license_scan, line_dedup, mixing, near_duplicates, quality, queries, sentencepiece_viterbi, token_store
from gridloom.llm.common import new_folder

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a  b   c\n\n d", " x ", "foo\n bar \n", "x\x1c y", "don't we're'll", "<|endoftext|> a<|endoftext|>. b", "x² a²! 中文。 é̂", "▁ ▁x", "😀 y " * 3, "word " * 30_000, "a\tb\r\nc\vd"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


def odd_docs(spark):
    rows = [(i, t, ["en", None][i % 2], ["s1", None, "s2"][i % 3]) for i, t in enumerate(ODD)]
    return frame(spark, [*rows, rows[3], (None, "no key", "en", "s1"), (None, None, None, None)])


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_token_store_equals_the_library(spark):
    from tokenizers import Tokenizer

    encode = lambda t: np.array([*Tokenizer.from_file(BPE).encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(ODD)])
    store = token_store.write_store(docs, "doc_id", "text", BPE)
    got = {r["key"]: (r["start"], r["n_tokens"], r["crc"], bytes(r["ids"])) for r in store.fetch(docs.select(F.col("doc_id").alias("key"))).collect()}
    start = 0
    for i, t in enumerate(ODD):
        ids = encode(t)
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)


def test_token_store_keys(spark):
    docs = frame(spark, [(5, "b", "en", "s"), (5, "a", "en", "s"), (5, "a", "en", "s"), (1, "c", "en", "s"), (None, "d", "en", "s")])
    store = token_store.write_store(docs, "doc_id", "text", BPE)
    ask = spark.createDataFrame([(5,), (5,), (77,), (None,)], "key long")
    held = {}
    for r in store.lookup(ask).collect():
        held[r["key"]] = held.get(r["key"], 0) + r["docs"]
    assert held == {None: 1, 5: 3}
    assert store.fetch(ask).count() == 4
    empty = token_store.write_store(docs.limit(0), "doc_id", "text", BPE)
    assert empty.fetch(ask).count() == 0


def test_token_store_keys_of_many_blocks_and_types(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 7)
    monkeypatch.setattr(token_store, "BUCKET_KEYS", 3)
    rows = [(i % 5 if i % 7 else None, "word " * (i % 4)) for i in range(60)]
    for kind in ("smallint", "decimal(12,2)", "binary"):
        docs = spark.createDataFrame(rows, "key int, text string").select(F.col("key").cast("string").cast(kind).alias("key"), "text")
        store = token_store.write_store(docs, "key", "text", BPE)
        assert not store.more().isEmpty()
        found = store.fetch(docs.select("key")).collect()
        assert len(found) == 60 and sorted(r["start"] for r in found) == sorted({r["start"] for r in found})
        assert sum(r["n_tokens"] for r in found) == store.manifest().agg(F.sum("n")).first()[0]
        one = store.fetch(docs.select("key").where("key IS NOT NULL").limit(1)).collect()
        assert len(one) == sum(r["key"] == one[0]["key"] for r in found)
        # places that are joined by a shuffle give the same
        monkeypatch.setattr(token_store, "BROADCAST_PLACES", 0)
        assert sorted(map(repr, store.fetch(docs.select("key")).collect())) == sorted(map(repr, found))
        monkeypatch.setattr(token_store, "BROADCAST_PLACES", 500_000)


def test_token_store_reads_what_the_index_names(spark):
    docs = documents(spark).select("doc_id", "text")
    store = token_store.write_store(docs, "doc_id", "text", BPE)
    key = docs.orderBy("doc_id").select(F.col("doc_id").alias("key")).limit(1)
    files = [f for f in store.fetch(key).inputFiles() if "/shards/" in f]
    assert len(files) == 1 < len(store.shards().inputFiles())
    whole = store.fetch(docs.select(F.col("doc_id").alias("key")), digest_only=True)
    assert whole.count() == docs.count()
    # an index that names wrong places does not give these documents
    wrong = store.index().withColumn("at", F.expr("unhex(repeat('00', octet_length(at)))"))
    other = token_store.TokenStore(spark, new_folder(spark, "tokens"), store.buckets)
    for part in ("shards", "manifest", "more"):
        getattr(store, part)().write.parquet(f"{other.path}/{part}")
    wrong.write.parquet(f"{other.path}/index")
    assert other.fetch(docs.select(F.col("doc_id").alias("key")), digest_only=True).count() < docs.count()


def test_token_ids_of_fuzzed_texts():
    words = token_store.Words(BPE)
    rng = random.Random(1)
    alphabet = [" ", "\n", "a", "b", "é", "1", "'s", ".", ",", "\t", "\u00a0", "<|endoftext|>", "\r\n", "中", "😀", " the", "The", "\x01", "\u3000", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(6000)]
    for _ in range(2):  # the second time from the table
        ids, ends = words.encode(texts)
        want = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert all(ids[ends[i] : ends[i + 1]].tolist() == w.ids for i, w in enumerate(want))


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    h, second = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    sizes, bits, left = token_store.build_levels(h, second)
    assert sorted(token_store.slots(h, second, sizes, bits)) == list(range(5000)) and not len(left)
    assert token_store.build_levels(h[:0], second[:0])[0] == []


def test_perfect_hash_ends_for_equal_hashes():
    import pandas as pd

    h, second = np.array([7, 7, 9, 9, 11]), np.array([1, 2, 5, 5, 6])  # one hash alike; both alike; none
    rows = pd.DataFrame({"bucket": 0, "h": h, "second": second, "shard": 1, "block": 2, "at": np.arange(5), "docs": 1, "start": np.arange(5) * 10})
    index = token_store._build_bucket(rows)
    found = token_store._find(pd.DataFrame({"h": [7, 7, 9, 11, 12], "second": [1, 2, 5, 6, 8]}), index)
    assert sorted(zip(found["h"], found["second"], found["at"], strict=True)) == [(7, 1, 0), (7, 2, 1), (9, 5, 2), (9, 5, 3), (11, 6, 4)]


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    texts = [*ODD, "a b c d e f g h " * 3, "x\nx\nx\ny", "a b c d e f g h i a b c d e f g h", "# " * 50]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for r in quality.measures(docs).collect():
        want = plain_measures(texts[r["doc_id"]])
        assert tuple(r)[1:6] == want, texts[r["doc_id"]][:50]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.measures(docs.limit(0)).count() == 0


def test_cascade_keeps_columns_and_order_changes_nothing(spark):
    docs = documents(spark).withColumn("kept", F.lit("clash")).withColumn("failed", F.lit(1))
    all_rules = [quality.BASE, *quality.RULES]
    one = {r["doc_id"]: r["kept"] for r in quality.cascade(docs, order=all_rules).collect()}
    other = quality.cascade(docs, order=all_rules[::-1], features=("n_words",))
    assert one == {r["doc_id"]: r["kept"] for r in other.collect()}
    assert other.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "failed", "n_words"]
    assert 0.6 < np.mean(list(one.values())) < 1


def test_rules_are_ordered_by_what_they_reject_of_the_rest(spark):
    a, b, c, d = rules = [quality.Rule(n, lambda x: False) for n in "abcd"]
    # a rejects six documents; b five of these and none else; c one other, cheaply; d nothing
    measured = quality.Measured({"a": 1.0, "b": 1.0, "c": 0.5, "d": 0.1}, {0b0001: 1, 0b0011: 5, 0b0100: 1, 0: 9})
    assert quality.ordered(rules, measured) == [a, c, d, b]
    found = quality.measure(documents(spark), [quality.BASE, *quality.RULES])
    assert set(found.seconds) == {r.name for r in [quality.BASE, *quality.RULES]} and sum(found.rejected.values()) == documents(spark).count()
    asked = []
    chain = [quality.Rule("first", lambda x: True), quality.Rule("second", lambda x: asked.append(1) or False)]
    assert [r["failed"] for r in quality.cascade(documents(spark).limit(3).coalesce(1), order=chain).collect()] == ["first"] * 3


def test_more_quality_rules(spark):
    texts = {"digits": "12345 67890 a " * 20, "braces": "{x} {y} " * 20, "bullets": "- one thing here\n* two things\n\u2022 three\n-four", "trailing_off": "so it goes...\nand on\nand then\u2026"}
    for name, t in texts.items():
        assert [r.name for r in quality.RULES if r.rejects(quality.Features(t)) and r.name in texts] == [name]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_tree_search_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1500, 16)).astype(np.float32)
    m[100:160] = m[100]
    found = kmeans_tree.search(vectors(spark, [(i, [float(x) for x in v]) for i, v in enumerate(m)]), lambda x: x % 20 == 0, k=20).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 20):
        s = kmeans_tree.exact_scores(np.broadcast_to(m[q].astype(float), m.shape), m.astype(float))
        ids = np.delete(np.arange(1500), q)
        best = ids[np.lexsort((ids, -s[ids]))[:20]]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, 21)) and all(s[i] == score for _, i, score in mine)
        assert [x[1] for x in mine] == sorted((x[1] for x in mine), key=lambda i: (-s[i], i))
        hits += len(set(best) & {x[1] for x in mine})
    assert hits / (75 * 20) >= 0.9


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_tree_search_recall_on_embeddings(spark, sf):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    got = {}
    for r in kmeans_tree.search(table, lambda x: x % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = table.collect()
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    hits = 0
    for q in got:
        s = kmeans_tree.exact_scores(np.broadcast_to(m[ids == q][0], m.shape), m)
        s[ids == q] = -np.inf
        assert all(s[ids == i][0] == score for _, i, score in got[q])
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & {x[1] for x in got[q]})
    assert len(got) == (ids % 20 == 0).sum() and hits / (20 * len(got)) >= 0.9


def test_tree_grows_with_the_table(spark, monkeypatch):
    for name, value in (("FIT_VECTORS", 200), ("SPLIT_VECTORS", 60), ("SPLIT_SAMPLE", 50), ("LEAF_VECTORS", 15), ("PART_VECTORS", 64), ("BLOCK_QUERIES", 10)):
        monkeypatch.setattr(kmeans_tree, name, value)
    centres = np.random.default_rng(1).normal(size=(12, 8)) * 4
    m = centres[np.arange(1200) % 12] + np.random.default_rng(2).normal(size=(1200, 8)) * 0.3
    grown = []
    plain = kmeans_tree._grown
    monkeypatch.setattr(kmeans_tree, "_grown", lambda *a: grown.append(plain(*a)) or grown[-1])
    found = kmeans_tree.search(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>"), lambda x: x % 20 == 0, k=5).collect()
    assert grown[0] and not grown[-1]
    hits = 0
    for q in range(0, 1200, 20):
        s = m @ m[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:5]) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits / (60 * 5) >= 0.9


def test_tree_search_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(i, [float(i % 7), 1.0]) for i in range(3000, 3100)]
    found = kmeans_tree.search(vectors(spark, rows), lambda x: x % 20 == 0, k=20)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    m = np.array([v for _, v in rows])
    for q in range(0, 3100, 20):
        s = m @ m[q]
        s[q] = -np.inf
        assert [got[q][i] for i in range(1, 21)] == np.lexsort((np.arange(3100), -s))[:20].tolist()


def test_tree_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.5, 0.5])]
    out = kmeans_tree.search(vectors(spark, rows), lambda x: x % 20 == 0, k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, 1, 0.5), (0, 2, 8, 0.5)]
    assert kmeans_tree.search(vectors(spark, []), lambda x: x % 20 == 0, k=20).count() == 0


def test_mixing(spark):
    rows = [(i, "x" * (10 + i % 7), "en", ["a", "b", None][i % 3]) for i in range(3000)]
    docs = frame(spark, rows).withColumn("copy", F.lit("clash"))
    out = mixing.mix(docs, weights={"a": 2.0, "b": 1.0, None: 1.0}, epochs=2.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key"]
    mass = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = 2 * sum(len(t) for _, t, _, _ in rows)
    for name, share in (("a", 0.5), ("b", 0.25), (None, 0.25)):
        assert abs(mass[name] / total - share) < 0.03
    keys = [r["mix_key"] for r in out.collect()]
    assert keys == sorted(keys) and keys == [r["mix_key"] for r in mixing.mix(docs, {"a": 2.0, "b": 1.0, None: 1.0}, epochs=2.0).collect()]
    counts = sorted(r["n"] for r in out.where("source = 'a'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert counts[0] == 1 and counts[-1] > 3
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("row", "of", "id", "times", "cdf", "draws", "rate", "chars"))])
    assert sorted(r["mix_key"] for r in mixing.mix(clash, {"a": 2.0, "b": 1.0, None: 1.0}, epochs=2.0).collect()) == keys
    assert mixing.mix(odd_docs(spark)).count() >= 0
    heavy = mixing.mix(frame(spark, [(1, "abc", "en", "a"), (2, "abc" * 9999, "en", "b")]), {"a": 1.0, "b": 1.0}).groupBy("doc_id").count().collect()
    assert abs({r["doc_id"]: r["count"] for r in heavy}[1] - 5000) < 400


def test_compaction(spark):
    docs = documents(spark)
    table = compaction.ShardedTable(spark, new_folder(spark, "sharded"), target=4 << 20)
    parts = docs.randomSplit([1.0] * 9, seed=3)
    for part in parts[:5]:
        table.append(part.coalesce(1))
    before = table.manifest()
    assert len(before["files"]) == 5 and before["version"] == 5
    after = table.compact()
    assert len(after["files"]) == 1 and after["version"] == 6
    with pytest.raises(compaction.Conflict):
        table.commit(before, before["files"], before["schema"])
    for part in parts[5:]:
        table.append(part.coalesce(1))
    table.append(docs.limit(0))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, docs.collect()))
    assert sum(r["rows"] for r in table.shards().collect()) == docs.count()
    odd = odd_docs(spark).withColumn("path", F.lit("clash")).withColumn("file", F.lit(None).cast("string"))
    other = compaction.ShardedTable(spark, new_folder(spark, "sharded"))
    other.append(odd)
    other.append(odd)
    other.compact()
    assert sorted(map(repr, other.read().collect())) == sorted(map(repr, odd.union(odd).collect()))
    empty = compaction.ShardedTable(spark, new_folder(spark, "sharded"))
    assert empty.compact()["version"] == 0
    empty.append(odd.limit(0))
    assert empty.read().columns == odd.columns and empty.read().count() == 0


def test_ingest_merges_a_table_of_one_file(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert len(docs.inputFiles()) == 1
    table = compaction.ingest(docs.withColumn("arrival0", F.lit(1)), new_folder(spark, "sharded"), arrivals=8)
    state = table.manifest()
    assert state["version"] > 8 and len(state["files"]) < compaction.FANOUT
    assert compaction.KEEP_VERSIONS <= len(table.versions()) < state["version"] and table.read(table.versions()[0]).count() > 0
    assert sorted(map(tuple, table.read().drop("arrival0").collect())) == sorted(map(tuple, docs.collect()))
    # a lost commit leaves files that no version names
    lost = table._write(docs.limit(3))
    assert table.vacuum(3600) == [] and table.vacuum(-1) == [x["path"] for x in lost]
    assert table.read().count() == docs.count()
    empty = compaction.ingest(docs.limit(0), new_folder(spark, "sharded"), arrivals=3)
    assert empty.read().count() == 0 and empty.read().columns == docs.columns


def best_score(codec, word):
    """Plain dynamic programming over all substrings."""
    pieces = {p: codec.scores[i] for p, i in codec.automaton.items()}
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 16), end):
            score = pieces.get(word[start:end], codec.unknown if end - start == 1 else -np.inf)
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_sentencepiece_search_is_best_and_exact(spark):
    import sentencepiece

    codec = sentencepiece_viterbi.codec(PIECES)
    scores = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = ["▁theaeron", "▁hestth.", "▁中文①x", "▁▁a", "▁" + "ab" * 40, "▁Éretau***", "▁x\ny"]
    for w in words:
        ids = codec.search(w)
        cost = sum(scores.get_score(i) for i in ids if not scores.is_byte(i)) + codec.unknown * sum(c not in codec.single for c in w if c not in codec.single)
        assert cost == best_score(codec, w), w
    docs = odd_docs(spark).withColumn("ids", F.lit("clash"))
    rows = sentencepiece_viterbi.round_trip(docs, PIECES).collect()
    assert all(r["exact"] for r in rows) and len(rows) == docs.count()
    lib = {r["doc_id"]: r for r in sentencepiece_viterbi.encode(documents(spark), PIECES).limit(40).collect()}
    assert all(scores.decode(list(r["ids"])) == r["text"] for r in lib.values())
    assert sentencepiece_viterbi.round_trip(docs.limit(0), PIECES).count() == 0


def test_words_searched_together_are_those_searched_alone(spark):
    codec = sentencepiece_viterbi.codec(PIECES)
    words = {w for r in documents(spark).limit(60).collect() for w in codec._cut(r["text"])}
    words |= {" \n", "\n", " x\ty", " 中文①", " ①", " " + "ab" * 40, " \x00a", " ▁", "  ", " 😀😀", "of"}
    words = sorted(words)
    ids, counts = codec.words(words)
    ends = np.cumsum(counts)
    assert all(ids[e - n : e].tolist() == codec._alone(w) for w, e, n in zip(words, ends, counts, strict=True))
    texts = [t for t in ODD if t] + [r["text"] for r in documents(spark).limit(20).collect()]
    for _ in range(2):  # the second time from the table
        ids, ends = codec.encode(texts)
        for i, t in enumerate(texts):
            whole = codec._alone(" " + t) if len(t) < 2000 else None
            assert whole is None or ids[ends[i] : ends[i + 1]].tolist() == whole
            assert codec.decode(ids[ends[i] : ends[i + 1]].tolist()) == t


def plain_components(rows, width, num):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= num * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_components(spark, width, num):
    rng = random.Random(width)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(120)] for _ in range(4)]
    rows = []
    for _ in range(160):  # near copies around the threshold, and texts that share a passage
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join([*base[0][:30], *[f"u{rng.randrange(10**6)}" for _ in range(60)]])) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "One TWO"), (304, "one two one"), (305, " \n "), (306, rows[0][1].upper())]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows]).withColumn("key", F.lit("clash")).withColumn("node", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.components(docs, near_duplicates.Join(width, num)).collect()}
    assert got == plain_components(rows, width, num)


def test_components_of_two_groups_in_the_same_lists(spark, monkeypatch):
    """Two groups of near copies that share a long passage and are strangers otherwise, with pairs around the threshold."""
    rng = random.Random(11)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for g in range(3):
        own = [f"g{g}x{rng.randrange(10**6)}" for _ in range(12 + 4 * g)]
        for _ in range(40):
            w = [*shared, *own]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    want = plain_components(rows, 5, 80)
    for heavy, leaders in ((16, 2), (10**9, 2)):
        monkeypatch.setattr(near_duplicates, "HEAVY_PAIRS", heavy)
        monkeypatch.setattr(near_duplicates, "MORE_LEADERS", leaders)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.components(docs, near_duplicates.Join(5, 80)).collect()}
        assert got == want


def test_components_of_odd_rows(spark):
    join = near_duplicates.Join(3, 90)
    docs = odd_docs(spark)
    got = near_duplicates.components(docs, join).collect()
    assert len(got) == docs.count() and all((r["component_id"] is None) == (r["doc_id"] is None) for r in got)
    assert near_duplicates.components(docs.limit(0), join).count() == 0


def test_components_of_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(80)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "end"])
    a_, b_, c_ = near(a), near(b), near(c)
    a, b, c = map(" ".join, (a, b, c))
    rows = [(5, a), (5, b), (5, b), (5, None), (3, a_), (3, a_), (4, b_), (4, b_), (9, c), (9, c), (8, c_), (8, " "), (7, ""), (7, ""), (6, None), (10, "one two three four")]
    alone = plain_components(enumerate(t for _, t in rows), 3, 90)
    group = {i: {j for j in alone if alone[j][1] == alone[i][1]} for i in alone}
    for _ in rows:  # rows of one id are one document
        group = {i: set().union(*(group[j] for j in alone if j in group[i] or rows[j][0] in {rows[k][0] for k in group[i]})) for i in alone}
    want = sorted((rows[i][0], alone[i][0], min(rows[j][0] for j in group[i])) for i in alone)
    assert {(k, c) for k, _, c in want} == {(3, 3), (4, 3), (5, 3), (8, 8), (9, 8), (7, 7), (6, 6), (10, 10)}
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    join = near_duplicates.Join(3, 90)
    assert sorted(map(tuple, near_duplicates.components(docs, join).collect())) == want

    docs = docs.select(F.col("doc_id").alias("key"), "text").where("key > 7")
    keyed, counts = near_duplicates.nodes(docs, join)
    marks = near_duplicates.prefixes(docs, join, near_duplicates.bucket_ranks(counts, near_duplicates._buckets(keyed.count()))).dropDuplicates(["node"])
    pairs = spark.createDataFrame([sorted(near_duplicates.node_of(near_duplicates.shingles(t, 3)) for t in (c, c_))], "a long, b long")
    assert [r["linked"] for r in near_duplicates.compared(pairs, marks, docs, keyed, join).collect()] == [True]


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in near_duplicates.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def plain_profile(text, size=400):
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    low = " " + " ".join(low.split()) + " " if low.strip() else ""
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            g = low[i : i + n]
            if (n == 1 and g == " ") or (n == 3 and g[1] == " "):
                continue
            counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size], counts, code


def test_language_equals_the_plain_rank_order_method(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    sums = {}
    for i, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:  # fewer than the sample, so all
            for g, n in plain_profile(t)[1].items():
                own = sums.setdefault(lang, {})
                own[g] = own.get(g, 0) + n
    code = plain_profile("")[2]
    ranks = {lang: {g: n for n, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[:400])} for lang, c in sums.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in langid.identify(docs).collect()}
    for i, t, _ in rows:
        own = plain_profile(t)[0]
        held = zlib.crc32(str(i).encode()) % 3 == 1
        if not own:
            assert got[i] == ("und", 0.0, held)
            continue
        off = {lang: sum(abs(r[g] - n) if g in r else 400 for n, g in enumerate(own)) for lang, r in ranks.items()}
        best = min(sorted(off), key=off.get)
        assert got[i] == (best, 1.0 - off[best] / (400 * len(own)), held)


def test_language_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    assert len(langid.fit(documents(spark)).languages) == 2


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark).withColumn("lang_pred", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(documents(spark))).where("doc_id IS NOT NULL").collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and got[0]["score"] == 0.0
    assert all(r["lang_pred"] != "und" for i, r in got.items() if i > 2)
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
    keys = spark.range(50).select(F.col("id"), langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in keys)


def test_line_dedup(spark):
    shared = "A line that many sites carry at their foot."
    rows = [(i, f"own text number {i} of this very page\n{shared}\nand more of it {i} to read here", "en", f"s{i}") for i in range(12)]
    rows += [(20, shared, "en", "s1"), (21, None, "en", "s2"), (22, "", "en", "s3"), (23, "It.", "en", "s4"), (24, f"once more, a page with its own words and lines\n {shared} ", "en", None)]
    docs = frame(spark, [*rows, rows[0]]).withColumn("n_removed", F.lit("clash")).withColumn("hash", F.lit(1))
    got = {r["doc_id"]: r for r in line_dedup.remove(docs, sites=10).collect()}
    assert all(shared not in got[i]["text"] and got[i]["n_removed"] == 1 for i in [*range(12), 24] if i != 24)
    assert got[20]["text"] == shared and got[21]["text"] is None and got[22]["text"] == "" and got[23]["text"] == "It."
    clash = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("row", "n", "kept", "goes", "bad", "of"))])
    assert line_dedup.remove(clash).columns == [*[c for c in clash.columns if c != "n_removed"], "n_lines", "n_removed"]
    line_dedup.LOOKUP_HASHES, before = 0, line_dedup.LOOKUP_HASHES  # joined instead
    assert sorted(map(repr, line_dedup.remove(docs, sites=10).collect())) == sorted(map(repr, got_all := line_dedup.remove(docs, sites=10).collect())) and len(got_all) == docs.count()
    joined = {r["doc_id"]: r for r in got_all}
    line_dedup.LOOKUP_HASHES = before
    assert joined == got
    assert all(r["n_removed"] == 0 for r in line_dedup.remove(docs, sites=13).collect())
    assert line_dedup.remove(docs.limit(0)).count() == 0
    assert line_dedup.remove(odd_docs(spark)).count() == odd_docs(spark).count()


def test_line_dedup_takes_long_notices_out_of_short_pages(spark):
    import corpus_pipeline

    notice = "A notice that many sites carry, far longer than what their pages have to say for themselves."
    rows = [(i, f"page {i}\n{notice}", "en", f"s{i}") for i in range(12)] + [(20, f"\n{notice}\n \t\n{notice}", "en", "s1"), (21, f"{notice}\n中", "en", None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.remove_shared_lines(spark, frame(spark, rows), SF).collect()}
    assert got == {i: (f"page {i}", len(f"page {i}")) for i in range(12)} | {20: (rows[12][1], len(rows[12][1])), 21: ("中", 1)}


def test_line_dedup_judges_short_lines_by_their_spread(spark):
    rows = [(i, f"Subscribe now\n\n \t\nown words {i}\n 登录 \r\nIt.\n\t", "en", f"s{i % 11}") for i in range(12)] + [(20, "It.\nonly here", "en", "s12"), (21, "Subscribe now", "en", "s1")]
    rows[3:] = [(i, t.replace("It.", f"It {i}.") if i < 15 else t, lang, s) for i, t, lang, s in rows[3:]]  # now on 4 sites
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove(frame(spark, rows), sites=10).collect()}
    assert got == {i: (f"\n \t\nown words {i}\n{'It.' if i < 3 else f'It {i}.'}\n\t", 7, 2) for i in range(12)} | {20: ("It.\nonly here", 2, 0), 21: ("Subscribe now", 1, 0)}


def test_license_scan(spark):
    texts = {
        1: "Released under the MIT License. Licensed under the Apache License, Version 2.0; MIT licence",
        2: "This work is licensed under the GNU General Public License, version 3.",
        3: "Licensed under CC BY-NC 4.0. SPDX-License-Identifier: BSD-3-Clause",
        4: "admit license, mité license and mit license-free",
        5: None, 6: "", 7: "Public matters only",
    }
    docs = frame(spark, [(i, t, "en", "s") for i, t in texts.items()])
    got = {r["doc_id"]: r for r in license_scan.summary(docs.withColumn("spans", F.lit(1))).collect()}
    assert (got[1]["base_labels"], got[1]["labels"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == ("apache,mit", "apache,apache-2.0,mit", 2, 3, 8)
    assert got[2]["base_labels"] == "gpl" and got[2]["labels"] == "gpl,gpl-3.0"
    assert got[3]["labels"] == "bsd-3-clause,cc-by-nc-4.0" and got[3]["n_base"] == 0
    assert (got[4]["base_labels"], got[4]["first_word"], got[4]["n_words"]) == ("mit", 5, 8)
    assert all((got[i]["labels"], got[i]["score"], got[i]["first_word"]) == ("", 0.0, None) for i in (5, 6, 7))
    assert len(license_scan.rules()) > 200
    assert license_scan.summary(docs.limit(0)).count() == 0
    assert license_scan.summary(odd_docs(spark)).count() == odd_docs(spark).count()


def test_license_gates_miss_no_wrapped_notice(spark):
    texts = ["All\nrights reserved", "all  rights\treserved", "ALL-RIGHTS-RESERVED.", "all rights\r\n reserved", "placed in the public\ndomain", "Permission to use", "all rights kept"]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.summary(docs).collect()}
    assert got == dict.fromkeys(range(4), ("proprietary", 0.5)) | {4: ("public-domain", 0.8), 5: ("", 0.0), 6: ("", 0.0)}


def always(tree, test):
    """Whether each match of a parsed expression holds a literal run that passes the test."""
    run, runs = "", []
    for op, value in tree:
        if str(op) == "LITERAL":
            run += chr(value)
            continue
        runs.append(run)
        run = ""
        name = str(op)
        if name == "SUBPATTERN" and always(value[3], test) or name == "BRANCH" and all(always(x, test) for x in value[1]):
            return True
        if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0 and always(value[2], test):
            return True
    return any(map(test, [*runs, run]))


def test_license_gates_and_keywords_follow_from_the_rules():
    from re import _parser

    assert all(gate.isalpha() for gate in license_scan.GATES)
    rules = license_scan.rules()
    assert len({r.pattern for r in rules if r.priority}) > 300 and len(license_scan.CLAUSES) > 100
    for r in rules:
        tree = _parser.parse(r.pattern)
        assert always(tree, lambda x: any(gate in x for gate in license_scan.GATES)), r
        assert always(tree, lambda x, k=r.keyword: x.startswith(k) or f" {k}" in x), r


def samples_of(words):
    """A text for a signature: groups as their first choice, other signs as a plain word."""
    while (less := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?:\?|\{[0-9,]*\})?", r"\1", words)) != words:
        words = less
    words = re.sub(r"\[a-z0-9\]*\]?\+|\[a-z0-9\]\+", "name", words.replace("[a-z0-9]+", "name"))
    return re.sub(r"\.\{[0-9,]*\}", "", words).replace(" ?", " ").replace("[cs]", "c").replace("?", "")


def test_each_clause_is_found_with_line_breaks_inside(spark):
    docs = frame(spark, [(i, "Own words.\n" + samples_of(words).replace(" ", "\n") + "\nMore.", "en", "s") for i, (_, words, _, _) in enumerate(license_scan.CLAUSES)])
    spans = license_scan.scan(docs.withColumn("norm", F.lit("clash")).withColumn("found", F.lit(1)).withColumn("row", F.lit(2)))
    assert spans.columns == ["doc_id", "text", "lang", "source", "n_chars", "norm", "found", "row", "n_words", "base", "spans"]
    for r in spans.collect():
        label, words, priority, _ = license_scan.CLAUSES[r["doc_id"]]
        inside = [x for x in r["spans"] if x["prio"] >= priority]
        assert inside, (label, words)


def test_queries_return_their_columns(spark):
    kinds = lambda name: dict(queries.queries()[name](spark, SF).dtypes)
    assert queries.op3_kmeans_tree(spark, SF).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert kinds("op1_token_store") == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert kinds("op6_sentencepiece") == {"doc_id": "bigint", "n_pieces": "bigint", "exact": "boolean", "ids": "array<int>"}
    assert kinds("op7_ngram_jaccard") == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert kinds("op8_language_id") == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}


def test_queries_over_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_batches_are_only_ever_made_smaller(spark):
    from gridloom.llm.common import small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    small_batches(spark, 100)
    now = int(spark.conf.get(name))
    small_batches(spark, 5000)
    assert now <= 100 and int(spark.conf.get(name)) == now


def test_one_of_each_group_stays(spark):
    rng = random.Random(3)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "ab")
    near = lambda w: " ".join([*w[:-1], "end"])
    a_, b_, a, b = near(a), near(b), " ".join(a), " ".join(b)
    rows = [(3, a, "en", "s"), (2, a_, "en", "s"), (2, a_, "de", "s"), (2, b, "en", "s"), (1, b_, "en", "s"), (None, b, "en", "s"), (7, None, "en", "s"), (7, None, "en", "s"), (8, "", "en", "s"), (9, "one two", "en", "s"), (9, "one two", "en", "s")]
    docs = frame(spark, rows).withColumn("name", F.lit(1)).withColumn("row", F.lit(2)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    kept = near_duplicates.one_of_each(docs, near_duplicates.Join(5, 80))
    assert kept.columns == docs.columns
    assert sorted((repr(r["doc_id"]), repr(r["text"])[:9], r["lang"]) for r in kept.collect()) == sorted((repr(i), repr(t)[:9], lang) for i, t, lang in [(2, a_, "de"), (None, b, "en"), (7, None, "en"), (7, None, "en"), (8, "", "en"), (9, "one two", "en")])
    assert near_duplicates.one_of_each(docs.limit(0), near_duplicates.Join()).count() == 0
