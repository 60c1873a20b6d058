"""Number theory, codecs, streams and registries against plain Python."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import hashing, wide
from gridloom.operators import linalg, quorum, sorting
from gridloom.plans.registry import Registry, Strategy
from gridloom.sources import dense, records
from gridloom.streaming import incremental


def test_prime_powers(spark):
    assert sorted(r["q"] for r in wide.prime_powers(spark, 20).collect()) == [5, 7, 9, 11, 13, 16, 17, 19]
    assert [wide.prime_powers(spark, b).count() for b in (200, 2000)] == [46, 303]


def test_lcg_and_byte_stream(spark):
    assert [r["v"] for r in wide.lcg_matrix(spark, 2, 42).orderBy("i", "k").collect()] == [206659, 190736, 223713, 179590]
    assert wide.byte_stream(spark, "ecm:fixture", 1).first()["digest"] == "777f71a14b935f46861ad5ccfc023e2185027a89f4689e9fd39e6b723a1b52de"


def test_ladder_is_repeated_addition():
    n, a24, x = 1_000_003, 1234, 5678

    def affine(p):
        return None if p[1] % n == 0 else p[0] * pow(p[1], -1, n) % n

    for one in ((x, 1), (5 * x % n, 5)):  # the difference need not be affine
        point = {1: one, 2: wide._double(one, a24, n)}
        for k in range(3, 30):  # halves whose difference is the point itself
            half, rest = k // 2, k - k // 2
            point[k] = wide._double(point[half], a24, n) if half == rest else wide._add(point[rest], point[half], one, n)
        for k in range(1, 30):
            assert affine(wide._times(k, one, a24, n)) == affine(point[k])


def test_curves_find_factors(spark):
    n = 1_000_003 * 1_000_033
    powers = [r["q"] for r in wide.prime_powers(spark, 200).orderBy("p").collect()]
    out = wide.stage_one(wide.random_curves(spark, "ecm:fixture", n, 32), n, powers).collect()
    hits = sorted(r["curve"] for r in out if r["status"] == 2)
    assert hits == [2, 15, 19, 24] and all(n % int(r["result"], 16) == 0 for r in out)
    assert {r["result"] for r in out if r["curve"] in (2, 15)} == {f"{1_000_003:x}"}
    raw = wide.stage_one(wide.random_curves(spark, "ecm:fixture", n, 3), n, powers, compute_gcd=False).collect()
    assert [r["status"] for r in raw] == [0, 0, 0] and math.gcd(int(raw[2]["result"], 16), n) == 1_000_003
    first = wide.first_factor(spark, "ecm:fixture", n, powers, 32, wave=8).collect()
    assert [r["curve"] for r in first] == hits[:1] and 1 < int(first[0]["result"], 16) < n


def test_dense_files(spark, tmp_path):
    n, rng = 7, np.random.default_rng(1)
    a, b = rng.random((n, n), dtype=np.float32), rng.random((n, n), dtype=np.float32)
    path = tmp_path / "pair.bin"
    path.write_bytes(struct.pack("<I", n) + a.tobytes() + b.tobytes())
    got = {(r["mat"], r["i"], r["k"]): r["v"] for r in dense.read_pair(spark, str(path), rows=3).collect()}
    assert got == {(m, i, k): float(x[i, k]) for m, x in (("A", a), ("B", b)) for i in range(n) for k in range(n)}
    path.write_bytes(struct.pack("<I", n) + a.tobytes())
    with pytest.raises(Exception, match="not two"):
        dense.read_pair(spark, str(path)).collect()
    arrays = tmp_path / "array.bin"
    arrays.write_bytes(struct.pack("<I", 5) + np.arange(5, dtype="<f4").tobytes())
    rows = dense.array_chunks(spark, str(arrays), 2).orderBy("pos").collect()
    assert [(r["chunk"], r["v"]) for r in rows] == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)]
    cells = spark.createDataFrame([(m, i, k, float(x[i, k])) for m, x in (("A", a), ("B", b)) for i in range(n) for k in range(n)], "mat string, i long, k long, v float")
    dense.write_pair(cells, str(tmp_path / "out.bin"))
    assert (tmp_path / "out.bin").read_bytes() == struct.pack("<I", n) + a.tobytes() + b.tobytes()
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("out.bin")] == ["out.bin"]
    with pytest.raises(Exception, match="not the rows"):
        dense.write_pair(cells.where("NOT (mat = 'B' AND i = 3)"), str(tmp_path / "bad.bin"))


def test_matrices_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(-9, 9, (13, 10))
    rows = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(a)], "i long, row array<bigint>")
    got = {(r["i"], r["j"]): r["v"] for r in linalg.matmul_blocked(linalg.to_blocks(rows, 4, 3), linalg.to_blocks(rows, 5, 3)).collect()}
    assert got == {(i, j): int(v) for (i, j), v in np.ndenumerate(a @ a.T)}
    half = linalg.half_product(np.full((3, 17), 0.1), np.full((17, 2), 0.3))
    assert half.dtype == np.float32 and np.allclose(half, 17 * float(np.float16(0.1)) * float(np.float16(0.3)), rtol=1e-6)
    big = linalg.whole_product(np.array([[2**40, 3]]), np.array([[2**20], [5]]))
    assert big.tolist() == [[2**60 + 15]]
    b = spark.createDataFrame([(k, j, int(k * j) - 7) for k in range(10) for j in range(4)], "k int, j int, v long")
    want = {i: list(map(int, r)) for i, r in enumerate(a @ (np.outer(range(10), range(4)) - 7))}
    for limit in (1000, 1):
        monkeypatch.setattr(linalg, "BROADCAST_CELLS", limit)
        assert {r["i"]: list(r["row"]) for r in linalg.matmul_strips(rows, b, 4).collect()} == want
    image = rng.integers(-9, 9, (2, 6, 6))
    w = rng.integers(-3, 3, (3, 3))
    cells = spark.createDataFrame([(b, 0, y, x, int(v)) for (b, y, x), v in np.ndenumerate(image)], "b long, ic int, ih int, iw int, v long")
    weights = spark.createDataFrame([(0, 0, y, x, int(v)) for (y, x), v in np.ndenumerate(w)], "oc int, ic int, fh int, fw int, w long")
    for stride, padding in ((1, 0), (2, 1)):
        p = np.pad(image, ((0, 0), (padding, padding), (padding, padding)))
        side = (6 + 2 * padding - 3) // stride + 1
        want = {(b, y, x): int((p[b, y * stride : y * stride + 3, x * stride : x * stride + 3] * w).sum()) for b in range(2) for y in range(side) for x in range(side)}
        for limit in (1000, 1):
            monkeypatch.setattr(linalg, "BROADCAST_CELLS", limit)
            assert {(r["b"], r["oh"], r["ow"]): r["v"] for r in linalg.conv2d(cells, weights, 6, 6, 3, stride, padding).collect()} == want


def test_blocked_products_write_neither_copies_nor_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.integers(-900, 900, (23, 10))
    rows = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(a)], "i long, row array<bigint>")
    blocks = linalg.to_blocks(rows, 4, 3)
    out = linalg.matmul_blocked(blocks, blocks)
    above, found, _ = out._jdf.queryExecution().executedPlan().toString().partition("CartesianProduct")
    assert found and "Exchange" not in above
    want = {(i, j): int(v) for (i, j), v in np.ndenumerate(a @ a.T)}
    assert {(r["i"], r["j"]): r["v"] for r in out.collect()} == want
    monkeypatch.setattr(linalg, "CELL_ROWS", 7)
    for blocks_of_slice in (1, 2, 4):  # several slices are added as tiles
        monkeypatch.setattr(linalg, "SLICE_BLOCKS", blocks_of_slice)
        got = linalg.matmul_blocked(blocks, linalg.to_blocks(rows, 5, 3)).collect()
        assert len(got) == len(want) and {(r["i"], r["j"]): r["v"] for r in got} == want


def test_blocked_products_of_odd_rows(spark, monkeypatch):
    rows = [(0, [1, 2, None, 4, 5]), (1, [3]), (1, [10, 7]), (5, [None, None, 6]), (9, [2**31, 0, 0, 2**20]), (10**15, []), (11, None), (12, [None, None, None, 1])]
    df = spark.createDataFrame(rows, "i long, row array<bigint>")
    met = {}
    for i, x in rows:
        for j, y in rows:
            for v, w in zip(x or [], y or [], strict=False):
                met.setdefault((i, j), []).append(None if v is None or w is None else v * w)
    want = {at: None if set(v) == {None} else sum(x for x in v if x is not None) for at, v in met.items()}
    assert None in want.values()
    for blocks_of_slice in (256, 1):
        monkeypatch.setattr(linalg, "SLICE_BLOCKS", blocks_of_slice)
        blocks = linalg.to_blocks(df, 4, 2)
        got = linalg.matmul_blocked(blocks, blocks).collect()
        assert len(got) == len(want) and {(r["i"], r["j"]): r["v"] for r in got} == want
    assert linalg.matmul_blocked(linalg.to_blocks(df.where("i < 0")), blocks).count() == 0


def test_a_product_with_itself_is_written_in_less_space(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    a = rng.integers(-900, 900, (300, 9))
    rows = spark.createDataFrame([(i * 3, [int(x) for x in r]) for i, r in enumerate(a)], "i long, row array<bigint>")
    want = {(i * 3, j * 3): int(v) for (i, j), v in np.ndenumerate(a @ a.T)}
    monkeypatch.setattr(linalg, "PARTS", 2)

    def size(out, name: str) -> int:
        out.write.option("parquet.enable.dictionary#v", "false").parquet(str(tmp_path / name))  # large files go without
        got = spark.read.parquet(str(tmp_path / name)).collect()
        assert len(got) == len(want) and {(r["i"], r["j"]): r["v"] for r in got} == want
        return sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet"))

    for blocks_of_slice in (256, 1):
        monkeypatch.setattr(linalg, "SLICE_BLOCKS", blocks_of_slice)
        blocks = linalg.to_blocks(rows, 40, 3)
        alone, both = size(linalg.matmul_blocked(blocks, blocks), f"alone{blocks_of_slice}"), size(linalg.matmul_blocked(blocks, linalg.to_blocks(rows, 40, 3)), f"both{blocks_of_slice}")
        assert alone < 0.7 * both
    blocks = linalg.to_blocks(rows.where("i < 90"), 4)
    assert linalg.matmul_blocked(blocks, blocks, linalg.half_product, "float").distinct().count() == 900


def test_relational_products_meet_as_tiles_where_dense(spark, monkeypatch):
    rng = random.Random(8)
    a = [(rng.randint(0, 12) * 10**14, rng.randint(0, 9) * 7, rng.choice([None, rng.randint(-99, 99)])) for _ in range(150)] + [(3, None, 5)]
    b = [(rng.randint(3, 12) * 7, rng.randint(0, 11), rng.choice([None, rng.randint(-99, 99)])) for _ in range(150)]
    met = {}
    for i, k, v in a:
        for q, j, w in b:
            if k == q:
                met.setdefault((i, j), []).append(None if v is None or w is None else v * w)
    want = {at: None if set(v) == {None} else sum(x for x in v if x is not None) for at, v in met.items()}
    left, right = spark.createDataFrame(a, "i long, k int, v int"), spark.createDataFrame(b, "k long, j int, v long")
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    for sizes in ({}, {"PACK_CELLS": 40, "TILE_ROWS": 4}, {"SLICE_BLOCKS": 1, "BLOCK_COLS": 3}):
        for name, size in sizes.items():
            monkeypatch.setattr(linalg, name, size)
        out = linalg.matmul(left, right)
        assert "CartesianProduct" in plan(out) and out.dtypes == [("i", "bigint"), ("j", "int"), ("v", "bigint")]
        got = out.collect()
        assert len(got) == len(want) and {(r["i"], r["j"]): r["v"] for r in got} == want
    sparse = spark.range(300).selectExpr("id AS i", "id AS k", "1L AS v")
    out = linalg.matmul(sparse, sparse.withColumnRenamed("i", "j"))
    assert "CartesianProduct" not in plan(out) and out.count() == 300
    halves = linalg.matmul(left.withColumn("v", F.lit(0.5)), right)
    assert "CartesianProduct" not in plan(halves) and dict(halves.dtypes)["v"] == "double"


def test_relational_products_with_the_transpose(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    a = [(rng.randint(0, 40) * 10**13, rng.randint(0, 9) * 7, rng.choice([None, rng.randint(-99, 99)])) for _ in range(400)] + [(3, None, 5)]
    met = {}
    for i, k, v in a:
        for j, q, w in a:
            if k is not None and k == q:
                met.setdefault((i, j), []).append(None if v is None or w is None else v * w)
    want = {at: None if set(v) == {None} else sum(x for x in v if x is not None) for at, v in met.items()}
    odd = spark.createDataFrame(a, "i long, k int, v int")
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    for sizes in ({"TILE_ROWS": 4}, {"PACK_CELLS": 40}, {"SLICE_BLOCKS": 1, "BLOCK_COLS": 3}):
        for name, size in sizes.items():
            monkeypatch.setattr(linalg, name, size)
        out = linalg.matmul(odd)
        got = out.collect()
        assert "CartesianProduct" in plan(out) and len(got) == len(want) and {(r["i"], r["j"]): r["v"] for r in got} == want
    sparse = spark.range(300).selectExpr("id AS i", "id AS k", "2L AS v")
    assert sorted(map(tuple, linalg.matmul(sparse).collect())) == [(i, i, 4) for i in range(300)]
    monkeypatch.undo()
    monkeypatch.setattr(linalg, "PARTS", 2)
    monkeypatch.setattr(linalg, "TILE_ROWS", 40)
    x = np.random.default_rng(6).integers(-900, 900, (300, 9))
    dense = spark.createDataFrame([(i, k, int(v)) for (i, k), v in np.ndenumerate(x)], "i long, k int, v long")
    taken = []
    for name, out in (("alone", linalg.matmul(dense)), ("both", linalg.matmul(dense, dense.select("k", F.col("i").alias("j"), "v")))):
        out.write.option("parquet.enable.dictionary#v", "false").parquet(str(tmp_path / name))  # large files go without
        got = spark.read.parquet(str(tmp_path / name)).collect()
        assert len(got) == 90000 and {(r["i"], r["j"]): r["v"] for r in got} == {(i, j): int(v) for (i, j), v in np.ndenumerate(x @ x.T)}
        taken.append(sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet")))
    assert taken[0] < 0.7 * taken[1]


def test_sort_is_a_monotone_permutation(spark):
    values = [random.Random(5).randint(-50, 50) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    rows = sorted(sorting.global_rank(df, F.asc("v"), F.asc("id")).collect(), key=lambda r: r["place"])
    assert [(r["v"], r["id"]) for r in rows] == sorted((v, i) for i, v in enumerate(values))
    assert [r["place"] for r in rows] == list(range(1, 501))


def test_ranks_and_percentiles_of_few_large_groups(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(["a", "b", None][rng.randint(0, 2)], i, rng.randint(0, 40)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    groups = {g: sorted((v, i) for h, i, v in rows if h == g) for g in ("a", "b", None)}
    got = {r["i"]: r["place"] for r in sorting.rank_in_groups(df, "g", F.asc("v"), F.asc("i")).collect()}
    assert got == {i: n + 1 for some in groups.values() for n, (_, i) in enumerate(some)}
    found = {r["g"]: r["p"] for r in sorting.percentile(df, "g", "v", 95).collect()}
    assert all(abs(found[g] - np.percentile([v for v, _ in some], 95)) < 1e-9 for g, some in groups.items())
    monkeypatch.setattr(sorting, "PART_ROWS", 16)
    down = {r["g"]: (r["n"], r["descents"]) for r in sorting.descents(df.where("g IS NOT NULL"), "g", "i", "v").collect()}
    for g in "ab":
        v = [x for h, _, x in rows if h == g]
        assert down[g] == (len(v), sum(y < x for x, y in zip(v, v[1:], strict=False)))


def test_quorum_rules(spark):
    rows = [(1, "a", 1, "x", "x"), (1, "a", 2, "x", "x"), (1, "b", 3, "y", "y"), (1, "c", 4, "y", "y"), (1, "b", 5, "x", "x"), (2, "a", 6, "x", "z")]
    df = spark.createDataFrame(rows, "chunk long, client string, seq long, server_hash string, reported_hash string")
    assert [tuple(r) for r in quorum.first_to_k(df, 2).collect()] == [(1, "y", 4)]
    assert [tuple(r) for r in quorum.winners(df, 2).collect()] == [(1, "x", 2, 1)]
    assert quorum.winners(df, 3).count() == 0
    assert sorted(r["seq"] for r in quorum.in_time(df, 2).collect()) == [1, 2, 3, 4, 6]
    assert [(r["client"], r["seq"]) for r in quorum.winning_rows(df, 2).collect()] == [("a", 1)]


def test_exact_repeat_rule_in_both_forms(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted({(rng.randint(0, 4), 10**15 + t) for t in rng.sample(range(1000), 300)}, key=lambda r: r[1])
    df = spark.createDataFrame([(k, n, us) for n, (k, us) in enumerate(rows)], "k long, event long, us long")
    want, last = set(), {}
    for n, (k, us) in enumerate(rows):
        if k not in last or us - last[k] >= 5:
            want.add(n)
            last[k] = us
    assert {r["event"] for r in incremental.deduplicated(df, ["k"], 5).collect()} == want
    timed = df.withColumn("ts", F.timestamp_micros("us"))
    timed.orderBy("us").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.deduplicated_stream(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds"), ["k"], 5)
    stream.writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r["event"] for r in spark.table("kept").collect()} == want


def test_small_functions(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "t string")
    assert one.select(hashing.fnv1a(F.col("t")).alias("h")).first()["h"] == 0xE40C292C
    inputs = spark.createDataFrame([(1, '{"a":"YWI=","b":"Yw=="}'), (2, "ZA==")], "id long, payload string")
    assert sorted((r["id"], r["name"], bytes(r["bytes"])) for r in records.multi_inputs(inputs).collect()) == [(1, "a", b"ab"), (1, "b", b"c"), (2, "input", b"d")]
    manifest = records.write_outputs(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "output string, v long"), str(tmp_path / "out"))
    assert sorted((r["output"], r["rows"]) for r in manifest.collect()) == [("x", 2), ("y", 1)]
    assert math.gcd(*wide.draw("s", 91, 3), 91) == 1


def test_registry(spark):
    r = Registry()
    r.register(Strategy("rows", "chunking", lambda d, m: d.withColumn("part", F.col("id") % 2)))
    r.register(Strategy("total", "assembly", lambda d, m: d.groupBy("part").agg(F.sum("id").alias("v"))))
    r.register(Strategy("blocks", "assembly", lambda d, m: d, outputs="blocks"))
    assert r.compatible("rows", "blocks") == (False, ["total"])
    assert sorted(x["v"] for x in r.execute("rows", "total", spark.range(4)).collect()) == [2, 4]
    with pytest.raises(ValueError):
        r.execute("rows", "blocks", spark.range(1))
    with pytest.raises(KeyError):
        r.get("chunking", "none")
    assert r.listing(spark).count() == 3


def test_wide_parameters():
    n = 1_000_003 * 1_000_033
    c = wide.montgomery_constants(n)
    assert c["r"] == 2**256 % n and c["r2"] == 2**512 % n and (n * c["n0inv"] + 1) % 2**32 == 0
    assert len(wide.constants_buffer(n)) == 112 and wide.unpack_u256(wide.pack_u256(2**255 + 7)) == 2**255 + 7


def test_row_hashes_and_reports(spark, tmp_path):
    import hashlib

    from gridloom import catalogue

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(5).collect()
    got = {r["vec_id"]: r["hash"] for r in catalogue.queries()["matrix_rows_hash"](spark, "/root/testdata/sf0.001").collect()}
    assert all(got[r["vec_id"]] == hashlib.sha256(np.array(r["embedding"], dtype="<f4").tobytes()).hexdigest() for r in rows)
    df = spark.createDataFrame([(1, 'a,"b"'), (2, '{"k": 1}')], "id long, params string")
    records.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("id long, params string").csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    records.write_json(df, str(tmp_path / "json"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).count() == 2
    files = records.files_with_hash(spark, str(tmp_path / "json" / "*.json"), max_bytes=1).collect()
    assert files and not any(r["accepted"] for r in files)


def test_artifacts_and_stages(spark, tmp_path):
    import hashlib

    from gridloom.sources import artifacts

    chunks = spark.createDataFrame([("x", 2, b"cd"), ("x", 1, b"ab"), ("y", 1, b"z"), ("y", 2, None)], "output string, seq long, data binary")
    got = {r["output"]: (r["bytes"], r["sha256"]) for r in artifacts.write_artifacts(chunks, str(tmp_path / "out")).collect()}
    assert got == {"x": (4, hashlib.sha256(b"abcd").hexdigest()), "y": (1, hashlib.sha256(b"z").hexdigest())}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"x.bin": b"abcd", "y.bin": b"z"}
    one = artifacts.write_artifacts(chunks, str(tmp_path / "one"), combined=["y", "x"]).collect()
    assert [(r["output"], r["bytes"]) for r in one] == [("output", 5)] and (tmp_path / "one" / "output.bin").read_bytes() == b"zabcd"
    inputs = spark.createDataFrame([(1, "a/b", b"12"), (1, "c", b"123456"), (1, "d", b"1")], "job long, name string, data binary")
    kept = {r["name"]: (r["accepted"], r["path"]) for r in artifacts.keep_inputs(inputs, str(tmp_path / "in"), max_files=2, max_bytes=5).collect()}
    assert [kept[n][0] for n in ("a_b", "c", "d")] == [True, False, False] and kept["c"][1] is None
    assert [p.read_bytes() for p in (tmp_path / "in").iterdir()] == [b"12"]
    stages = artifacts.StageStore(spark, str(tmp_path / "stages"))
    made = []
    make = lambda: made.append(1) or spark.range(5)
    for parameters in ({"n": 5}, {"n": 5}, {"n": 6}):
        assert stages.resume("numbers", parameters, make).count() == 5
    assert len(made) == 2 and stages.load("other", {}) is None


def test_engine_runs_records_and_removes_jobs(spark, tmp_path):
    from gridloom.plans.engine import Engine

    engine = Engine(spark, str(tmp_path / "jobs"))
    data = spark.createDataFrame([(0, 5), (1, 3), (2, 4)], "idx long, v long")
    assert engine.jobs().count() == 0 and engine.status("none") is None
    job = engine.submit({"label": "s", "chunking": "distributed_sort", "assembly": "sorted"}, data)
    assert [(r["v"], r["place"]) for r in engine.result(job).orderBy("place").collect()] == [(3, 1), (4, 2), (5, 3)]
    assert engine.status(job)["status"] == "complete" and engine.status(job)["rows"] == 3
    failed = engine.submit({"chunking": "linear", "assembly": "concatenate", "metadata": {"index": "none"}}, data)
    assert engine.status(failed)["status"] == "failed" and engine.status(failed)["error"]
    with pytest.raises(KeyError):
        engine.result(failed)
    for wrong in ({}, {"chunking": "linear", "assembly": "first_factor"}, {"chunking": "linear", "assembly": "concatenate", "k": 0}):
        with pytest.raises(ValueError):
            engine.submit(wrong, data)
    assert engine.remove(3600) == 0 and engine.remove(-1) == 2 and engine.jobs().count() == 0


def test_command_line(spark, tmp_path, capsys):
    import json

    from gridloom.__main__ import main

    spark.createDataFrame([(0, 5), (1, 3)], "idx long, v long").write.parquet(str(tmp_path / "table"))
    assert main(["--store", str(tmp_path / "s"), "submit", "--input", str(tmp_path / "table"), "--chunking", "distributed_sort", "--assembly", "sorted", "--metadata", '{"chunk_size": 1}']) == 0
    job = json.loads(capsys.readouterr().out)
    assert job["rows"] == 2
    assert main(["--store", str(tmp_path / "s"), "status", job["id"]]) == 0 and json.loads(capsys.readouterr().out)["status"] == "complete"
    assert main(["--store", str(tmp_path / "s"), "result", job["id"]]) == 0 and main(["--store", str(tmp_path / "s"), "list"]) == 0 and main(["--store", str(tmp_path / "s"), "strategies"]) == 0


def test_generated_inputs(spark):
    from gridloom.functions import series

    n = [r["w"] for r in spark.range(4000).select(series.normal(F.col("id"), "s", 0.02).alias("w")).collect()]
    assert abs(np.mean(n)) < 0.002 and abs(np.std(n) - 0.02) < 0.002
    m = [r["v"] for r in series.random_matrix(spark, 20, 7, "int", -3, 3).collect()]
    assert set(m) == set(range(-3, 4)) and len(m) == 400
    f = {(r["i"], r["k"]): r["v"] for r in series.random_matrix(spark, 2, 42).collect()}
    assert f[0, 0] == np.float32(206659 / 233280)
    assert spark.range(3).select(series.random_id().alias("u")).distinct().count() == 3
    with pytest.raises(ValueError):
        series.random_matrix(spark, 2, 1, "text")
