"""Integers wider than any Spark type, hex text at the edges: prime powers, byte streams, curve factoring stage 1."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prime_powers(spark: SparkSession, bound: int) -> DataFrame:
    """(p, q): each prime up to ``bound`` and its largest power q within it. Composites are struck out by an anti-join."""
    numbers = spark.range(2, bound + 1).select(F.col("id").alias("p"))
    small = spark.range(2, math.isqrt(bound) + 1).select(F.col("id").alias("d"))
    composites = small.select(F.explode(F.expr(f"sequence(d * d, {bound}, d)")).alias("p")).distinct()
    primes = numbers.join(composites, "p", "left_anti")
    power = F.expr(f"aggregate(sequence(1, 64), p, (acc, i) -> CASE WHEN acc <= {bound} div p THEN acc * p ELSE acc END)")
    return primes.select("p", power.alias("q"))


def byte_stream(spark: SparkSession, seed: str, n: int) -> DataFrame:
    """(counter, digest): SHA-256 of the counter (8 bytes, high first) and the seed; every counter stands alone."""
    return spark.range(n).select(F.col("id").alias("counter"), F.sha2(F.concat(F.unhex(F.lpad(F.hex("id"), 16, "0")), F.encode(F.lit(seed), "utf-8")), 256).alias("digest"))


def lcg_matrix(spark: SparkSession, size: int, seed: int, name: str = "v") -> DataFrame:
    """(i, k, state): cell number n of the generator s = (9301 s + 49297) mod 233280, each computed from the seed alone.

    n steps are one affine map; its power is made by repeated squaring, so no cell waits for another.
    """
    steps = """aggregate(sequence(0, 40), named_struct('a', 9301L, 'c', 49297L, 'ra', 1L, 'rc', 0L), (acc, b) -> named_struct(
        'a', acc.a * acc.a % 233280, 'c', (acc.a * acc.c + acc.c) % 233280,
        'ra', CASE WHEN shiftright(id + 1, b) % 2 = 1 THEN acc.ra * acc.a % 233280 ELSE acc.ra END,
        'rc', CASE WHEN shiftright(id + 1, b) % 2 = 1 THEN (acc.a * acc.rc + acc.c) % 233280 ELSE acc.rc END), acc -> (acc.ra * SEED + acc.rc) % 233280)"""
    return spark.range(size * size).select(F.floor(F.col("id") / size).alias("i"), (F.col("id") % size).alias("k"), F.expr(steps.replace("SEED", str(seed))).alias(name))


def draw(seed: str, n: int, count: int) -> list[int]:
    """``count`` numbers in [1, n - 1] without a common factor with n, from the byte stream."""
    out, counter = [], 0
    while len(out) < count:
        x = int.from_bytes(hashlib.sha256(counter.to_bytes(8, "big") + seed.encode()).digest(), "big") % (n - 1) + 1
        counter += 1
        if math.gcd(x, n) == 1:
            out.append(x)
    return out


def _times(k: int, p: tuple[int, int], a24: int, n: int) -> tuple[int, int]:
    """(X : Z) of k times the point p on the Montgomery curve: a ladder over k's bits.

    The two points of the ladder always differ by p, which stays projective, so nothing is inverted.
    """
    if k == 1:
        return p
    low, high = p, _double(p, a24, n)
    for bit in bin(k)[3:]:
        total = _add(low, high, p, n)
        low, high = (total, _double(high, a24, n)) if bit == "1" else (_double(low, a24, n), total)
    return low


def _double(p: tuple[int, int], a24: int, n: int) -> tuple[int, int]:
    s, d = (p[0] + p[1]) ** 2 % n, (p[0] - p[1]) ** 2 % n
    t = s - d
    return s * d % n, t * (d + a24 * t) % n


def _add(p: tuple[int, int], q: tuple[int, int], difference: tuple[int, int], n: int) -> tuple[int, int]:
    u, v = (p[0] - p[1]) * (q[0] + q[1]), (p[0] + p[1]) * (q[0] - q[1])
    return difference[1] * (u + v) ** 2 % n, difference[0] * (u - v) ** 2 % n


def stage_one(curves: DataFrame, n: int, powers: list[int], compute_gcd: bool = True) -> DataFrame:
    """curves(curve, a24, x1 in hex) as (curve, result in hex, status).

    Each curve's point is multiplied by all prime powers; then the result is the greatest common divisor of its Z and n,
    with status 2 if that is a proper factor and 1 if not. Without ``compute_gcd`` the result is Z itself, status 0.

    The prime powers are a parameter of a few thousand numbers; curves are independent, an Arrow batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, status = [], []
            for a24, x1 in zip(batch.column("a24").to_pylist(), batch.column("x1").to_pylist(), strict=True):
                a24, point = int(a24, 16), (int(x1, 16), 1)
                for q in powers:
                    point = _times(q, point, a24, n)
                z = point[1] % n
                g = math.gcd(z, n) if compute_gcd else z
                results.append(f"{g:x}")
                status.append((2 if 1 < g < n else 1) if compute_gcd else 0)
            yield pa.RecordBatch.from_pydict({"curve": batch.column("curve"), "result": results, "status": pa.array(status, pa.int32())})

    return curves.mapInArrow(run, "curve long, result string, status int")


def random_curves(spark: SparkSession, seed: str, n: int, count: int) -> DataFrame:
    """(curve, a24, x1): drawn in turn from one stream, as hex."""
    numbers = draw(seed, n, 2 * count)
    return spark.createDataFrame([(i, f"{numbers[2 * i]:x}", f"{numbers[2 * i + 1]:x}") for i in range(count)], "curve long, a24 string, x1 string")


def first_factor(spark: SparkSession, seed: str, n: int, powers: list[int], count: int, wave: int = 64) -> DataFrame:
    """The first curve that gives a proper factor: curves run in waves, and none starts after a hit."""
    curves = random_curves(spark, seed, n, count)
    for first in range(0, count, wave):
        some = curves.where((F.col("curve") >= first) & (F.col("curve") < first + wave)).repartition(8)
        hits = stage_one(some, n, powers).where("status = 2").orderBy("curve").limit(1).collect()
        if hits:
            return spark.createDataFrame(hits, "curve long, result string, status int")
    return spark.createDataFrame([], "curve long, result string, status int")


def pack_u256(x: int) -> bytes:
    """32 bytes, low limb first."""
    return x.to_bytes(32, "little")


def unpack_u256(data: bytes) -> int:
    return int.from_bytes(data[:32], "little")


def montgomery_constants(n: int) -> dict[str, int]:
    """For an odd modulus: R and R*R mod n for R = 2**256, and -1/n mod 2**32."""
    r = (1 << 256) % n
    return {"n": n, "r": r, "r2": r * r % n, "n0inv": -pow(n, -1, 1 << 32) % (1 << 32)}


def constants_buffer(n: int) -> bytes:
    """The 112-byte parameter block: n, r2, r, the inverse and three words of padding."""
    c = montgomery_constants(n)
    return b"".join(pack_u256(c[k]) for k in ("n", "r2", "r")) + c["n0inv"].to_bytes(4, "little") + bytes(12)


def _column(f, kind: str):
    """A column function from a function of Python numbers and texts; nulls stay null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

    # made when it is called: only then there is a session
    return lambda *columns: F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)(*columns)


def hex_text(x: int) -> str:
    """Of even length."""
    text = f"{x:x}"
    return text if len(text) % 2 == 0 else f"0{text}"


#: Columns of hex text of any length: from and to decimal text, greatest common divisor, inverse, sums and products
#: modulo a third, and the 32-byte form.
decimal_to_hex = _column(lambda x: hex_text(int(x)), "string")
hex_to_decimal = _column(lambda x: str(int(x, 16)), "string")
hex_gcd = _column(lambda a, b: hex_text(math.gcd(int(a, 16), int(b, 16))), "string")
hex_inverse = _column(lambda a, n: hex_text(pow(int(a, 16), -1, int(n, 16))) if math.gcd(int(a, 16), int(n, 16)) == 1 else None, "string")
hex_add = _column(lambda a, b, n: hex_text((int(a, 16) + int(b, 16)) % int(n, 16)), "string")
hex_subtract = _column(lambda a, b, n: hex_text((int(a, 16) - int(b, 16)) % int(n, 16)), "string")
hex_multiply = _column(lambda a, b, n: hex_text(int(a, 16) * int(b, 16) % int(n, 16)), "string")
hex_to_u256 = _column(lambda a: pack_u256(int(a, 16)), "binary")
u256_to_hex = _column(lambda data: hex_text(unpack_u256(data)), "string")


def coprime_numbers(spark: SparkSession, seed: str, n: int, count: int) -> DataFrame:
    """(place, x in hex): as ``draw``, with the candidates made and judged in tasks."""
    from gridloom.operators.sorting import global_rank

    candidates = count + 64
    while True:
        made = byte_stream(spark, seed, candidates).select("counter", _column(lambda d: hex_text(int(d, 16) % (n - 1) + 1), "string")("digest").alias("x"))
        ranked = global_rank(made.where(hex_gcd("x", F.lit(hex_text(n))) == "01"), F.asc("counter"))
        if ranked.count() >= count:
            return ranked.where(F.col("place") <= count).select((F.col("place") - 1).alias("place"), "x")
        candidates *= 2


def curve_input(a24: int, x1: int) -> bytes:
    """One curve's 64-byte block."""
    return pack_u256(a24) + pack_u256(x1)


def powers_buffer(powers: list[int]) -> bytes:
    return b"".join(q.to_bytes(4, "little") for q in powers)
