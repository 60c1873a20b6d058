"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the target times the whole volume, over its own volume. A document
is repeated as often as a Poisson variable with its source's mean says, drawn by inverting the distribution at a
uniform number made from a hash of seed and key. The copies are dealt out by another hash and sorted by it, so the
whole output is in a random order that the seed fixes.

Volume is counted in characters over all documents. Target weights are given by source; without them they are the
square root of the volume, which lifts small sources. Sources without a weight get none and so no copies.

Defined results: a null source is a source like others (its weight is under None); null and empty texts have no volume
and follow their source's rate; a source without volume has the rate 0. Rows that repeat a key draw the same number.
``copy`` (from 1) and ``mix_key`` are added to the columns, and replaced if there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

SEED = "mix-1"
#: Uniform numbers have 52 bits.
HEX_DIGITS = 13
#: Sources whose rates are broadcast at most (a row holds a table of a few hundred numbers); beyond, Spark shuffles.
BROADCAST_SOURCES = 1000


def _uniform(key: str, *salt: str) -> str:
    parts = ", ".join([f"'{x}'" for x in salt] + [f"coalesce(CAST({key} AS STRING), '')"])
    return f"(CAST(conv(substring(sha2(concat_ws('/', {parts}), 256), 1, {HEX_DIGITS}), 16, 10) AS DOUBLE) / {16**HEX_DIGITS}D)"


#: P(X <= 0), P(X <= 1), ... as far as a uniform number of 52 bits can reach.
_CUMULATIVE = """aggregate(sequence(1, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS INT)),
    named_struct('p', exp(-rate), 'c', exp(-rate), 'out', array(exp(-rate))),
    (acc, k) -> named_struct('p', acc.p * rate / k, 'c', acc.c + acc.p * rate / k, 'out', concat(acc.out, array(acc.c + acc.p * rate / k))),
    acc -> acc.out)"""
#: Beyond this mean exp(-rate) leaves the range of doubles; such a source is mixed as several of a smaller mean.
MAX_RATE = 500


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, text: str = "text", source: str = "source", epochs: float = 1.0) -> DataFrame:
    """``source, chars, rate``: one row for each source."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt(F.col("chars").cast("double")))
    else:
        cases = F.lit(0.0)
        for name, w in weights.items():
            cases = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(cases)
        weighed = sizes.withColumn("weight", cases)
    weighed = stored(weighed, "sources")
    total = weighed.where(F.col("chars") > 0).agg(F.sum("chars").alias("chars"), F.sum(F.col("weight").cast("decimal(38,10)")).alias("weight")).first()
    if not total["chars"] or not total["weight"]:
        return weighed.select("source", "chars", F.lit(0.0).alias("rate"))
    return weighed.select("source", "chars", F.when(F.col("chars") > 0, F.col("weight") / F.lit(float(total["weight"])) * F.lit(epochs * total["chars"]) / F.col("chars")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Copies of ``docs`` in their global order, with ``copy`` and ``mix_key``."""
    docs = docs.drop("copy", "mix_key")
    found = rates(docs, weights, text, source, epochs)
    # a mean over MAX_RATE is the sum of several draws with equal parts of it
    table = found.select("source", F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int").alias("draws"), "rate")
    table = table.withColumn("rate", F.col("rate") / F.col("draws")).withColumn("cdf", F.expr(_CUMULATIVE)).drop("rate")
    table = F.broadcast(table) if found.count() <= BROADCAST_SOURCES else table
    # the row in one column, so that its names meet no others
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("of"), F.col(key).cast("string").alias("id"))
    joined = rows.join(table, rows["of"].eqNullSafe(table["source"]))
    draw = _uniform("id", seed, "draw")
    more = draw.replace("concat_ws('/', ", "concat_ws('/', CAST(d AS STRING), ")
    times = F.expr(f"CASE WHEN draws = 1 THEN size(filter(cdf, c -> c <= {draw})) ELSE aggregate(sequence(1, draws), 0, (acc, d) -> acc + size(filter(cdf, c -> c <= {more}))) END")
    counted = joined.select("row", "id", times.alias("times")).where(F.col("times") > 0)
    copies = counted.select("row", "id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    place = F.expr(f"substring(sha2(concat_ws('/', '{seed}', 'place', coalesce(id, ''), CAST(copy AS STRING)), 256), 1, 16)")
    return copies.select("row.*", "copy", place.alias("mix_key")).orderBy("mix_key")


ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (
    SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, sqrt(CAST(coalesce(sum(length(text)), 0) AS DOUBLE)) AS weight FROM documents GROUP BY source
), total AS (SELECT CAST(sum(chars) AS DOUBLE) AS chars, CAST(sum(CAST(weight AS DECIMAL(38,10))) AS DOUBLE) AS weight FROM sizes WHERE chars > 0),
rates AS (SELECT source, CASE WHEN s.chars > 0 THEN s.weight / t.weight * t.chars / s.chars ELSE 0.0 END AS rate FROM sizes s, total t),
cdf AS (
    SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
    UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
), drawn AS (
    SELECT *, CAST(('0x' || substring(sha256(concat_ws('/', '{SEED}', 'draw', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, {HEX_DIGITS})) AS BIGINT) / CAST({16**HEX_DIGITS} AS DOUBLE) AS u FROM documents
), counted AS (
    SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS times FROM drawn d
), copies AS (SELECT * EXCLUDE (u, times), CAST(unnest(generate_series(1, times)) AS INT) AS copy FROM counted WHERE times > 0)
SELECT *, substring(sha256(concat_ws('/', '{SEED}', 'place', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(copy AS VARCHAR))), 1, 16) AS mix_key FROM copies
"""
