"""Removal of lines that many sites share.

A line's spread is the number of distinct sites that have it. HyperLogLog sketches of the sites are kept by the hash of
the trimmed line and merge by aggregation; where an estimate lies near the threshold, the distinct sites are counted
exactly. Lines whose spread reaches the threshold are boilerplate and go from every document, however short they are
and however little is left of it. Only a document without a line of its own (all are blank or boilerplate) keeps its
text, with ``n_removed`` 0: it is a copy, and which copy stays is for the near-duplicate stage to say.

A bounded set of boilerplate hashes is looked up inside each row, so no text is shuffled; a larger set is joined.

Defined results: a null text stays null, an empty one empty. A null site is no site. Repeated rows count for the same
site. A document whose lines all stay keeps its text unchanged. Other columns pass through, whatever their names;
``n_lines`` and ``n_removed`` are added, and replaced if there. An empty table stays empty.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

SITES = 10
#: Lines of nothing but these are blank, and lines are compared without them at their ends.
BLANKS = " \t\r\v\f"
#: 2**12 registers: estimates of this size are off by 1.6 % (one standard deviation); within BAND they are counted.
LG_K = 12
BAND = 0.15
#: Hashes that each row looks up at most (some 20 bytes each in the plan); more are joined.
LOOKUP_HASHES = 50_000
#: Hashes that are broadcast at most while lines are counted, of 8 bytes each.
BROADCAST_ROWS = 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _hash(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def _hashes(docs: DataFrame, text: Column, other: Column) -> DataFrame:
    """``of`` (``other``) and ``hash`` of each line that is not blank."""
    lines = docs.select(other.alias("of"), F.explode(_lines(text)).alias("line"))
    return lines.where(_bare(F.col("line")) != "").select("of", _hash(F.col("line")).alias("hash"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """``hash`` of each line that at least ``sites`` distinct sites have."""
    lines = _hashes(docs.where(F.col(site).isNotNull()), F.col(text), F.col(site))
    sketches = lines.groupBy("hash").agg(F.hll_sketch_agg("of", LG_K).alias("sketch"))
    spread = stored(sketches.select("hash", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - BAND)), "spread")
    far = F.col("estimate") > sites * (1 + BAND)
    near = spread.where(~far).select("hash")
    exact = lines.join(_small(near), "hash").groupBy("hash").agg(F.countDistinct("of").alias("n")).where(F.col("n") >= sites)
    return stored(spread.where(far).select("hash").union(exact.select("hash")), "boilerplate")


def remove(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` without boilerplate lines, with ``n_lines`` before and ``n_removed``."""
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    bad = boilerplate(docs, text, site, sites)
    rows = docs.select(F.struct(*names).alias("row"), F.col(text).alias("text"))
    n = bad.count()
    if n <= LOOKUP_HASHES:
        # hashes by the remainder of a number of buckets: a line looks at one bucket, of about one hash
        size = max(1, n)
        buckets: list[list[int]] = [[] for _ in range(size)]
        for r in bad.collect():  # bounded by LOOKUP_HASHES
            buckets[r["hash"] % size].append(r["hash"])
        table = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")
        is_bad = lambda h: F.array_contains(F.get(table, F.pmod(h, F.lit(size)).cast("int")), h)
    else:
        # by the hash of the text, so copies share a row; as many hashes at most as a text has lines
        whole = F.xxhash64("text")
        found = _hashes(rows.where("text IS NOT NULL"), F.col("text"), whole).join(_small(bad), "hash").groupBy("of").agg(F.collect_set("hash").alias("bad"))
        rows = rows.withColumn("of", whole).join(found, "of", "left").select("row", "text", "bad")
        is_bad = lambda h: F.coalesce(F.array_contains("bad", h), F.lit(False))
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: (_bare(x) == "") | ~is_bad(_hash(x)))
    cut = rows.select("row", "text", F.coalesce(F.size(lines), F.lit(0)).alias("n"), kept.alias("kept"))
    goes = (F.size("kept") < F.col("n")) & F.exists("kept", lambda x: _bare(x) != "")
    cut = cut.select("row", "text", F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).alias("n"), "kept", (F.col("text").isNotNull() & goes).alias("goes"))
    out = [F.when(F.col("goes"), F.array_join("kept", "\n")).otherwise(F.col("text")).alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    return cut.select(*out, F.col("n").cast("long").alias("n_lines"), F.when(F.col("goes"), F.col("n") - F.size("kept")).otherwise(0).cast("long").alias("n_removed"))


ORACLE_SQL = f"""
WITH lines AS (
    SELECT doc_id, source, i, l, trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), bad AS (
    SELECT t FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {SITES}
), marked AS (
    SELECT doc_id, i, l, t, t IN (SELECT t FROM bad) AS goes FROM lines
), cut AS (
    SELECT doc_id, count(*) FILTER (goes) AS n, count(*) FILTER (NOT goes AND t <> '') AS own, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT goes), '') AS kept FROM marked GROUP BY doc_id
)
SELECT doc_id, lang, source, CASE WHEN n > 0 AND own > 0 THEN kept ELSE text END AS text,
    CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(CASE WHEN n > 0 AND own > 0 THEN n ELSE 0 END AS BIGINT) AS n_removed
FROM documents LEFT JOIN cut USING (doc_id)
"""
