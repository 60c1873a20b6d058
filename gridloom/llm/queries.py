"""One query for each operator: the operator over its whole table, with production parameters, and its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import compaction, kmeans_tree, langid, license_scan, line_dedup, mixing, near_duplicates, quality, sentencepiece_viterbi, token_store
from gridloom.llm.common import new_folder, table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = token_store.write_store(docs, "doc_id", "text", tokenizer_file())
    found = store.fetch(docs.select(F.col("doc_id").alias("key")), digest_only=True)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kmeans_tree.search(vectors, lambda x: x % 20 == 0, k=20)


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.ingest(table(spark, sf_dir, "documents"), new_folder(spark, "sharded"), arrivals=8).read()


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.components(table(spark, sf_dir, "documents").select("doc_id", "text"), near_duplicates.Join(width=3, num=90))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


ALL = [op1_token_store, op2_quality_cascade, op3_kmeans_tree, op4_poisson_mix, op5_compaction, op6_sentencepiece, op7_ngram_jaccard, op8_language_id, op9_line_dedup, op10_license_scan]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


#: op2's measures and verdict, word by word.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS t FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, generate_series(0, 7) AS g(j) GROUP BY doc_id),
m AS (
    SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
        coalesce(covered.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
        length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(text, '[^{}]', '', 'g')) AS n_braces,
        len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets, len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_trailing_off
    FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
        OR 10 * word_chars < 25 * n_words OR word_chars > 15 * n_words OR 100 * n_upper > 60 * n_letters
        OR 100 * n_digits > 40 * word_chars OR 100 * n_braces > 5 * word_chars OR n_lines >= 3 AND 100 * n_bullets > 90 * n_lines OR n_lines >= 3 AND 100 * n_trailing_off > 30 * n_lines) AS kept
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_cascade": OP2_SQL,
        "op4_poisson_mix": mixing.ORACLE_SQL,
        "op5_compaction": "SELECT * FROM documents",
        "op9_line_dedup": line_dedup.ORACLE_SQL,
        "op10_license_scan": license_scan.oracle_sql(),
    }
