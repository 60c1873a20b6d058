"""From raw documents to a mixed, encoded training corpus: five stages, each one operator over all that is left.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last one the encoded documents.
``run`` writes each stage's result into the shared folder and reads it again.

Defined results, stage by stage. Language: documents with a null or empty text, without a letter, or with less than
``LEAST_SCORE`` in common with every language go; an id or source may be null, and repeated rows are judged each for
themselves. Lines: a null source is no site; a null text stays null. Near copies: one row of each group stays, the one
with the smallest id; repeated rows are a group, different texts of one id are not; texts without words all stay. Mixing:
a null source is a source like others; rows that share an id are repeated equally often. Encoding: a null text has no
pieces. An empty table stays empty. Extra columns pass through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, line_dedup, mixing, near_duplicates, sentencepiece_viterbi
from gridloom.llm.common import Scratch, table

#: Texts whose profile has less than this in common with every language are rejected.
LEAST_SCORE = 0.2


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """The text and the named columns, and all columns but the text in ``row``: so none meets one that an operator adds."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text", *names)


def _whole(parts: DataFrame, columns: list[str]) -> DataFrame:
    return parts.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; the others go."""
    judged = langid.predict(_apart(docs), langid.fit(docs))
    return _whole(judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def remove_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share, with the length that is left."""
    cleaned = line_dedup.remove(_apart(docs, "source"))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cleaned.select(*[{"text": F.col("text"), "n_chars": length}.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): see ``near_duplicates.one_of_each``."""
    return near_duplicates.one_of_each(docs, near_duplicates.Join(width=5, num=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents so that sources have their target weights, in a random order."""
    return _whole(mixing.mix(_apart(docs, "doc_id", "source")), docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, and that they decode to its text."""
    import public_tokenizers

    return sentencepiece_viterbi.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", remove_shared_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("poisson_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Language profiles and piece searches have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), Scratch()
    *first, (_, last) = STAGES
    for name, stage in first:
        now = Scratch()
        docs = now.stored(stage(spark, docs, sf_dir), name)
        before.drop(spark)  # the next stage reads the new result only
        before = now
    return last(spark, docs, sf_dir)
