"""A corpus pipeline of five stages, each one operator of ``pagesift.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagesift.llm import exact_dedup, language_id, minhash, mixing, sentencepiece_bpe
from pagesift.llm.common import ARROW_ROWS, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_ROWS = 500      # rows of an Arrow batch: whole texts pass to Python, so batches follow their size


def _columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents' own columns; from here on Arrow batches are small."""
    spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    return docs.select(COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters, and those in which no language
    reaches 0.35 of the words, go."""
    docs = _columns(spark, docs)
    return language_id.keep_known(docs, docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(_columns(spark, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of every class the smallest doc_id stays."""
    return minhash.drop_near_duplicates(_columns(spark, docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: no document is left out (the largest source
    gets one epoch), small sources are repeated, at most twice."""
    return mixing.mix_documents(_columns(spark, docs), keep_all=True, max_epochs=2.0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: doc_id, n_tokens, token_ids and
    the decoded text."""
    return sentencepiece_bpe.encode(_columns(spark, docs), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", keep_known_languages), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies),
          ("mixing to target weights", mix_sources), ("SentencePiece", tokenize)]

# conditional random fields, bisection and merge ranks have no SQL form; the
# stages are tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage{k}")
    return docs
