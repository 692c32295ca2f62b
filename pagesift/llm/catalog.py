"""Registered queries of the operators: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann_tree, bwt_dedup, exact_dedup, html_diff, language_id, minhash, mixing, periodic_runs, quality_ranking, secrets_scan, sentencepiece_bpe, source_divergence, suffix_tree_lm
from .common import table

QUERIES = {}
ORACLE_SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL["op6_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the weight of its source, the epochs the source
    gets under a budget of the corpus's own tokens, the document's block and
    its copies in the mixture."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    m = mixing.mixture(docs)
    return m.select("d.doc_id", "d.source", "n_tokens", "source_tokens", "exponent", "weight", "epochs", "block", "copies")


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secrets_scan.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


@query
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann_tree.search(vectors, vectors.filter("vec_id % 50 = 0"))


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return periodic_runs.detect(docs, plant=True, digests=True)


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


ORACLE_SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
lt AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
st AS (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(cnt.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 2)) // (coalesce(st.total, 0) + 2 * lt.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (kept.lang_n + 2)) // (lt.lang_total + 2 * lt.v)::HUGEINT AS q
  FROM g JOIN kept USING (lang) JOIN lt USING (lang)
  LEFT JOIN st ON st.lang = g.lang AND st.source = g.source
  LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_ranking.classify(table(spark, sf_dir, "documents", "doc_id", "text"), labels)
