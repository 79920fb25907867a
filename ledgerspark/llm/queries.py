"""The registered queries of this subpackage: each operator on its whole table, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import centroids, forest, langid, near_duplicates, packing, pii, prefix_bpe, quality, rank_merge, sharding, templates, token_files, whitening
from ledgerspark.llm.common import table
from ledgerspark.session import scratch_folder

#: Public tokenizer files, and the split before the merges of the byte-level vocabularies.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.trained(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 40)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank_merge.token_counts(docs, BYTE_BPE, PATTERN).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.supervised(docs))


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.round_trip_digests(table(spark, sf_dir, "documents"), MULTI_BPE, PATTERN)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("_key").alias("doc_id"), "class_id", "class_texts", "kept")


def op8_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extracted(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, PATTERN, 2048)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    figures = quality.rule_figures(docs, "text").drop("text")
    found = quality.with_verdicts(quality.staged(figures), "source")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("host_rate", 9).alias("host_rate"), "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/tokens"
    token_files.write(table(spark, sf_dir, "documents"), path, BYTE_BPE, PATTERN)
    return token_files.digests(token_files.read(spark, path))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_sharding": op2_sharding,
    "op3_neighbours": op3_neighbours,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_prefix_bpe": op6_prefix_bpe,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_html_templates": op8_html_templates,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_token_files": op12_token_files,
    "op13_centroids": op13_centroids,
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op10_quality": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '{_WORD}') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l
  FROM docs
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM repeated) GROUP BY r
), figures AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (r)
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures
), hosts AS (
  SELECT source, count(*) AS n_docs, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS BIGINT) AS n_failed
  FROM failed WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT avg(n_failed / n_docs) AS m, var_samp(n_failed / n_docs) AS v, avg(n_docs) AS size FROM hosts
), prior AS (
  SELECT m, greatest(CASE WHEN v > 0 AND m * (1 - m) > v THEN least(m * (1 - m) / v - 1, size) ELSE 1.0 END, 1e-6) AS weight FROM moments
), rates AS (
  SELECT source, (n_failed + m * weight) / (n_docs + weight) AS host_rate FROM hosts, prior
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, round(host_rate, 9) AS host_rate,
       NOT base_failed AND coalesce(host_rate, 0) <= 0.6 AS kept
FROM failed LEFT JOIN rates USING (source)
"""
}
