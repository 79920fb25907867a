"""From raw documents to packed training sequences.

Each stage reads the documents that its predecessor kept; all but the last give back the columns of
``documents``. ``run`` writes what a stage returns as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import langid, near_duplicates, packing, pii, quality
from ledgerspark.llm.common import staged, table
from ledgerspark.llm.queries import BYTE_BPE, PATTERN


def _same(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that aren't rejected."""
    return _same(quality.judge(docs).filter("kept"), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a calibrated score; documents without a letter go. If no language could be learned, all others stay."""
    return _same(langid.identify(docs, langid.trained(docs)).filter("NOT rejected"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.deduplicated(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text."""
    return pii.redact(docs, pii.supervised(docs), length="n_chars")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens."""
    return packing.pack(docs, BYTE_BPE, PATTERN, 2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii_redaction", pii_redaction),
    ("sequence_packing", sequence_packing),
]

#: Training, sampling and merging of tokens can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
