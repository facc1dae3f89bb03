"""The corpus pipeline: clean, distinct, masked and mixed documents as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common, mixing, near_dups, pii, quality_rules, sentencepiece


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return quality_rules.kept(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates."""
    return near_dups.kept(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; n_chars follows the text."""
    masked = pii.redact(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids."""
    return sentencepiece.encode(docs, sentencepiece.Vocabulary.load())


STAGES = [("quality_rules", drop_junk), ("near_dups", drop_copies), ("pii", mask_pii), ("mixing", mix_sources), ("sentencepiece", to_ids)]

#: The field and the tokenizer are beyond SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read back."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
