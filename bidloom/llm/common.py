"""What the operators share: reading tables, cutting lineage in the shared folder, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.sources.stage import CLEANUP, new_path, removed, shared_dir, stored

__all__ = ["CLEANUP", "SPACES", "new_path", "read", "removed", "shared_dir", "stored", "words"]

#: A word is a run of characters other than these: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
