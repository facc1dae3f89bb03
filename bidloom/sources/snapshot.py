"""Several tables written as one version, which counts from the moment its manifest is there."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def write(tables: dict[str, DataFrame], path: str) -> str:
    """Writes the tables under path as a new version and returns its name.

    The manifest (table_name, n_rows) is written last, from the files themselves; a write that fails before leaves a folder
    that no reader takes for a version.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    counts = None
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
        rows = spark.read.schema(df.schema).parquet(f"{path}/{version}/{name}").agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        counts = rows if counts is None else counts.unionByName(rows)
    counts.coalesce(1).write.parquet(f"{path}/{version}/{MANIFEST}")
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions, oldest first."""
    fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = sorted(status.getPath().getName() for status in fs.listStatus(folder))
    return [name for name in names if fs.exists(_files(spark, f"{path}/{name}/{MANIFEST}/_SUCCESS")[1])]


def manifest(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The tables of a version, the last one if none is named, with their numbers of rows."""
    return spark.read.parquet(f"{path}/{version or versions(spark, path)[-1]}/{MANIFEST}")


def read(spark: SparkSession, path: str, table: str, version: str | None = None) -> DataFrame:
    """A table of a version, the last one if none is named."""
    return spark.read.parquet(f"{path}/{version or versions(spark, path)[-1]}/{table}")
