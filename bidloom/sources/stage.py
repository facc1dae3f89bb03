"""Tables that a query reads more than once, written in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own where it is unset and the session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="bidloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which Spark's file system removes when the session's JVM ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return f"{folder}/data"


#: Spark removes the shuffle files of a query when it ends; what is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, so lost executors cost no rework, and the
    shuffle files that it took are removed."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: A join may go on from rows dealt by some of its keys, as a window does.
SOME_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def dealt(df: DataFrame, name: str, by: str) -> DataFrame:
    """df written to the shared folder in buckets of a column and read back: what has that column among its keys needs no
    shuffle after it."""
    return kept_dealt(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by), name, by)


#: A task that writes only its own bucket needs not sort its rows by bucket first.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def kept_dealt(df: DataFrame, name: str, by: str) -> DataFrame:
    """``dealt`` of what is dealt by that column already, so that each task holds whole buckets."""
    spark = df.sparkSession
    n, before = int(spark.conf.get("spark.sql.shuffle.partitions")), {k: spark.conf.get(k, None) for k in (CLEANUP, WRITERS)}
    table = f"{name}_{uuid.uuid4().hex}"
    spark.conf.set(SOME_KEYS, "false")
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(WRITERS, "1")
    try:
        df.write.bucketBy(n, by).option("path", new_path(spark, name)).saveAsTable(table)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.table(table)


def removed(df: DataFrame) -> None:
    """Removes the files of a DataFrame that ``stored`` gave and that is needed no more."""
    spark = df.sparkSession
    for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
