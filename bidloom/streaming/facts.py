"""The latest fact of each key as keyed state of a stream: corrections of a line's fields, decisions on a line.

Facts may come in any order and more than once; what counts is their own time and id, so the state after all of them is
what the batch operators make of the same facts. Each micro-batch writes the keys it changed to a folder of its own, which
a rerun of the batch writes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_latest(facts: DataFrame, keys: list[str], values: list[str], order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps, for each key, the values of its last fact in order; state is a row a key."""
    state = facts.groupBy(*keys).agg(F.max(F.struct(*order)).alias("at"), F.max_by(F.struct(*values), F.struct(*order)).alias("of"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return state.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The state: each key's values and the order columns of the fact that they are from."""
    last = spark.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct("at", "of"), "at").alias("s"))
    return last.select(*keys, "s.at.*", "s.of.*")
