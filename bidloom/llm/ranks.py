"""Row numbers over a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.llm import common

#: monotonically_increasing_id has a row's place within its partition in this many bits.
PLACE_BITS = 33


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df, stored, with ``at``: a number, with gaps, that rises with the order.

    Rows are dealt by ranges of the order and each range is sorted on its own. Where rows were read decides between
    those that order leaves equal, so equal rows make no large range.
    """
    salted = df.withColumn("_read", F.monotonically_increasing_id())
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = salted.repartitionByRange(partitions, *order, F.col("_read")).sortWithinPartitions(*order, F.col("_read"))
    return common.stored(dealt.drop("_read").withColumn("at", F.monotonically_increasing_id()), "ordered")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``row``: 0, 1, 2 ... in the given order.

    A range's first number is the sum of the rows of those before it; there is one such number for each partition.
    """
    placed = in_order(df, *order)
    part = F.shiftright("at", PLACE_BITS).alias("part")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    starts = counts.select(F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.withColumn("row", F.col("start") + F.col("at").bitwiseAND((1 << PLACE_BITS) - 1)).drop("part", "start", "at")
