"""Connected components by alternating large and small stars, all in DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm import common


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, label) for each vertex of edges (a, b): label is the least vertex that v reaches.

    Each round points every vertex at the least of its neighbours (first those above it, then those below), until
    nothing changes; rounds grow with the logarithm of a component's width. Self-loops and repeats do not matter.
    """
    edges = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        linked = large.join(least, F.col("u") == F.col("k")).select("u", "v", "m")
        small = linked.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        edges = common.stored(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("v"), F.col("v").alias("label"))
    return found.union(edges.select("v", F.col("v").alias("label")).distinct())
