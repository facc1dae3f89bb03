"""The decision log as a stream: each event once, appended to a log table that the batch operators read."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidloom.operators import master


def append_decisions(events: DataFrame, log: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Starts a query that appends the stream events (key, id, ts, action, value) to the Parquet table log.

    An id that comes again within delay is dropped; late ones need no more, for the latest is chosen by (ts, id).
    """
    # A watermark needs a time with a zone; the session's is taken for one without.
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(log: DataFrame) -> DataFrame:
    """The decision that holds for each key, by the same operator as in batch."""
    return master.latest_decisions(log)
