import bidloom.plans.procurement  # noqa: F401  the view of the log
from bidloom.operators import master
from bidloom.sources import domain
from bidloom.streaming import decisions


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    log = domain.table(spark, "/root/testdata/sf0.001", "decision_log")
    log = log.withColumn("ts", log["ts"].cast("timestamp"))
    source = f"{tmp_path}/in"
    log.union(log.limit(20)).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    decisions.append_decisions(stream, f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination()
    written = spark.read.parquet(f"{tmp_path}/log")
    assert written.count() == log.count()
    assert sorted(map(str, decisions.current(written).collect())) == sorted(map(str, master.latest_decisions(log).collect()))
