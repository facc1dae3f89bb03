import pytest
from pyspark.sql import functions as F

from bidloom.sources import snapshot


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshot.versions(spark, path) == []
    first = snapshot.write({"a": spark.range(5), "b": spark.range(3).limit(0)}, path)
    assert {tuple(r) for r in snapshot.manifest(spark, path).collect()} == {("a", 5), ("b", 0)}
    broken = spark.range(4).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        snapshot.write({"a": spark.range(9), "b": broken}, path)
    assert snapshot.versions(spark, path) == [first]
    assert snapshot.read(spark, path, "a").count() == 5
    second = snapshot.write({"a": spark.range(7), "b": spark.range(1)}, path)
    assert snapshot.versions(spark, path) == [first, second]
    assert (snapshot.read(spark, path, "a").count(), snapshot.read(spark, path, "a", first).count()) == (7, 5)
