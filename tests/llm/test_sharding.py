import zlib
from collections import Counter

import numpy as np
import pytest

from bidloom.llm import ranks, sharding

SCHEMA = "doc_id long, text string, row string, at long"


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 1000, 4097, 99_991])
def test_permutation_and_its_inverse(n):
    shard, slot = sharding.place(np.arange(n), n)
    sizes = Counter(shard.tolist())
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    assert all(sorted(slot[shard == s]) == list(range(k)) for s, k in sizes.items())
    assert (sharding.row_at(shard, slot, n) == np.arange(n)).all()


def test_order_is_mixed_and_depends_on_the_key():
    n = 10_000
    at = sharding.walked(np.arange(n), n, sharding.KEY)
    assert abs(np.corrcoef(np.arange(n), at)[0, 1]) < 0.05
    assert (at != sharding.walked(np.arange(n), n, sharding.KEY + 1)).mean() > 0.99


def test_numbers_rise_with_the_order_without_gaps(spark):
    rows = [(i * 7919 % 1000,) for i in range(1000)] + [(5,)] * 700
    got = ranks.numbered(spark.createDataFrame(rows, "v int").repartition(7), ranks.F.col("v").desc()).orderBy("row").collect()
    assert [r.row for r in got] == list(range(1700)) and [r.v for r in got] == sorted((v for v, in rows), reverse=True)


def rows():
    return [(i, "é" * (i % 5) + str(i % 40), "x", 1) for i in range(300)] + [(None, "same", "x", 1)] * 50 + [(7, None, "x", 1), (7, "", "x", 1), (8, "a" * 3_000_000, "x", 1)]


def test_places_of_documents(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = sharding.sharded(docs).collect()
    again = sharding.sharded(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)), "another way of reading changes nothing"
    light = sorted(((r[0] is not None, r[0] or 0), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), r[0]) for r in rows())
    shard, slot = sharding.place(np.arange(len(light)), len(light))
    want = [(d, size, crc, int(a), int(b)) for (_, size, crc, d), a, b in zip(light, shard, slot)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1), (2, None, "x", 1)], SCHEMA)
    assert {(r.shard, r.slot) for r in sharding.sharded(docs).collect()} <= {(s, 0) for s in range(16)}
    assert sharding.sharded(docs.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    sharding.write(docs, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    places = {(r.shard, r.slot): r.doc_id for r in back.collect()}
    shard, slot = sharding.place(np.arange(200), 200, 4)
    assert places == {(int(a), int(b)): i for i, (a, b) in enumerate(zip(shard, slot))}
    assert back.columns == ["doc_id", "text", "slot", "shard"]
