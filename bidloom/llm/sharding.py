"""A reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of doc_id; a keyed permutation of 0 .. n - 1 takes a row's number to its place, and the
place tells the shard (its remainder) and the slot in it (its quotient). Counts of shards are at most one apart, slots
have no gaps, and either way is computed from n, the number of shards and the key alone: ``place`` finds where a row
went, ``row_at`` which row a slot holds.

The permutation works on pairs (left, right) of digits to the base a, the least with a * a >= n, by ROUNDS of
(left, right) -> (right, left + f(right) mod a). A result of n or more is put through again, which ends as the whole is
a permutation of a * a numbers; no more than about 2 * sqrt(n) of them are too large, so few rows walk at all.

Edge cases: a null text has no bytes, size 1 and the checksum of the empty text; null ids come first; ties of ids are
ordered by size, then checksum, and rows alike in all three are interchangeable; an empty table gives an empty result;
fewer rows than shards leave the last shards empty; other columns are ignored by ``sharded`` and kept by ``write``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm import common, ranks

SHARDS, KEY, ROUNDS = 16, 2024, 8
#: Multipliers that spread 64-bit values over all bits, and the step between the rounds' keys.
SPREAD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15


def round_keys(key: int) -> list[int]:
    return [(key + (r + 1) * STEP) % (1 << 64) for r in range(ROUNDS)]


def digit(right: np.ndarray, key: int, base: int) -> np.ndarray:
    """The round function: a digit to the base for each right digit."""
    x = right.astype(np.uint64) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(SPREAD[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SPREAD[1])
    return ((x ^ (x >> np.uint64(31))) % np.uint64(base)).astype(np.int64)


def base_of(n: int) -> int:
    """The least base whose two digits write n numbers."""
    return max(math.isqrt(max(n - 1, 0)) + 1, 1)


def forward(x: np.ndarray, base: int, key: int) -> np.ndarray:
    left, right = x // base, x % base
    for k in round_keys(key):
        left, right = right, (left + digit(right, k, base)) % base
    return left * base + right


def backward(x: np.ndarray, base: int, key: int) -> np.ndarray:
    left, right = x // base, x % base
    for k in reversed(round_keys(key)):
        left, right = (right - digit(left, k, base)) % base, left
    return left * base + right


def walked(x: np.ndarray, n: int, key: int, step=forward) -> np.ndarray:
    """x through the permutation of 0 .. n - 1 (or, with backward, its inverse)."""
    base, out = base_of(n), np.array(x, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = step(out[todo], base, key)
        todo = todo[out[todo] >= n]
    return out


def place(rows: np.ndarray, n: int, shards: int = SHARDS, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each of some row numbers, of n rows in all."""
    at = walked(rows, n, key)
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, key: int = KEY) -> np.ndarray:
    """The row numbers that these slots hold: the inverse of ``place``."""
    return walked(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), n, key, backward)


def placed(rows: DataFrame, n: int, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """rows, whose ``row`` is a number below n, with ``shard`` and ``slot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = place(batch.column("row").to_numpy(), n, shards, key)
            yield pa.record_batch([*batch.columns, pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], [*batch.schema.names, "shard", "slot"])

    fresh = rows.drop("shard", "slot")
    schema = T.StructType([*fresh.schema, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return fresh.mapInArrow(run, schema)


def sharded(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, size, text_crc32, shard, slot)."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    light = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = ranks.numbered(light, F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc())
    return placed(rows, docs.count(), shards, key).drop("row")


def write(docs: DataFrame, path: str, shards: int = SHARDS, key: int = KEY) -> None:
    """docs in shuffled order under path: a folder for each shard, whose files hold ranges of slots in order.

    Texts are moved once, after their places are known: shards are cut into ranges of slots, so a shard is no task.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    order = [F.col("doc_id").asc_nulls_first(), F.octet_length(data).asc(), F.crc32(data).asc(), F.col("text").asc_nulls_first()]
    rows = placed(ranks.numbered(docs, *order), docs.count(), shards, key).drop("row")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(max(partitions, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, whose numbers of rows are at most one apart."""
    found = sharded(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc32_sql(hexed: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of bytes given as a column of their hex digits; ``crc``, which
    ``crc_table_sql`` gives, must be a column in scope."""
    return f"xor(list_reduce(list_transform(regexp_extract_all({hexed}, '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295)"


def crc_table_sql() -> str:
    """DuckDB SQL for one row, ``crc``: the 256 steps of CRC-32, made by its rule."""
    step = "i"
    for _ in range(8):
        step = f"(CASE WHEN ({step}) % 2 = 1 THEN xor(({step}) >> 1, 3988292384) ELSE ({step}) >> 1 END)" if step == "i" else f"list_transform([{step}], lambda v: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)[1]"
    return f"SELECT list({step} ORDER BY i) AS crc FROM range(256) r(i)"


def _oracle() -> str:
    walk = "SELECT nth, x // a AS l0, x % a AS r0, a, n FROM w WHERE x >= n OR first"
    for r, k in enumerate(round_keys(KEY)):
        mixed = f"((r{r}::UHUGEINT + {k}) % 18446744073709551616)"
        for shift, by in ((30, SPREAD[0]), (27, SPREAD[1])):
            mixed = f"list_transform([{mixed}], lambda v: (xor(v, v // {1 << shift}) * {by}::UHUGEINT) % 18446744073709551616)[1]"
        mixed = f"list_transform([{mixed}], lambda v: xor(v, v // {1 << 31}))[1]"
        walk = f"SELECT nth, r{r} AS l{r + 1}, (l{r} + ({mixed} % a::UHUGEINT)::BIGINT) % a AS r{r + 1}, a, n FROM ({walk})"
    return f"""
WITH RECURSIVE c AS ({crc_table_sql()}),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, length(h) // 2 + 1 AS size, {crc32_sql("h")} AS text_crc32 FROM h, c),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS nth, count(*) OVER () AS n FROM d),
w AS (
  SELECT nth, nth AS x, ceil(sqrt(n))::BIGINT AS a, n, true AS first FROM n
  UNION ALL
  SELECT nth, l{ROUNDS} * a + r{ROUNDS} AS x, a, n, false AS first FROM ({walk}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard, x // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM n JOIN (SELECT nth, x FROM w WHERE NOT first AND x < n) USING (nth)
"""


ORACLE = _oracle()
