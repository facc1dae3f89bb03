"""Importance resampling towards a target's distribution of hashed n-grams.

Words and runs of up to ``max_words`` consecutive words, hashed into buckets, are counted in all raw texts and in all
target texts. A bucket's gain is the logarithm of how much more frequent it is in the target; a document's weight is the
sum of its features' gains. Adding to each weight a Gumbel value that only the document's id decides and taking the
highest scores draws without replacement, in proportion to the exponentials of the weights.

The texts of a batch are joined with a separator that no word holds; one pass of a regular expression finds all their
words, the documents' offsets are searched for each word's start, and n-grams whose first and last words lie in two
documents are masked before they are counted.

Edge cases: a null text has no words, no features and weight 0; texts are read whole, the longest as a batch of its
own; a null id hashes as an empty one; rows that repeat an id have one Gumbel value and, if their texts are alike, one
score: where both were drawn or cut by the limit, either may be; documents with fewer than ``least_words`` words are
returned but never drawn; an empty table gives an empty result, an empty target table gains that count its features as
none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common, ranks
from bidloom.llm.sharding import crc32_sql, crc_table_sql

BUCKETS, MAX_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Once A-Z is lower case: digits, letters of ASCII and all bytes of other characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEPARATOR = b"\n"
#: So many bytes are joined at a time.
JOINED = 1 << 22


def joined(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about JOINED bytes together."""
    start, n = 0, 0
    for i, text in enumerate(texts):
        n += len(text or b"")
        if n >= JOINED:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def features(texts: list[bytes | None], max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document (place in texts) and the bucket of each n-gram of all texts, and each document's number of words."""
    parts = [text or b"" for text in texts]
    data = SEPARATOR.join(parts).translate(LOWER)
    found = list(WORD.finditer(data))
    starts = np.fromiter((m.start() for m in found), np.int64, len(found))
    offsets = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])]) if parts else np.zeros(1, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    grams = [crc32(m[0]) for m in found]
    docs, hashes = [doc], [np.array(grams, np.int64)]
    for n in range(2, max_words + 1):
        # The n-gram from a word on is that of n - 1 words, a space and the word after it.
        grams = [crc32(m[0], crc32(b" ", g)) for g, m in zip(grams, found[n - 1 :])]
        inside = doc[: len(grams)] == doc[n - 1 :]
        docs.append(doc[: len(grams)][inside])
        hashes.append(np.array(grams, np.int64)[inside])
    return np.concatenate(docs), np.concatenate(hashes) % buckets, np.bincount(doc, minlength=len(parts))


def binary(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def counts(texts: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (text) fall into each bucket; ``buckets`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data = binary(batch)
            for a, b in joined(data):
                total += np.bincount(features(data[a:b], max_words, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(held, pa.int32()), "n": pa.array(total[held], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), for B buckets."""
    n = float(len(raw))
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, max_words: int = MAX_WORDS) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, n_words, n_features, weight)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, out = binary(batch), []
            for a, b in joined(data):
                doc, bucket, words = features(data[a:b], max_words, buckets)
                # Sums of whole numbers are exact in doubles far beyond any text's.
                out.append((words, np.bincount(doc, minlength=b - a), np.bincount(doc, gain[bucket], b - a).astype(np.int64)))
            if out:
                words, n, weight = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A Gumbel value in thousandths, which seed and id alone decide."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    return F.floor(-1000 * F.ln(-F.ln((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, max_words: int = MAX_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, n_features, weight, score, rank); rank is null for those not drawn."""
    gain = gains(counts(docs, max_words, buckets), counts(target, max_words, buckets))
    scored = weighted(docs, gain, max_words).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = common.stored(scored.withColumn("may", F.col("n_words") >= least_words).drop("n_words"), "scored")
    drawn = scored.where("may").count() * percent // 100
    ranked = ranks.numbered(scored.where("may").drop("may"), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = ranked.withColumn("rank", F.when(F.col("row") < drawn, F.col("row") + 1)).drop("row")
    return ranked.unionByName(scored.where("NOT may").drop("may").withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents that are drawn, with their own columns only; doc_id must tell documents apart."""
    kept = resampled(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark's texts."""
    return resampled(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def _sql_words(table: str, columns: str) -> str:
    return f"SELECT {columns}unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS w FROM {table}"


ORACLE = f"""
WITH c AS ({crc_table_sql()}),
d AS MATERIALIZED ({_sql_words("documents", "doc_id, ")}),
b AS MATERIALIZED ({_sql_words("benchmark", "")}),
h AS MATERIALIZED (SELECT w, {crc32_sql("x")} % {BUCKETS} AS bucket FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)), c),
s AS (SELECT bucket, count(*) AS s FROM d JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM d)::DOUBLE + {BUCKETS}) / ((s::DOUBLE + 1) * ((SELECT count(*) FROM b)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM a WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank FROM a LEFT JOIN r USING (doc_id)
"""
