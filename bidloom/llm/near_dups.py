"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets.

A document's set of word shingles has a signature of ``HASHES`` positions of ``BITS`` bits (the spread low bits of the least hashes).
Two sets of the wanted similarity differ in at most ``distance`` positions but for a chance of about one in a million
(five standard deviations). The positions are split into chunks, so many that one chunk of such a pair has at most
``CHUNK_ERRORS`` errors (pigeonhole); every way to leave out that many positions of a chunk makes a key, and so all
pairs within the distance share a key.

Rows with equal sets are one vertex, found by grouping on a 128-bit fingerprint of the set. Links are then sought so that
a large group of near copies never becomes all its pairs:

1. a star: each vertex is held against one hub, of the most central vertices of its keys (those that share their keys with
   the most others) the one that it meets in most keys;
2. after the components of the confirmed links, only keys with more than one component count: the vertices outside a
   key's main component are held against the ``HUBS`` most central vertices in it;
3. last, the vertices outside a key's main component are held against all others of the key, each pair at the first key
   that it shares, if the similarity is possible: shingles that no other such vertex has are not common, and no more
   are than both have in each residue class of hashes, which refuses nearly all copies with different edits.

Every pair within the distance is thus either confirmed, refused, or already connected.

Edge cases: null or blank texts have an empty set, link with nothing and are kept; a text with fewer words than a
shingle is one shingle; rows that repeat a doc_id are documents of their own, all kept if one of them is the least of
its component; rows with a null doc_id take their component's least id and are kept only if it has none; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common, graph, tokens
from bidloom.llm.quality_rules import let

HASHES, BITS, CHUNK_ERRORS, HUBS = 64, 8, 1, 4
#: Shingles are also counted by so many residues of their hashes; sets of more than LARGE are not judged by these counts.
RESIDUES, LARGE = 256, 4_000_000


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``width`` words, linked from ``percent`` of their union on."""

    width: int = 5
    percent: int = 80

    @property
    def distance(self) -> int:
        p = 1 - self.percent / 100
        return min(HASHES - 1, math.ceil(HASHES * p + 5 * math.sqrt(HASHES * p * (1 - p))))

    @property
    def chunks(self) -> list[range]:
        n = self.distance // (CHUNK_ERRORS + 1) + 1
        return [range(HASHES * i // n, HASHES * (i + 1) // n) for i in range(n)]

    @property
    def keys(self) -> list[tuple[int, ...]]:
        """The positions that make up each key."""
        return [k for c in self.chunks for k in combinations(c, max(1, len(c) - CHUNK_ERRORS))]


def factors() -> np.ndarray:
    return tokens.mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(tokens.BASE)) | np.uint64(1)


def planes(signature: np.ndarray) -> np.ndarray:
    """Signatures of HASHES positions of BITS bits as BITS words of one bit for each position."""
    bits = (signature[:, None, :] >> np.arange(BITS, dtype=np.uint16)[:, None]) & np.uint16(1)
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.int64)[:, :, 0]


def positions(words: np.ndarray) -> np.ndarray:
    """The other way round."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), BITS, 8), axis=2, bitorder="little")
    return (bits.astype(np.uint16) << np.arange(BITS, dtype=np.uint16)[:, None]).sum(1, dtype=np.uint16)


def signed(batches: Iterator[pa.RecordBatch], width: int, sets: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_shingles, v, signature or shingles, and other columns but the text)."""
    multiply = factors()
    for batch in batches:
        texts = batch.column("text")
        rest = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"}
        for low, high in tokens.ranges(texts):
            hashes, first = tokens.shingles(texts.slice(low, high - low).to_pylist(), width)
            distinct = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:], strict=False)]
            n = np.array([len(d) for d in distinct], np.int64)
            flat = np.concatenate(distinct) if distinct else hashes
            full, at = n > 0, np.concatenate(([0], np.cumsum(n)))
            begins = at[:-1][full]
            vertex, signature = np.zeros(len(n), np.int64), np.zeros((len(n), HASHES), np.uint16)
            if full.any():
                # Two sums of spread values and the size tell sets apart.
                one = np.add.reduceat(tokens.mixed(flat), begins)
                two = np.add.reduceat(tokens.mixed(flat ^ np.uint64(tokens.BASE)), begins)
                vertex[full] = tokens.mixed(one ^ tokens.mixed(two + n[full].astype(np.uint64))).view(np.int64)
                if not sets:
                    for j in range(HASHES):
                        least = np.minimum.reduceat(flat * multiply[j], begins)
                        signature[full, j] = (tokens.mixed(least) >> np.uint64(64 - BITS)).astype(np.uint16)
            out = {c: x.slice(low, high - low) for c, x in rest.items()}
            out |= {"n_shingles": pa.array(n), "vertex": pa.array(vertex, mask=~full)}
            if sets:
                row = np.repeat(np.arange(len(n)), n)
                counts = np.bincount(row * RESIDUES + (flat % np.uint64(RESIDUES)).astype(np.int64), minlength=len(n) * RESIDUES)
                out["spread"] = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * RESIDUES), pa.array(np.minimum(counts, 32767).astype(np.int16)))
                out["shingles"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))
            else:
                out["signature"] = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BITS), pa.array(planes(signature).ravel()))
            yield pa.record_batch(out)


def keyed(batches: Iterator[pa.RecordBatch], keys: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows (key, vertex), one for each key of each vertex."""
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            values = positions(part.column("signature").flatten().to_numpy(zero_copy_only=False).reshape(-1, BITS))
            terms = tokens.mixed(values.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) + np.uint64(1)) * np.uint64(1 << 20))
            salt = tokens.mixed(np.arange(len(keys), dtype=np.uint64) + np.uint64(77))
            found = np.stack([tokens.mixed(terms[:, list(k)].sum(1, dtype=np.uint64) + salt[i]) for i, k in enumerate(keys)])
            # The low bits tell which key it is.
            found = (found & ~np.uint64(HASHES - 1)) | np.arange(len(keys), dtype=np.uint64)[:, None]
            vertex = part.column("vertex").to_numpy(zero_copy_only=False)
            yield pa.record_batch({"key": pa.array(found.ravel().view(np.int64)), "vertex": pa.array(np.tile(vertex, len(keys)))})


def differing(a: str, b: str) -> Column:
    """A word with a bit for each position in which two signatures differ."""
    words = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(BITS)]
    return reduce(lambda x, y: x.bitwiseOR(y), words)


def apart(a: str, b: str) -> Column:
    """Positions in which two signatures differ."""
    return F.bit_count(differing(a, b))


def first_key(mask: Column, like: Similarity) -> Column:
    """The number of the first key that two signatures share which differ in mask: of the first chunk with one error at most, the key that leaves the error out (the last position without any)."""
    out = F.lit(-1)
    for c in reversed(like.chunks):
        inside = mask.bitwiseAND(F.lit(_signed(sum(1 << i for i in c))))
        # How many bits of the chunk lie behind its only error.
        behind = sum(((F.when(inside == _signed(1 << i), len(c) - 1 - (i - c.start)).otherwise(0)) for i in c), F.lit(0))
        out = F.when(F.bit_count(inside) <= CHUNK_ERRORS, c.start + behind).otherwise(out)
    return out


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def linked(docs: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) as rows (doc_id, n_shingles, vertex), and links (a, b) between vertices."""
    width, keys = like.width, like.keys
    docs = docs.select("doc_id", "text")
    rows = docs.mapInArrow(lambda b: signed(b, width, False), "doc_id long, n_shingles long, vertex long, signature array<long>")
    rows = common.stored(rows, "signatures")
    vertices = rows.where("vertex IS NOT NULL").groupBy("vertex").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    vertices = common.stored(vertices, "vertices")
    every = vertices.select("vertex", "signature").mapInArrow(lambda b: keyed(b, keys), "key long, vertex long")
    shared = every.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = common.stored(every.join(shared, "key"), "members")
    weights = members.groupBy("vertex").agg(F.sum("size").alias("weight"))
    members = common.stored(members.select("key", "vertex").join(weights, "vertex"), "weighed")
    signatures = vertices.select("vertex", "signature")

    def close(pairs: DataFrame) -> DataFrame:
        """The confirmed ones of pairs (a, b)."""
        one, two = (signatures.select(F.col("vertex").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")
        found = common.stored(pairs.join(one, "a").join(two, "b").where(apart("sa", "sb") <= like.distance).select("a", "b"), "close")
        asked = found.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
        return confirmed(found, shingle_sets(docs, vertices, asked, width), like)

    central = F.struct("weight", "vertex")
    hubs = members.groupBy("key").agg(F.max(central).alias("h")).select("key", F.col("h.vertex").alias("hub"))
    often = members.join(hubs, "key").where("vertex <> hub").groupBy("vertex", "hub").agg(F.count("*").alias("times"))
    links = close(often.groupBy("vertex").agg(F.max_by("hub", F.struct("times", "hub")).alias("a")).withColumnRenamed("vertex", "b"))

    tagged = _of_several(members, vertices, graph.components(links))
    counts = tagged.groupBy("key", "label").agg(F.count("*").alias("times"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("times", "label")).alias("main"))
    tagged = tagged.join(main, "key")
    hubs = tagged.where("label = main").groupBy("key").agg(F.max(central).alias("h0"), *[F.max(F.when(F.pmod(F.xxhash64("vertex"), F.lit(HUBS)) == i, central)).alias(f"h{i}") for i in range(1, HUBS)])
    hubs = hubs.select("key", F.array_distinct(F.array_compact(F.array(*[F.col(f"h{i}.vertex") for i in range(HUBS)]))).alias("hubs"))
    outside = tagged.where("label <> main").join(hubs, "key").select(F.col("vertex").alias("b"), F.explode("hubs").alias("a")).distinct()
    links = common.stored(links.union(close(outside)), "links")
    tagged = _of_several(members, vertices, graph.components(links))

    sets = shingle_sets(docs, vertices, tagged.select("vertex").distinct(), width)
    alone = sets.select("vertex", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("times"), F.min("vertex").alias("vertex")).where("times = 1")
    alone = alone.groupBy("vertex").agg(F.count("*").alias("own"))
    facts = vertices.select("vertex", "n", "signature").join(sets.select("vertex", "spread"), "vertex").join(alone, "vertex", "left")
    facts = common.stored(facts.select("vertex", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"), "signature", "spread"), "facts")
    tagged = tagged.drop("weight").join(facts.select("vertex", "n", "m"), "vertex")
    # A vertex that could not even be like the smallest of its key, were that all shared, is done with.
    small = tagged.groupBy("key").agg(F.min("n").alias("small"))
    tagged = tagged.join(small, "key").where(100 * F.col("m") >= like.percent * (F.col("n") + F.col("small") - F.col("m"))).drop("small")
    tagged = common.stored(tagged, "able")
    counts = tagged.groupBy("key", "label").agg(F.count("*").alias("times"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("times", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    tagged = tagged.join(main, "key").join(facts.select("vertex", "signature", "spread"), "vertex")
    tagged = common.stored(tagged, "last")
    x, y = (tagged.select(*[F.col(c).alias(f"{c}{i}") for c in ("key", "vertex", "label", "main", "n", "m", "signature", "spread")]) for i in "ab")
    most = F.least("ma", "mb")
    able = 100 * most >= like.percent * (F.col("na") + F.col("nb") - most)
    # Each pair with a vertex outside the key's main component, once.
    once = F.expr("keya = keyb AND labela <> labelb AND (labelb = mainb OR vertexa < vertexb)")
    near = let(differing("signaturea", "signatureb"), lambda d: (F.bit_count(d) <= like.distance) & (F.col("keya").bitwiseAND(HASHES - 1) == first_key(d, like)))
    # No more shingles are common than both have by residue.
    most = F.aggregate(F.zip_with("spreada", "spreadb", lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda s, c: s + c)
    likely = (F.col("na") > LARGE) | let(most, lambda c: 100 * c >= like.percent * (F.col("na") + F.col("nb") - c))
    pairs = x.where("labela <> maina").join(y, once & able & near & likely)
    pairs = pairs.select(F.col("vertexa").alias("a"), F.col("vertexb").alias("b"))
    return rows.drop("signature"), links.union(confirmed(common.stored(pairs, "pairs"), sets, like))


def _of_several(members: DataFrame, vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, vertex, weight, label) of keys whose vertices belong to more than one component."""
    known = vertices.select("vertex").join(labels.withColumnRenamed("v", "vertex"), "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("label"))
    tagged = members.join(known, "vertex")
    several = tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return common.stored(tagged.join(several, "key", "left_semi"), "tagged")


def shingle_sets(docs: DataFrame, vertices: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The full sets (vertex, spread, shingles) of the asked vertices."""
    asked = vertices.select("vertex", "doc").join(asked, "vertex").select(F.col("vertex").alias("asked"), "doc")
    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("doc"))).select("asked", "text")
    sets = texts.mapInArrow(lambda b: signed(b, width, True), "asked long, n_shingles long, vertex long, spread array<smallint>, shingles array<long>")
    # Rows that share a doc_id, or have none, may bring other texts along.
    return common.stored(sets.where("asked = vertex").dropDuplicates(["vertex"]).select("vertex", "spread", "shingles"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    one, two = (sets.select(F.col("vertex").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return common.stored(both.where(100 * F.col("common") >= like.percent * union).select("a", "b"), "links")


def classes(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, n_shingles, component_id, kept)."""
    rows, links = linked(docs, like)
    labels = graph.components(links).withColumnRenamed("v", "vertex")
    rows = rows.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    rows = rows.withColumn("component_id", component)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """docs with one document of each group of near-duplicates: rows that share a doc_id are one document, and of its rows that repeat a text one stays."""
    ids = classes(docs, like).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["doc_id", "text"])


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: shingles of 3 words, similarity 0.85."""
    return classes(common.read(spark, sf_dir, "documents"), Similarity(3, 85))
