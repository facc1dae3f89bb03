"""Document fingerprints by SpotSigs, in native column expressions.

Words are runs of letters and digits, lower-cased. Where one or more common words (anchors) stand before a content
word, the chain of that and the next content words, ``CHAIN`` in all or as many as the text still has, is a spot
signature; a fingerprint is the sorted set of the signatures' hashes. A text without anchors has one signature, all its
words; one without words has itself; the empty text has none. Likeness is the Jaccard similarity of two sets, 1 for two
empty ones.

``near_pairs`` finds all pairs of fingerprints from a likeness on: sets are dealt to partitions by length, so wide that
only neighbours can be alike enough, and meet only on the signatures of a prefix that alike sets must share, the rarest
signatures first; equal sets are one class.

Edge cases: a null text counts as empty; texts are read whole; equal texts, also in repeated rows, have equal
fingerprints; the next of the last document is the first (of a lone one, itself); null ids come last and ties of ids
are ordered by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.llm import common
from bidloom.llm.quality_rules import let

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine er es ist mit nicht sich und von zu "
    "ce dans de des du elle en est et la le les pas pour que qui sur un une "
    "al con como del el lo los las no por se su una y"
).split()
CHAIN, DIGITS = 3, 10
#: Ranges of doc_id have about so many rows at least, and no more than so many where ranges outnumber the partitions.
RANGE_ROWS, MOST_ROWS = 2000, 1_000_000


def fingerprint(text: Column) -> Column:
    """The sorted distinct hashes of a text's spot signatures."""
    anchors = sorted(set(ANCHORS))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def spots(w: Column) -> Column:
        content = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: ~x["w"].isin(anchors))
        return let(content, chains)

    def chains(c: Column) -> Column:
        def chain(x: Column, j: Column) -> Column:
            after = x["i"] > F.coalesce(F.get(c, j - 1)["i"], F.lit(-1)) + 1
            return F.when(after, F.concat_ws(" ", x["w"], *(F.get(c, j + k)["w"] for k in range(1, CHAIN))))

        return F.filter(F.transform(c, chain), lambda x: x.isNotNull())

    def or_all(w: Column) -> Column:
        whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
        return let(spots(w), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))

    hashes = F.transform(let(words, or_all), lambda s: F.substring(F.md5(s), 1, DIGITS))
    return F.sort_array(F.array_distinct(hashes))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def within(value: Column, bounds: list) -> Column:
    """How many of the rising bounds value has reached, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    reached = lambda some: F.size(F.filter(some, lambda b: b <= value))
    # A block is the last one whose first bound is reached; before the first there is none to look in.
    blocks = F.lit([bounds[i : i + step] for i in range(0, len(bounds) - step, step)] + [(bounds[(len(bounds) - 1) // step * step :] + [bounds[-1]] * step)[:step]])
    block = reached(F.lit(bounds[::step]))
    inside = F.least((block - 1) * step + reached(F.get(blocks, block - 1)), F.lit(len(bounds)))
    return F.when(block > 0, inside).otherwise(0)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with its fingerprint and the next document's text and fingerprint, by ascending doc_id.

    Ranges of doc_id between approximate quantiles are ordered each on its own; the first rows of a range are sent to
    the range before it too. One exchange carries the texts; the ranges, whose number follows the documents', have a
    row each in the table of their first ids.
    """
    n = docs.count()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(n // RANGE_ROWS, max(partitions, n // MOST_ROWS)))
    quantiles = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)) if ranges > 1 else None
    bounds = sorted(set(docs.select(quantiles.alias("q")).first()["q"] or [])) if ranges > 1 else []
    docs = docs.withColumn("range", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(within(F.col("doc_id"), bounds)))
    firsts = docs.groupBy("range").agg(F.min("doc_id").alias("first"))
    by_range = Window.partitionBy(F.lit(0)).orderBy("range")
    last = F.max("range").over(Window.partitionBy(F.lit(0)))
    firsts = firsts.withColumn("before", F.coalesce(F.lag("range").over(by_range), last))
    docs = docs.join(F.broadcast(firsts), "range")
    here = F.struct(F.col("range").alias("at"), F.lit(0).alias("tail"))
    there = F.struct(F.col("before").alias("at"), F.lit(1).alias("tail"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(here, there)).otherwise(F.array(here))
    docs = docs.select("doc_id", "text", F.inline(places))
    # Dealt out before the fingerprints are made, which then need no exchange.
    docs = docs.repartition(max(partitions, len(bounds) + 1), "at").withColumn("set", fingerprint(F.col("text")))
    order = Window.partitionBy("at").orderBy("tail", F.col("doc_id").asc_nulls_last(), "text")
    return docs.withColumns({"next_text": F.lead("text").over(order), "next_set": F.lead("set").over(order)}).where("tail = 0").drop("tail", "at")


def near_pairs(sets: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Of sets (id, set): rows (id, class), and pairs (a, b, likeness) of classes from a likeness of least on.

    A class is the least id of equal sets. Two sets of n and m >= n signatures can be alike only if n >= least * m, so
    lengths fall into bands of ratio 1 / least and only equal or neighbouring bands meet; and they share one of the first
    n - ceil(least * n) + 1 signatures in any fixed order of the signatures, here by the number of classes that hold them.
    """
    sets = sets.select("id", "set").withColumn("key", F.sha2(F.array_join("set", ","), 256))
    heads = sets.where(F.size("set") > 0).groupBy("key").agg(F.min("id").alias("class"), F.first("set").alias("set"))
    members = sets.select("id", "key").join(heads.select("key", "class"), "key", "left").select("id", F.coalesce("class", "id").alias("class"))
    heads = common.stored(heads.select("class", "set"), "heads")
    held = heads.select("class", F.explode("set").alias("spot"))
    often = held.groupBy("spot").agg(F.count("*").alias("n"))
    ordered = held.join(often, "spot").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "spot"))).alias("s"))
    size = F.size("s")
    band = F.floor(F.ln(size) / math.log(1 / least) + 1e-9).cast("int")
    prefix = ordered.select("class", size.alias("n"), band.alias("band"), F.explode(F.slice("s", 1, size - F.ceil(size * least - 1e-9).cast("int") + 1)).alias("p"))
    prefix = prefix.select("class", "n", "band", F.col("p.spot").alias("spot"))
    one = prefix.select(F.col("class").alias("a"), F.col("n").alias("na"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), "spot")
    two = prefix.select(F.col("class").alias("b"), F.col("n").alias("nb"), "band", "spot")
    found = one.join(two, ["band", "spot"]).where((F.col("na") <= F.col("nb")) & (F.col("a") != F.col("b")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b"))) & (F.col("na") >= least * F.col("nb") - 1e-9))
    found = found.select("a", "b").distinct()
    sa, sb = (heads.select(F.col("class").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    scored = found.join(sa, "a").join(sb, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return members, scored.where(F.col("likeness") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    docs = with_next(docs).withColumn("edited", edited)
    docs = docs.withColumn("edited_set", fingerprint(F.col("edited")))
    return docs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("set", ",").alias("fingerprint"), F.array_join("edited_set", ",").alias("edited_fingerprint"),
        likeness(F.col("set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("set"), F.col("next_set")).alias("near_next"),
    )


def _sql_set(text: str) -> str:
    """DuckDB SQL for the fingerprint of a text column of a table t, as a table (doc_id, s)."""
    quoted = ", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))
    later = ", ".join(f"c[j + {k}].w" for k in range(1, CHAIN))
    return f"""
  SELECT doc_id, list_sort(list_distinct(list_transform(
      CASE WHEN len(p) > 0 THEN p WHEN len(w) > 0 THEN [array_to_string(w, ' ')] WHEN {text} <> '' THEN [{text}] ELSE []::VARCHAR[] END,
      lambda x: substr(md5(x), 1, {DIGITS})))) AS s
  FROM (SELECT *, list_filter(list_transform(c, lambda x, j: CASE WHEN x.i > coalesce(c[j - 1].i, 0) + 1 THEN concat_ws(' ', x.w, {later}) END), lambda x: x IS NOT NULL) AS p
  FROM (SELECT *, list_filter(list_transform(w, lambda x, i: {{'w': x, 'i': i}}), lambda x: x.w NOT IN ({quoted})) AS c
  FROM (SELECT doc_id, {text}, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM t)))"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(doc_id) OVER o, min(doc_id) OVER ()) AS next_id, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM d WINDOW o AS (ORDER BY doc_id, text)),
t AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
a AS ({_sql_set("text")}),
e AS ({_sql_set("edited")}),
j AS (SELECT t.*, a.s AS sa, e.s AS se, x.s AS sn FROM t JOIN a USING (doc_id) JOIN e USING (doc_id) JOIN a x ON x.doc_id = t.next_id)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(sa, ',') AS fingerprint, array_to_string(se, ',') AS edited_fingerprint,
       CASE WHEN len(sa) + len(se) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(sa, se))::DOUBLE / (len(sa) + len(se) - len(list_intersect(sa, se))) END AS near_edited,
       CASE WHEN len(sa) + len(sn) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(sa, sn))::DOUBLE / (len(sa) + len(sn) - len(list_intersect(sa, sn))) END AS near_next
FROM j
"""
