"""Mixing sources to target weights by Pareto order sampling, in native DataFrame operations.

Sources share the words of all documents by weight; no target exceeds ``most`` times its source's words, and what is
cut is shared again by weight among the others. A source with target T and W words takes ``floor(T / W)`` whole copies
of each document, and for the rest a Pareto order sample: document i with inclusion probability f_i has the rank
(U / (1 - U)) / (f_i / (1 - f_i)), U a hash of seed and doc_id, and the lowest ranks are taken
until their words reach what is left. Inclusion is unequal: f_i rises with the document's length around the source's
mean share, so that expected words still equal the rest.

The words below the cut are found without sorting a source in one task: ranks fall into ``CELLS`` cells by value, cells
are summed, and only the cell that the cut lies in is split again, twice; the documents of the last cell alone are
ordered. Sources with nothing left are left out. Rows of one doc_id (or of none) have one rank, so they share a cell. A second pass over what is left fills the gap that the first document over the cut leaves.

Tables with a row a source are broadcast where there are no more than ``HELD_SOURCES`` sources, and joined by a shuffle
beyond that, when no few sources can hold most rows' tasks.

Edge cases: null or blank texts have no words and are taken no times; a null source is a source, last in order; rows
that repeat a doc_id are documents of their own (the same rank, decided by order of size, then alike); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.llm import common, quality_rules

#: A rank in [0, 1) is looked up in this many cells at each of LEVELS levels.
CELLS, LEVELS = 1024, 3
#: Budgets are doubles; sums of words may pass them by this much.
SLACK = 1e-6
SEED = "mix-1"
#: Sources whose rows each task may hold: a few numbers a source.
HELD_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size), one row a source, with ``target``: min(most * size, share * weight) with the share that makes the targets add up to all words.

    Sources that are cut are those with the least size by weight, so one pass over the sources in that order finds the
    share. The windows hold a row a source, not a row a document.
    """
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    sized = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(place) - 1) % len(weights) + 1).cast("double"))
    sized = sized.withColumn("cap", (most * F.col("source_size")).cast("double"))
    everyone = Window.partitionBy(F.lit(0))
    by_need = everyone.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumns({
        "words": F.sum("source_size").over(everyone).cast("double"), "weights": F.sum("weight").over(everyone),
        "cut": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    sized = sized.withColumn("share", (F.col("words") - F.col("cut")) / (F.col("weights") - F.col("gone")))
    # The share that holds is the first, in that order, under which its source stays below its cap.
    fits = F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("gone", "share"))
    share = F.coalesce(F.min(fits).over(everyone)["share"], F.lit(float("inf")))
    return sized.withColumn("target", F.least(F.col("cap"), share * F.col("weight"))).select("source", "source_size", "target")


def merit(size: Column) -> Column:
    """Grows from 0 to 1 with a document's words: fragments are a little less likely than full texts."""
    return 1 - 1 / (1 + F.ln(1 + size))


def ranked(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs (doc_id, size, source_size, target, mean_merit) with ``whole`` copies, the words ``rest`` left for the
    sample, and the Pareto ``rank`` mapped to [0, 1)."""
    # A last copy that rounding alone makes partial counts as whole.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    docs = docs.withColumn("whole", whole)
    docs = docs.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    docs = docs.withColumn("share", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    # |merit - mean| < 1 keeps the inclusion within (0, 1); its mean weighted by size is share.
    slope = 0.5 * F.least(F.lit(1.0), (1 - F.col("share")) / F.greatest(F.col("share"), F.lit(1e-12)))
    docs = docs.withColumn("inclusion", F.col("share") * (1 + slope * (merit(F.col("size")) - F.col("mean_merit"))))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10)
    docs = docs.withColumn("u", (digits.cast("double") + 0.5) / float(1 << 48))
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("inclusion")) / F.col("inclusion"))
    rank = F.when(F.col("inclusion") > 0, odds / (1 + odds)).otherwise(1 - 2.0**-30)
    return docs.withColumn("rank", rank).drop("share", "inclusion", "u")


def held(by_source: DataFrame, n_sources: int | None) -> DataFrame:
    """A table with a row a source, for a join: broadcast where that is known to be small."""
    return F.broadcast(by_source) if n_sources is not None and n_sources <= HELD_SOURCES else by_source


def prefixes(docs: DataFrame, budgets: DataFrame, n_sources: int | None = None) -> DataFrame:
    """The rows of docs (row, k, doc_id, size, rank) that make up, in each source k, the longest prefix by rank, doc_id
    and size whose sizes add up to budgets (k, left) at most."""
    # Where nothing is left nothing is taken, and all ranks may be one: such a source would be ordered whole.
    budgets = budgets.where(F.col("left") > SLACK)
    at, cuts = docs, budgets.withColumn("cut", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        inside = F.floor(F.col("rank") * float(CELLS ** (level - 1))).cast("long") == F.col("cut")
        cells = at.join(held(cuts, n_sources), "k").where(inside).groupBy("k", F.floor(F.col("rank") * float(CELLS**level)).cast("long").alias("cell"))
        cells = cells.agg(F.sum("size").alias("words"), F.max("left").alias("left"))
        cells = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("k").orderBy("cell")))
        over = cells.where(F.col("upto") > F.col("left") + SLACK).groupBy("k").agg(F.min_by(F.struct("cell", F.col("left") - F.col("upto") + F.col("words")), "cell").alias("f"))
        cuts = over.select("k", F.col("f.cell").alias("cut"), F.col("f.col2").alias("left"))
    cell = F.floor(F.col("rank") * float(CELLS**LEVELS)).cast("long")
    ends = common.stored(budgets.select("k").join(cuts.select("k", "cut", F.col("left").alias("gap")), "k", "left"), "cuts")
    found = docs.join(held(ends, n_sources), "k").withColumn("cell", cell)
    order = Window.partitionBy("k", "cell").orderBy("rank", "doc_id", "size", "row")
    last = found.where("cell = cut").withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= F.col("gap") + SLACK)
    return found.where("cut IS NULL OR cell < cut").select("row").unionByName(last.select("row"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, passes: int = 2, seed: str = SEED) -> DataFrame:
    """docs (doc_id, source, size) with source_size, target and taken, the words that the mix takes of each document."""
    docs = docs.select("doc_id", "source", "size")
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * merit(F.col("size"))).alias("m"))
    means = sources.select(F.col("source").alias("s"), F.round(F.coalesce(F.try_divide("m", "source_size"), F.lit(0.0)), 6).alias("mean_merit"))
    shares = targets(sources.select("source", "source_size"), weights, most)
    shares = common.stored(shares.join(means, F.col("source").eqNullSafe(F.col("s"))).withColumn("k", F.monotonically_increasing_id()).drop("source"), "shares")
    n_sources = shares.count()
    docs = docs.join(held(shares, n_sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    docs = common.stored(ranked(docs, seed).withColumn("row", F.monotonically_increasing_id()), "ranked")
    # Documents without words are never worth a pick.
    rest, picked = docs.where("size > 0").select("row", "k", "doc_id", "size", "rank"), None
    left = common.stored(docs.groupBy("k").agg(F.max("rest").alias("left")), "left")
    for _ in range(passes):
        found = common.stored(prefixes(rest, left, n_sources), "picked")
        picked = found if picked is None else picked.unionByName(found)
        used = rest.join(found, "row").groupBy("k").agg(F.sum("size").alias("used"))
        left = common.stored(left.join(used, "k", "left").select("k", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")), "left")
        rest = rest.join(found, "row", "left_anti").join(held(left, n_sources), "k").where(F.col("size") <= F.col("left") + SLACK).drop("left")
    docs = docs.join(picked.withColumn("once", F.lit(1)), "row", "left")
    return docs.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.coalesce("once", F.lit(0)))).cast("long").alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) with the number of words in place of the text."""
    return docs.select("doc_id", "source", quality_rules.n_words(F.col("text")).alias("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs as often as the mix takes them. Rows of one doc_id, source and size are told apart by their order of text."""
    taken = common.stored(mix(common.stored(sized(docs), "sized")), "mix").where("taken > 0")
    alike = ["doc_id", "source", "size"]
    taken = taken.select(*alike, (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy(F.col("copies").desc())))
    taken = taken.select(*(F.col(c).alias(f"_{c}") for c in (*alike, "nth", "copies")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "_words").orderBy("text"))
    rows = docs.withColumn("_words", quality_rules.n_words(F.col("text"))).withColumn("_row", nth)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")) & (F.col("_row") == F.col("_nth"))
    return rows.join(taken, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3, repeating."""
    docs = common.stored(sized(common.read(spark, sf_dir, "documents")), "sized")
    return mix(docs).drop("source")


def oracle(documents: str = "documents", passes: int = 2) -> str:
    """The same mix in SQL, with plain running sums in place of cells."""
    steps, not_yet = "", "TRUE"
    for i in range(1, passes + 1):
        steps += f""",
left{i} AS (SELECT s, max(rest) - coalesce(sum(size) FILTER (NOT ({not_yet})), 0) AS gap FROM r{i} GROUP BY s),
r{i + 1} AS (
  SELECT r{i}.*, CASE WHEN {not_yet} AND size > 0 AND size <= gap + {SLACK if i > 1 else 1e300}
    AND sum(CASE WHEN {not_yet} AND size <= gap + {SLACK if i > 1 else 1e300} THEN size ELSE 0 END) OVER (PARTITION BY r{i}.s ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap + {SLACK} THEN 1 ELSE 0 END AS p{i}
  FROM r{i} JOIN left{i} l ON l.s = r{i}.s)"""
        not_yet = " AND ".join(f"p{j} = 0" for j in range(1, i + 1))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1114111)) AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {documents}),
m AS (SELECT s, sum(size) AS source_size, round(coalesce(sum(size * (1 - 1 / (1 + ln(1 + size)))) / nullif(sum(size), 0), 0), 6) AS mean FROM d GROUP BY s),
w AS (SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY s) - 1) % 3 + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM m),
c AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS words, sum(weight) OVER () AS weights,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
        coalesce(sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w),
h AS (SELECT *, (words - cut) / (weights - gone) AS share FROM c),
t AS (SELECT s, source_size, mean, least(cap, coalesce((SELECT arg_min(share, gone) FROM h WHERE share * weight <= cap), 1e300) * weight) AS target FROM h),
a AS (SELECT d.*, source_size, target, mean, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END::BIGINT AS whole,
        (('0x' || substr(md5('{SEED}:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM d JOIN t ON t.s = d.s),
b AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM a),
e AS (SELECT *, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0 END AS f FROM b),
i AS (SELECT *, f * (1 + 0.5 * least(1, (1 - f) / greatest(f, 1e-12)) * (1 - 1 / (1 + ln(1 + size)) - mean)) AS pi FROM e),
r1 AS (SELECT *, CASE WHEN pi > 0 THEN 1 - 1 / (1 + (u / (1 - u)) * ((1 - pi) / pi)) ELSE 1 END AS rank FROM i){steps}
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (whole + {" + ".join(f"p{j}" for j in range(1, passes + 1))}))::BIGINT AS taken FROM r{passes + 1}
"""
