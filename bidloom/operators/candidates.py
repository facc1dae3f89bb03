"""Candidates for quote lines that no code matched: a similarity join that loses nothing and pairs nothing at random.

A score is a weighted sum of four signals, two of which have few values. From what the other signals can add at most
follows what a pair of a score of ``least`` or more must have in common:

- a share of common words (Jaccard) of ``WORDS`` at least, or
- a specification that agrees, at least in part, and texts nearly as long as one another, or
- the item's brand in the line's text, and texts about as long as one another.

Each is a key to join on. Words are looked up by their rarest ones only (a prefix long enough that two sets with that
share of common words meet in it), and by two at a time where sets of those sizes have to share two; specifications and
brands are joined with a class of length. Pairs that meet are held against an upper bound from exact signals, lengths and counts of characters
before the costly ratio is computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions import text
from bidloom.operators import matching
from bidloom.operators.matching import BRAND, JACCARD, MARGIN, REVIEW, SPEC, TOKEN_SORT
from bidloom.sources.stage import stored

#: Scores below this bear on no line's state: they are no match, nor close enough to the least match to be ambiguous.
LEAST = REVIEW - MARGIN
#: Scores are rounded to three digits.
SLACK = 0.0005 + 1e-9


def words_needed(least: float) -> float:
    """The share of common words without agreeing specifications or brand, the ratio of the texts being 1."""
    return max((least - SLACK - TOKEN_SORT - SPEC * 0.5 - BRAND * 0.5) / JACCARD, 1e-9)


def ratio_needed(least: float, brand: float) -> float:
    """The least ratio of the texts, with agreeing specifications and fewer common words than ``words_needed``."""
    return max((least - SLACK - SPEC - BRAND * brand - JACCARD * words_needed(least)) / TOKEN_SORT, 0.05)


def length_class(length: Column, ratio: float) -> Column:
    """Texts with this ratio or more are in the same class or in neighbouring ones."""
    return F.floor(F.ln(F.greatest(length, F.lit(1))) / math.log((2 - ratio) / ratio)).cast("int")


def substrings(s: Column) -> Column:
    ends = lambda i: F.transform(F.sequence(i, F.length(s)), lambda j: F.substr(s, i, j - i + 1))
    return F.when(F.length(s) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), ends))).otherwise(F.array().cast("array<string>"))


def grams(s: Column) -> Column:
    """All runs of one to three characters."""
    n = F.length(s)
    cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(cut(1), cut(2), cut(3)))


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def histogram(s: Column) -> Column:
    """How often each of LETTERS occurs, and all others together."""
    counts = [F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in LETTERS]
    return F.array(*counts, F.length(F.translate(s, LETTERS, "")))


def described(texts: DataFrame, of: str) -> DataFrame:
    """texts with words, specs, the sorted words of a text column as a line, and that line's length and characters."""
    line = matching.sorted_tokens(F.col(of))
    out = texts.withColumns({"words": text.word_tokens(text.norm_desc(F.col(of))), "specs": text.spec_tokens(F.col(of)), "line": line})
    return out.withColumns({"length": F.length("line"), "letters": histogram(F.col("line"))})


#: Sets of at most so many words meet by two of their words.
SHORT = 8


def rare_words(words: DataFrame, often: DataFrame, share: float, left: bool) -> DataFrame:
    """(id, key, class) of the words by which sets (id, words) with that share of common words meet. left: which side of
    the join it is.

    Sets of n and m words need share / (1 + share) * (n + m) words in common. Where that is one, the sets are small, and
    meet by any word in the class of their two sizes. Where it is more, sets of which one is small meet by two words, and
    others by one, in both cases without the most frequent ones.
    """
    held = words.select("id", F.explode("words").alias("word")).join(often, "word")
    ordered = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w")).withColumn("size", F.size("w"))
    ordered = ordered.withColumn("w", F.transform("w", lambda x: x["word"]))
    n, one = F.col("size"), math.floor((1 + share) / share + 1e-9)
    need = F.ceil(share * n - 1e-9).cast("int")
    few = ordered.where(n < one).select("id", "size", F.explode("w").alias("word"), F.sequence(F.lit(1), F.lit(one) - n).alias("others"))
    few = few.select("id", "size", "word", F.explode("others").alias("other"))
    sizes = (F.col("size"), F.col("other")) if left else (F.col("other"), F.col("size"))
    few = few.select("id", F.concat(F.lit("word "), "word").alias("key"), (sizes[0] * one + sizes[1]).alias("class"))
    kept = F.slice("w", 1, n - F.greatest(need, F.lit(2)) + 2)
    two = ordered.where((n >= 2) & (share * n <= SHORT + 1e-9)).withColumn("w", kept)
    both = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda y: F.concat(F.lit("words "), x, F.lit(" "), y))))
    two = two.select("id", F.explode(both).alias("key"), F.lit(0).alias("class"))
    most = F.greatest(need, F.ceil(share / (1 + share) * (n + SHORT + 1) - 1e-9).cast("int"))
    many = ordered.where(n > SHORT).select("id", F.explode(F.slice("w", 1, n - most + 1)).alias("word"))
    return few.union(two).union(many.select("id", F.concat(F.lit("long "), "word"), F.lit(0)))


def keys(quoted: DataFrame, known: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, key, class) of both sides; every pair with a score of least or more has one of them in common."""
    words = words_needed(least)
    often = quoted.select(F.explode("words").alias("word")).union(known.select(F.explode("words"))).groupBy("word").agg(F.count("*").alias("n"))
    likes = {"spec": ratio_needed(least, 0.5), "brand": ratio_needed(least, 1.0)}
    near = lambda kind: F.array(*(length_class(F.col("length"), likes[kind]) + d for d in (-1, 0, 1)))
    named = lambda kind, values: F.array_distinct(F.transform(values, lambda v: F.concat(F.lit(f"{kind} "), v)))
    # Specifications agree if one side's are all among the other's, or if each of the line's is part of one of the
    # item's or the other way about; for that one of the line's, the longest, has to be.
    longest = F.array_max(F.transform("specs", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    mine = F.when(F.size("specs") > 0, F.concat(named("whole", F.array_union("specs", substrings(longest))), named("part", F.array(longest)))).otherwise(F.array().cast("array<string>"))
    theirs = F.concat(named("whole", F.col("specs")), named("part", F.flatten(F.transform("specs", substrings))))
    left = quoted.select("id", F.explode(mine).alias("key"), near("spec").alias("c")).select("id", "key", F.explode("c").alias("class"))
    left = left.union(quoted.select("id", F.explode(named("brand", grams(F.lower("text")))).alias("key"), near("brand").alias("c")).select("id", "key", F.explode("c")))
    right = known.select("id", F.explode(theirs).alias("key"), length_class(F.col("length"), likes["spec"]).alias("class"))
    brand = known.where("brand <> ''").select("id", F.concat(F.lit("brand "), F.substring(F.lower("brand"), 1, 3)), length_class(F.col("length"), likes["brand"]))
    return left.union(rare_words(quoted, often, words, True)), right.union(brand).union(rare_words(known, often, words, False))


def scored(quoted: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """All pairs of quoted (id, text) and known (id, text, brand) with a score of least or more: (q, c, score).

    Where few words or none are needed in common (a least of 0.575 or below) words no longer find all pairs.
    """
    if words_needed(least) < 0.01:
        raise ValueError(f"pairs below a score of {TOKEN_SORT + (SPEC + BRAND) / 2 + 0.01 * JACCARD + SLACK:.3f} need not share a word")
    quoted, known = stored(described(quoted, "text"), "quoted"), stored(described(known, "text"), "known")
    left, right = keys(quoted, known, least)
    met = left.withColumnRenamed("id", "q").join(right.withColumnRenamed("id", "c"), ["key", "class"]).select("q", "c").distinct()
    side = lambda df, key, names: df.select(F.col("id").alias(key), *(F.col(c).alias(name) for c, name in names.items()))
    pairs = met.join(side(quoted, "q", {"text": "quoted", "line": "quoted_line", "length": "n", "letters": "x", "words": "_q", "specs": "_qs"}), "q")
    pairs = pairs.join(side(known, "c", {"line": "known_line", "brand": "brand", "length": "m", "letters": "y", "words": "_c", "specs": "_cs"}), "c")
    pairs = matching.compared(pairs, F.col("quoted"), F.col("brand"))
    short, total = F.least("n", "m"), F.col("n") + F.col("m")
    signals = ["jaccard", "spec_score", "brand_score"]
    most = lambda common: TOKEN_SORT * F.when(total > 0, 2 * common / total).otherwise(1.0) + JACCARD * F.col("jaccard") + SPEC * F.col("spec_score") + BRAND * F.col("brand_score")
    # The bound from lengths comes first. As a generator: filters would be merged, with each signal written out in both.
    near = F.when(most(short) >= least - SLACK, F.array(F.struct(*signals)))
    pairs = pairs.select("q", "c", "quoted_line", "known_line", "n", "m", "x", "y", F.inline(near))
    both = F.aggregate(F.zip_with("x", "y", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    pairs = pairs.where(most(both) >= least - SLACK).drop("n", "m", "x", "y")
    return matching.weighted(pairs.withColumn("token_sort", matching.indel_ratio("quoted_line", "known_line"))).where(F.col("score") >= least).select("q", "c", "score")


def line_candidates(matched: DataFrame, items: DataFrame, k: int = 5, least: float = LEAST) -> DataFrame:
    """The k best active items, of those with a score of least or more, of each line that no code matched: (quote_id,
    line_index, internal_item_id, score, place, ambiguous, status), ties in master order.

    What is scored are distinct descriptions in lower case (a score does not depend on case) and distinct descriptions of
    items; with an item's brand only where some line names it, as other brands bear on no score. A null description is an
    empty one. matched: as ``exact_match`` gives it.
    """
    lines = matched.where("match_method = 'NO_MATCH'").select("quote_id", "line_index", F.lower(F.coalesce("raw_description", F.lit(""))).alias("text"))
    quoted = stored(lines.select("text").distinct().withColumn("id", F.monotonically_increasing_id()), "texts")
    named = items.where("status = 'ACTIVE'").select(F.coalesce("canonical_description", F.lit("")).alias("text"), F.coalesce("brand", F.lit("")).alias("brand"), "master_pos", "internal_item_id")
    parts = quoted.select("text", F.explode(grams(F.col("text"))).alias("part"))
    brands = named.where("brand <> ''").select("brand").distinct().withColumn("part", F.substring(F.lower("brand"), 1, 3))
    told = brands.join(parts, "part").where(F.contains("text", F.lower("brand"))).select("brand").distinct()
    named = named.withColumn("brand", F.lit("")).unionByName(named.join(told, "brand"))
    first = Window.partitionBy("text", "brand").orderBy("master_pos", "internal_item_id")
    # Of items that score alike, k are enough.
    known = named.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).groupBy("text", "brand").agg(F.sort_array(F.collect_list(F.struct("master_pos", "internal_item_id"))).alias("items"))
    known = stored(known.withColumn("id", F.monotonically_increasing_id()), "items")
    found = scored(quoted, known.drop("items"), least).join(known.select(F.col("id").alias("c"), "items", (F.col("brand") != "").alias("branded")), "c")
    # The k best items are among those of the k best descriptions, each by its first item, with or without a brand. An item
    # that is there both ways counts by its higher score.
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("q", "branded").orderBy(F.desc("score"), "items"))).where(F.col("nth") <= k)
    best = best.select("q", "score", F.inline("items")).groupBy("q", "master_pos", "internal_item_id").agg(F.max("score").alias("score"))
    top = matching.top_candidates(best.withColumn("order", F.struct("master_pos", "internal_item_id")), ["q"], "order", k).join(quoted.withColumnRenamed("id", "q"), "q")
    return lines.join(top, "text").select("quote_id", "line_index", "internal_item_id", "score", "place", "ambiguous", "status")
