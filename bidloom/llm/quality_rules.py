"""Quality rules as a short-circuit cascade, in native column expressions.

A rule maps a text column to a condition under which the document fails. ``ordered`` estimates on a bounded
sample what each rule costs and what share it rejects, and puts the rules with the most rejections per second first;
``cascade`` then evaluates them in one CASE, so that a document pays for no rule after the first that rejects it.
The order changes the time and the rule that is named, never the verdict.

Edge cases: a null or blank text has no words and fails ``few_words``; texts of any length are read whole; repeated
rows are judged each on its own; an empty table gives an empty result; other columns pass through, and columns named
like the added ones are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

#: At most about so many rows are read to estimate costs and rejections.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACES, "")).cast("long")


def n_words(text: Column) -> Column:
    return F.size(common.words(text)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    The windows' hashes are sorted with their positions; equal neighbours are repeats, and each repeated window
    adds the words up to the next repeated one, three at most.
    """

    def windows(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return F.sort_array(F.transform(starts, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def repeats(s: Column) -> Column:
        def twice(e: Column, i: Column) -> Column:
            return e["h"].eqNullSafe(F.get(s, i - 1)["h"]) | e["h"].eqNullSafe(F.get(s, i + 1)["h"])

        return F.sort_array(F.filter(F.transform(s, lambda e, i: F.when(twice(e, i), e["i"])), lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(common.words(text), lambda w: let(windows(w), lambda s: let(repeats(s), covered))).cast("long")


#: The rules of production: two base rules, then rules that only clear junk fails.
RULES = (
    Rule("few_words", lambda t: n_words(t) < 50),
    Rule("repeated_words", lambda t: let(n_words(t), lambda n: 100 * n_repeat_words(t) > 50 * n)),
    Rule("symbols", lambda t: 100 * n_symbols(t) > 20 * n_words(t)),
    Rule("repeated_lines", lambda t: let(lines(t), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > 50 * F.size(x))),
    Rule("word_length", lambda t: let(n_words(t), lambda n: (word_chars(t) < 2 * n) | (word_chars(t) > 15 * n))),
    Rule("few_letters", lambda t: 100 * F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"\P{L}+", "")) < 50 * word_chars(t)),
)


def ordered(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a random sample of about ``sample_rows`` rows, dealt to
    eight tasks after every part of the table has been read by a task of its own.

    A rule's cost is the shorter of two runs, beyond what a job without a rule takes.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select(F.col(text).alias("t")).sample(share, 5).repartition(8).persist()
    n = sample.count()

    def timed(found: Column) -> tuple[float, int]:
        began = time.monotonic()
        rejected = sample.agg(F.count_if(found)).first()[0]
        return time.monotonic() - began, rejected

    idle = min(timed(F.col("t").isNull())[0] for _ in range(2))
    ranked = []
    for rule in rules:
        runs = [timed(rule.fails(F.col("t"))) for _ in range(2)]
        cost = max(min(s for s, _ in runs) - idle, 1e-3)
        ranked.append((-(runs[0][1] + 1) / (n + 1) / cost, rule.name, rule))
    sample.unpersist()
    return [rule for *_, rule in sorted(ranked, key=lambda x: x[:2])]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] | list[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with ``failed_rule`` (the first rule, in the given order, that the text fails; null if none) and ``kept``."""
    failed = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        failed = F.when(rule.fails(F.col(text)), F.lit(rule.name)).otherwise(failed)
    return docs.withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())


def kept(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns only."""
    failed = F.lit(False)
    for rule in reversed(ordered(docs, RULES)):
        failed = F.when(rule.fails(F.col("text")), F.lit(True)).otherwise(failed)
    return docs.where(~failed)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the cascade's verdict for every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    base, rest = RULES[:2], ordered(docs, RULES[2:])
    text = F.col("text")
    stats = docs.select("doc_id", "text", n_words(text).alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(text).alias("n_repeat_words"))
    # The base rules are read from the statistics that the report returns anyway.
    known = {"few_words": F.col("n_words") < 50, "repeated_words": 100 * F.col("n_repeat_words") > 50 * F.col("n_words")}
    stats = stats.withColumn("base_failed", known["few_words"] | known["repeated_words"])
    rules = [Rule(r.name, lambda _, r=r: known[r.name]) for r in base] + rest
    return cascade(stats, rules).drop("text", "failed_rule")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '\P{L}+', '', 'g')) AS n_letters
  FROM d LEFT JOIN p ON p.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_letters < 50 * word_chars) AS kept
FROM b
"""
