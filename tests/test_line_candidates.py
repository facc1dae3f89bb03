"""Unmatched quote lines against the item master, held against versions that score every pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bidloom.operators import candidates, matching


def ratio(a, b):
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 2 * row[-1] / (len(a) + len(b))


def score(quoted, known, brand):
    """Without specifications on either side."""
    q, c = (set(re.findall(r"\w+", x.lower())) for x in (quoted, known))
    return round(0.40 * ratio(quoted, known) + 0.25 * len(q & c) / len(q | c) + 0.20 * 0.5 + 0.15 * (1.0 if brand.lower() in quoted.lower() else 0.5), 3)


def test_every_pair(spark):
    texts = ["red steel valve", "red steel valves", "blue hose clamp", "hose clamp", "brass fitting", "red valve steel", "copperpipejoint"]
    items = [(f"I{i}", i, f"K{i}", f"M{i}", f"P{i}", t, b, "INACTIVE" if i == 3 else "ACTIVE") for i, (t, b) in enumerate([(t, b) for t in texts for b in ("Acme", "Zeta")] + [(texts[0], "Acme")] * 6)]
    lines = [("Q1", 0, "K 1", "red steel valve"), ("Q1", 1, "none", "RED steel valve acme"), ("Q2", 0, "none", "red steel valve Acme"), ("Q2", 1, None, "copperpipejoints zeta"), ("Q3", 0, "K3", "blue clamp"), ("Q3", 1, "", None)]
    master = spark.createDataFrame(items, "internal_item_id string, master_pos long, internal_sku string, manufacturer_part_number string, supplier_part_number string, canonical_description string, brand string, status string")
    quoted = spark.createDataFrame(lines, "quote_id string, line_index int, part_number string, raw_description string")
    got = {(r.quote_id, r.line_index, r.place): r for r in candidates.line_candidates(matching.exact_match(quoted, master), master).collect()}
    expected = {}
    for q, i, _, text in lines[1:5]:
        best = sorted((-score(text, x[5], x[6]), x[1], x[0]) for x in items if x[7] == "ACTIVE")
        close = -best[0][0] >= 0.70 and round(best[1][0] - best[0][0], 3) < 0.08
        expected |= {(q, i, n): (item, -s, close and n == 1) for n, (s, _, item) in enumerate(best[:5], 1) if -s >= candidates.LEAST}
    assert len(expected) >= 12
    assert {k: (r.internal_item_id, r.score, r.ambiguous) for k, r in got.items()} == expected


WORDS = "valve hose clamp steel brass copper fitting pipe joint m8x40mm m8 40mm 24v grade a ss304 stainless 10.5mm x dn50 inlet".split()


def some_texts(seed):
    """Texts of few words, and copies of them with other characters and brands."""
    rng = random.Random(seed)
    known = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))), rng.choice(["", "acme", "A", "Bosch GmbH", "zz"])) for i in range(220)]
    quoted = set()
    for _ in range(160):
        letters = list(rng.choice(known)[1])
        for _ in range(rng.randint(0, 4) if letters else 0):
            letters[rng.randrange(len(letters))] = rng.choice("abcxyz18 ")
        quoted.add("".join(letters).lower() + rng.choice(["", " acme", " bosch gmbh x"]))
    return list(enumerate(sorted(quoted))), known


@pytest.mark.parametrize("least", [0.62, 0.75])
def test_the_join_finds_what_all_pairs_hold(spark, least):
    quoted, known = some_texts(int(least * 100))
    quoted, known = spark.createDataFrame(quoted, "id long, text string"), spark.createDataFrame(known, "id long, text string, brand string")
    every = quoted.select(F.col("id").alias("q"), F.col("text").alias("quoted")).crossJoin(known.select(F.col("id").alias("c"), F.col("text").alias("known"), "brand"))
    every = matching.composite(matching.signals(every, "quoted", "known", "brand"), "quoted", "known").where(F.col("score") >= least).select("q", "c", "score")
    found = candidates.scored(quoted, known, least)
    want = {tuple(r) for r in every.collect()}
    assert len(want) > 20 and {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_scores_too_low_to_look_up_are_refused(spark):
    some = spark.createDataFrame([(1, "a", "")], "id long, text string, brand string")
    with pytest.raises(ValueError):
        candidates.scored(some.drop("brand"), some, 0.5)


def keyed(spark, seed):
    """Sets of 1 to 60 words, many of them alike, and the keys of both sides."""
    rng, share = random.Random(seed), candidates.words_needed(candidates.LEAST)
    sets = [{f"w{int(rng.paretovariate(0.7)) % 150}" for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 10, 16, 40, 60]))} for _ in range(60)]
    sets += [set(rng.sample(sorted(s), rng.randint(1, len(s)))) for s in sets]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, words array<string>")
    often = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    left, right = (candidates.rare_words(rows, often, share, side) for side in (True, False))
    met = left.withColumnRenamed("id", "q").join(right.withColumnRenamed("id", "c"), ["key", "class"]).select("q", "c").distinct()
    return sets, share, {tuple(r) for r in met.collect()}


def test_words_find_all_sets_alike(spark):
    sets, share, met = keyed(spark, 5)
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if len(x & y) >= share * len(x | y)}
    assert len(want) > 300 and want <= met


def test_one_frequent_word_brings_no_pairs_together(spark):
    rows = spark.createDataFrame([(i, ["bolt", f"a{i}", f"b{i}", f"c{i}"]) for i in range(40)], "id long, words array<string>")
    often = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    left, right = (candidates.rare_words(rows, often, candidates.words_needed(candidates.LEAST), side) for side in (True, False))
    assert left.withColumnRenamed("id", "q").join(right, ["key", "class"]).where("q <> id").count() == 0


def test_brands_that_no_line_names_make_no_pairs(spark, monkeypatch):
    items = [(f"I{i}", i, f"K{i}", f"M{i}", f"P{i}", "red steel valve", f"Brand#{i}", "ACTIVE") for i in range(30)]
    master = spark.createDataFrame(items, "internal_item_id string, master_pos long, internal_sku string, manufacturer_part_number string, supplier_part_number string, canonical_description string, brand string, status string")
    quoted = spark.createDataFrame([("Q1", 0, "none", "red steel valve brand#7")], "quote_id string, line_index int, part_number string, raw_description string")
    seen, scored = [], candidates.scored
    monkeypatch.setattr(candidates, "scored", lambda q, known, least: seen.append(known.count()) or scored(q, known, least))
    got = candidates.line_candidates(matching.exact_match(quoted, master), master).orderBy("place").collect()
    assert [r.internal_item_id for r in got] == ["I7", "I0", "I1", "I2", "I3"] and seen == [2]
