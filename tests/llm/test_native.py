"""Edge cases of the operators whose results DuckDB checks: mixing, quality rules, spot signatures."""

import random
import duckdb
import pytest
from pyspark.sql import functions as F

from bidloom.llm import mixing, quality_rules, spotsigs

PROSE = " ".join(f"the word{i} of a text{i} and more{i * 7}" for i in range(60))
ROWS = [(1, None, "s"), (2, "", None), (3, " \n\t", "s"), (4, PROSE, "s"), (4, PROSE, "s"), (5, PROSE + " the end", None), (6, "a b c " * 100, "t"), (7, "line one is here\n" * 40, "t"), (8, "### $$$ %%% " * 60, "t"), (None, PROSE.upper(), "u"), (9, "z " * 20000, "u"), (10, "日本語 テキスト", "v")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


def sql(query, rows=ROWS):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return con.execute(query).df()


def test_quality_rules(spark, docs):
    distinct = list({r[0]: r for r in ROWS if r[0] is not None}.values())
    want = sql(quality_rules.ORACLE, distinct).set_index("doc_id")
    got = {r.doc_id: r for r in quality_rules.cascade(docs.withColumn("kept", F.lit("clash"))).collect()}
    assert {d: got[d].kept for d in want.index} == want.kept.to_dict()
    assert got[1].failed_rule == "few_words" and got[6].failed_rule == "repeated_words" and got[4].failed_rule is None
    order = quality_rules.ordered(docs, quality_rules.RULES)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality_rules.RULES)
    again = {r.doc_id: r.kept for r in quality_rules.cascade(docs, order[::-1]).collect()}
    assert again == {d: r.kept for d, r in got.items()}
    stats = docs.where("doc_id = 6").select(quality_rules.n_repeat_words(F.col("text")), quality_rules.n_words(F.col("text"))).first()
    assert tuple(stats) == (300, 300)
    assert quality_rules.kept(docs.limit(0)).count() == 0 and quality_rules.kept(docs).columns == docs.columns


def test_mixing(spark, docs):
    got = mixing.mix(mixing.sized(docs.withColumn("size", F.lit("clash")))).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in got)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(total)
    for rows in by.values():
        taken, target = sum(r.taken for r in rows), rows[0].target
        assert taken <= target + 1e-3 and target <= 3 * rows[0].source_size + 1e-6 and all(r.taken % max(r["size"], 1) == 0 for r in rows)
    again = mixing.mix(mixing.sized(docs.repartition(3))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(mixing.sized(docs.limit(0))).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.taken // r["size"] for r in got if r["size"])


def test_targets_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 400)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["b"] == 30 and got["c"] == 30 and got["a"] == pytest.approx(got[None]) and sum(got.values()) == pytest.approx(1420)


def test_spot_signatures(spark, docs):
    ordered = spotsigs.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()
    by = {}
    for r in ordered:
        by.setdefault(r.text, set()).add(tuple(r.set))
    assert len(ordered) == len(ROWS) and all(len(s) == 1 for s in by.values()) and by[""] == {()}
    nexts = {(r.doc_id, r.text): r.next_text for r in ordered}
    assert nexts[1, ""] == "" and nexts[None, PROSE.upper()] == "" and nexts[10, "日本語 テキスト"] == PROSE.upper()
    assert spotsigs.with_next(docs.limit(0)).count() == 0
    one = spotsigs.with_next(docs.where("doc_id = 10").select("doc_id", "text")).first()
    assert one.next_text == one.text


def test_near_pairs(spark):
    import random

    rng = random.Random(3)
    base = [f"s{i}" for i in range(60)]
    sets = {i: sorted({rng.choice(base) if rng.random() < 0.9 else f"o{rng.randrange(99)}" for _ in range(rng.randrange(0, 40))}) for i in range(60)}
    sets |= {100 + i: sorted(set(base) - {base[i]}) for i in range(8)} | {200: sorted(base), 201: sorted(base), 202: [], 203: []}
    rows = spark.createDataFrame(list(sets.items()), "id long, set array<string>")
    members, pairs = spotsigs.near_pairs(rows, 0.8)
    cls = {r.id: r["class"] for r in members.collect()}
    assert len(cls) == len(sets) and cls[201] == 200 and cls[202] == 202
    want = {(a, b) for a in set(cls.values()) for b in set(cls.values()) if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def test_sources_without_rest(spark):
    """A source whose budget is used up takes no part, so its equal ranks are not ordered in one window."""
    rows = spark.createDataFrame([(1, 0, 7, 0, 0.5), (2, 1, 8, 5, 0.5), (3, 1, 9, 5, 0.7)], "row long, k long, doc_id long, size long, rank double")
    budgets = spark.createDataFrame([(0, 0.0), (1, 5.0)], "k long, left double")
    assert [r.row for r in mixing.prefixes(rows, budgets).collect()] == [2]


def test_bounds_are_found_in_blocks(spark):
    values = spark.range(1010)
    for n in (1, 2, 3, 7, 16, 17, 101):
        bounds = sorted(random.Random(n).sample(range(0, 1000, 3), n))
        got = [r[0] for r in values.select(spotsigs.within(F.col("id"), bounds)).collect()]
        assert got == [sum(b <= i for b in bounds) for i in range(1010)]


def test_sample_of_rules_keeps_the_tasks_of_the_scan(spark):
    docs = spark.range(6400).selectExpr("cast(id as string) AS text").repartition(64)
    plan = docs.select("text").sample(0.1, 5).repartition(8)._jdf.queryExecution().toString()
    assert "Coalesce" not in plan
    assert quality_rules.ordered(docs, quality_rules.RULES)
