"""Line states, decisions, corrections as keyed streams, the review queue and stale comparisons on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from bidloom.operators import decided, lifecycle, uom
from bidloom.streaming import facts

LINES = "quote_id string, line_index int, rfq_id string, supplier_id string, quoted_uom string, item string, method string, score double, best_item string, second_score double, uom_ok boolean, state string, reasons array<string>, is_locked boolean, decided string"
DECISIONS = "quote_id string, line_index int, ts int, id long, action string, chosen_sku string"


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([("PCS", "COUNT", 1.0), ("NOS", "COUNT", 1.0), ("KG", "WEIGHT", 1.0), ("BOX", "PACKAGING", None)], "unit string, dimension string, rate double").withColumn("rate", F.col("rate").cast("decimal(18,6)"))


@pytest.fixture(scope="module")
def items(spark):
    rows = [("I1", "SKU-1", "PCS", 1), ("I2", "sku-1 ", "KG", 2), ("I3", "SKU-3", "KG", 3), ("I4", "SKU-4", "BOX", 4)]
    return spark.createDataFrame(rows, "internal_item_id string, internal_sku string, stocking_uom string, master_pos int")


def state(line, item="I1", method="SUPPLIER_SKU_EXACT", score=1.0, best=None, second=None, status="EXACT_MATCH", rfq="R1"):
    return ("Q1", line, rfq, "S", "NOS", item, method, score, best or item, second, True, status, [], False, None)


def fold(decisions, known):
    """Each line's decisions one after the other: what the last that has an effect leaves."""
    out = {}
    for q, i, ts, n, action, sku in sorted(decisions, key=lambda d: (d[2], d[3])):
        if action in decided.ACCEPTS:
            item = next((x for x in known if x[1].strip().upper() == (sku or "").strip().upper()), None)
            if item:
                out[q, i] = ("EXACT_MATCH" if item[2] in ("NOS", "PCS") else "UOM_INCOMPATIBLE", item[0])
        else:
            out[q, i] = ("UNMATCHED" if action in decided.REJECTS else "REVIEW_REQUIRED", None)
    return out


def some_decisions(seed):
    rng = random.Random(seed)
    actions = [*decided.ACCEPTS, *decided.REJECTS, *decided.REOPENS]
    return [("Q1", rng.randrange(6), rng.randrange(9), n, rng.choice(actions), rng.choice(["sku-1", " SKU-3", "SKU-4", "none", None])) for n in range(40)]


def test_decisions_hold_against_matching(spark, items, units):
    known = [tuple(r) for r in items.orderBy("master_pos").collect()]
    lines = spark.createDataFrame([state(i) for i in range(8)], LINES)
    decisions = some_decisions(4)
    want = fold(decisions, known)
    df = spark.createDataFrame(decisions, DECISIONS)
    rows = {(r.quote_id, r.line_index): r for r in decided.lock(lines, decided.latest(decided.effective(df, items)), units).collect()}
    assert {k: (r.state, r["item"]) for k, r in rows.items() if r.is_locked} == want
    assert all(r.state == "EXACT_MATCH" and r["item"] == "I1" for k, r in rows.items() if k not in want)
    assert decided.lock(lines, decided.latest(decided.effective(df.limit(0), items)), units).where("is_locked").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_decisions_gives_what_the_batch_gives(spark, items, units, tmp_path, seed):
    decisions = some_decisions(seed)
    random.Random(seed).shuffle(decisions)
    source = tmp_path / "in"
    # Facts come late, out of order and again, in several micro-batches.
    for part in (decisions[:15], decisions[15:], decisions[10:20]):
        spark.createDataFrame(part, DECISIONS).coalesce(1).write.mode("append").parquet(str(source))
        stream = decided.effective(spark.readStream.schema(DECISIONS).parquet(str(source)), items)
        facts.keep_latest(stream, lifecycle.LINE, ["action", "chosen"], ["ts", "id"], str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    kept = facts.latest(spark, str(tmp_path / "state"), lifecycle.LINE).select(*lifecycle.LINE, "action", "chosen")
    batch = decided.latest(decided.effective(spark.createDataFrame(decisions, DECISIONS), items))
    assert sorted(map(str, kept.collect())) == sorted(map(str, batch.collect()))


def test_stream_of_corrections_gives_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(5)
    schema = "quote_id string, line_index int, corrected_at int, id long, field_name string, corrected_value string"
    rows = [("Q1", rng.randrange(4), rng.randrange(6), n, rng.choice(["qty", "uom", "note", "price"]), rng.choice(["7", "2.5", "many", None, "KG"])) for n in range(60)]
    lines = spark.createDataFrame([("Q1", i, 1.5, "PCS", 3) for i in range(3)], "quote_id string, line_index int, price double, uom string, qty int")
    got = {r.line_index: r for r in lifecycle.apply_corrections(lines, spark.createDataFrame(rows, schema)).collect()}
    for i in range(3):
        want, n = {"price": 1.5, "uom": "PCS", "qty": 3}, 0
        for field, cast in (("price", float), ("uom", str), ("qty", int)):
            mine = sorted((r[2], r[3], r[5]) for r in rows if r[1] == i and r[4] == field)
            if mine:
                value = mine[-1][2]
                try:
                    want[field] = None if value is None else cast(value)
                    n += 1
                except ValueError:
                    pass
        assert (got[i].price, got[i].uom, got[i].qty, got[i].n_corrected) == (want["price"], want["uom"], want["qty"], n)
    assert set(got) == {0, 1, 2}
    source = tmp_path / "in"
    for part in (rows[40:], rows[:25], rows[20:45]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        facts.keep_latest(spark.readStream.schema(schema).parquet(str(source)), [*lifecycle.LINE, "field_name"], ["corrected_value"], ["corrected_at", "id"], str(tmp_path / "s"), str(tmp_path / "ck")).awaitTermination()
    again = lifecycle.apply_corrections(lines, facts.latest(spark, str(tmp_path / "s"), [*lifecycle.LINE, "field_name"]))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))


def test_queue_and_acceptance_once(spark, items, tmp_path):
    lines = spark.createDataFrame([
        state(0), state(1, None, "NO_MATCH", 0.95, "I3", 0.5, "UNMATCHED"), state(2, "I3", "DESCRIPTION", 0.9, "I3", 0.85, "REVIEW_REQUIRED"), state(3, "I3", "DESCRIPTION", 0.75, "I3", None, "REVIEW_REQUIRED"),
        state(4, None, "NO_MATCH", None, None, None, "UNMATCHED"), (*state(5, "I4", status="UOM_INCOMPATIBLE")[:10], False, "UOM_INCOMPATIBLE", [], False, None),
    ], LINES)
    queue = decided.review_queue(lines)
    assert {r.line_index: (r.category, r.is_safe) for r in queue.collect()} == {1: ("UNMATCHED", True), 2: ("CLOSE_CANDIDATES", False), 3: ("AMBIGUOUS", False), 4: ("UNMATCHED", False), 5: ("UOM_CONFLICT", False)}
    counts = decided.queue_counts(lines, queue).collect()
    assert tuple(counts[0]) == ("R1", 1, 6, 1, 3, 2, 5, 1)
    log = str(tmp_path / "log")
    assert [decided.append_once(log, decided.acceptances(queue, items, F.lit(7))) for _ in range(2)] == [1, 0]
    assert [(r.line_index, r.action, r.chosen_sku) for r in spark.read.parquet(log).collect()] == [(1, "ACCEPT", "SKU-3")]


def test_one_changed_match_marks_one_rfq(spark):
    rows = [state(i, rfq=f"R{i % 3}") for i in range(9)]
    before = spark.createDataFrame(rows, LINES)
    columns = ["quote_id", "line_index", "item", "method", "state"]
    prints = decided.fingerprints(before, columns)
    kept = prints.select("rfq_id", F.concat(F.lit("C-"), "rfq_id").alias("comparison_id"), "fingerprint").union(spark.createDataFrame([("R9", "C-R9", None)], "a string, b string, c string"))
    shuffled = spark.createDataFrame(rows[::-1], LINES).repartition(3)
    assert decided.stale(kept, decided.fingerprints(shuffled, columns)).where("is_stale").count() == 0
    changed = spark.createDataFrame([state(i, "I3" if i == 4 else "I1", rfq=f"R{i % 3}") for i in range(9)], LINES)
    flags = decided.stale(kept, decided.fingerprints(changed, columns))
    assert [r.rfq_id for r in flags.where("is_stale").collect()] == ["R1"]
    count = lambda df: df.groupBy("rfq_id").agg(F.count_if(F.col("item") == "I3").alias("n"))
    seen = []
    out = decided.refreshed(count(before), flags, changed, lambda df: seen.append(df) or count(df))
    assert {r.rfq_id: r.n for r in out.collect()} == {"R0": 0, "R1": 1, "R2": 0}
    assert {r.rfq_id for r in seen[0].select("rfq_id").collect()} == {"R1"}


def test_coverage_counts_extra_and_missing_lines(spark):
    asked = spark.createDataFrame([("R1", f"L{i}", f"I{i}") for i in range(1, 4)], "rfq_id string, rfq_line_id string, internal_item_id string")
    lines = [state(0, "I1"), state(1, "I1"), state(2, "I9"), ("Q2", *state(0, "I3", "DESCRIPTION", 0.75, "I3", None, "REVIEW_REQUIRED")[1:]), ("Q3", *state(0, "I9")[1:])]
    quotes = spark.createDataFrame([(f"Q{i}", "R1") for i in range(1, 5)], "quote_id string, rfq_id string")
    got = {r.quote_id: r for r in decided.coverage(spark.createDataFrame(lines, LINES), asked, quotes).collect()}
    assert (got["Q1"].n_lines, got["Q1"].n_matched, got["Q1"].n_extra, got["Q1"].n_missing, got["Q1"].coverage_state) == (3, 1, 1, 2, "PARTIAL")
    assert (got["Q2"].n_review, got["Q2"].status) == (1, "REVIEW_NEEDED")
    assert [got[q].status for q in ("Q3", "Q4")] == ["NO_MATCHED_ITEMS", "RECEIVED"]
    rfqs = spark.createDataFrame([("R1", "open"), ("R2", "draft"), ("R3", None), ("R4", "cancelled")], "rfq_id string, status string")
    none = spark.createDataFrame([], "rfq_id string, status string")
    stages = {r.rfq_id: r.stage for r in decided.display_stage(rfqs, decided.coverage(spark.createDataFrame(lines, LINES), asked, quotes), none, none).collect()}
    assert stages == {"R1": "MATCHING_REVIEW", "R2": "DRAFT", "R3": "OPEN", "R4": "CANCELLED"}


def test_factors_of_an_rfq_line_come_before_those_of_its_item(spark, units):
    rows = spark.createDataFrame([(1, "BOX", "PCS", {"BOX": 10.0}, {"BOX": 12.0}), (2, "box ", "PCS", {"BOX": 10.0}, None), (3, "BOX", "PCS", None, {"KG": 2.0}), (4, "NOS", "PCS", {"NOS": 5.0}, None), (5, "PCS", "PCS", {"PCS": 5.0}, {"PCS": 6.0})],
                                 "n int, source string, target string, item map<string,double>, rfq map<string,double>")
    kind = "map<string,decimal(18,6)>"
    rows = rows.withColumns({"item": F.col("item").cast(kind), "rfq": F.col("rfq").cast(kind)})
    got = {r.n: (r.uom_factor, r.uom_method) for r in uom.with_factor(rows, units, "source", "target", "item", "rfq").collect()}
    assert {n: (f and float(f), m) for n, (f, m) in got.items()} == {1: (12.0, "ITEM_MASTER_FACTOR"), 2: (10.0, "ITEM_MASTER_FACTOR"), 3: (None, "INCOMPATIBLE"), 4: (5.0, "ITEM_MASTER_FACTOR"), 5: (1.0, "EXACT_UOM_MATCH")}


def test_coverage_sends_no_table_through_the_driver(spark):
    lines = spark.createDataFrame([("R", "L1", "I1"), ("R", "L2", "I2")], "rfq_id string, rfq_line_id string, internal_item_id string")
    states = spark.createDataFrame([("Q", 0, "R", "EXACT_MATCH", "I1", "I1"), ("Q", 1, "R", "REVIEW_REQUIRED", None, "I2")], "quote_id string, line_index int, rfq_id string, state string, item string, best_item string")
    found = decided.coverage(states, lines, states.select("quote_id", "rfq_id").distinct())
    assert [(r.n_lines, r.n_matched, r.n_review, r.coverage_pct) for r in found.collect()] == [(2, 1, 1, 50.0)]
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
