from datetime import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from bidloom.operators import exports, finance

SPLITS = "rfq_id string, rfq_line_id string, alloc_no int, split_no int, supplier_id string, quote_id string, qty decimal(18,4), split_value decimal(18,2)"
OFFERED = "rfq_id string, rfq_line_id string, supplier_id string, quote_id string, unit_cost decimal(18,4), quoted_qty decimal(18,4), is_l1_for_line boolean"


def splits(spark):
    checked = spark.createDataFrame([
        ("R", "L1", 1, 1, "7", "Q7", D(6), D("60.00")), ("R", "L1", 1, 2, "8", "8", D(4), D("48.00")), ("R", "L2", 2, 1, "7", "Q7", D(1), D("5.50")), ("R", "L2", 2, 2, None, None, None, None),
    ], SPLITS)
    offered = spark.createDataFrame([("R", "L1", "7", "Q7", D(10), D(9), True), ("R", "L1", "8", "8", D(12), None, False), ("R", "L2", "7", "Q7", D("5.5"), D(1), True)], OFFERED)
    suppliers = spark.createDataFrame([("7", "Seven"), ("9", "Nine")], "supplier_id string, supplier_name string")
    return exports.accepted(checked, offered, suppliers)


def lines(spark):
    return spark.createDataFrame([("R", "L1", "A", "bolt, long", "PCS"), ("R", "L2", None, None, None), ("R", "L3", "C", "nut", "KG")], "rfq_id string, rfq_line_id string, sku string, description string, requested_uom string")


def states(spark):
    return spark.createDataFrame(
        [("R", "L1", D(10), D(10), D("108.00"), "FULLY_ALLOCATED"), ("R", "L2", D(4), D(1), D("5.50"), "PARTIALLY_ALLOCATED"), ("R", "L3", D(2), D(0), D(0), "UNALLOCATED")],
        "rfq_id string, rfq_line_id string, required decimal(18,4), allocated decimal(18,4), value decimal(18,2), state string",
    )


def test_sheet_has_a_row_for_each_split_and_each_open_line(spark):
    rfqs = spark.createDataFrame([("R", None)], "rfq_id string, base_currency string")
    rows = exports.award_sheet(splits(spark), states(spark), lines(spark), rfqs).orderBy("rfq_line_id", "awarded_qty").collect()
    assert len(rows[0].asDict()) == 14  # thirteen, and the RFQ
    assert [(r.rfq_line_id, r.supplier_name, r.quote_id, r.awarded_qty, r.line_award_value, r.currency, r.l1_line_optimal) for r in rows] == [
        ("L1", "8", "8", D(4), D("48.00"), "INR", "NO"), ("L1", "Seven", "Q7", D(6), D("60.00"), "INR", "YES"), ("L2", "Seven", "Q7", D(1), D("5.50"), "INR", "YES"), ("L3", "UNALLOCATED", "N/A", D(0), D(0), "INR", "NO"),
    ]
    assert rows[2].item_sku == "" and rows[2].uom == "PCS"


def test_summary_of_an_award_and_of_none(spark):
    rfqs = spark.createDataFrame([("R", "Bridge", "USD"), ("S", "", None)], "rfq_id string, title string, base_currency string")
    awards = spark.createDataFrame([("R", "FINALIZED", datetime(2026, 1, 2), "Ann", "LINE_ITEM_OPTIMAL", "C-1")], "rfq_id string, status string, awarded_at timestamp, awarded_by string, scenario string, comparison_id string")
    many = states(spark).withColumn("value", F.col("value") * 1000)
    rows = exports.award_summary(rfqs, many, awards).orderBy("rfq_id", "row_no").collect()
    assert [r.label for r in rows] == [*exports.SUMMARY] * 2
    assert [r.value for r in rows[:13]] == ["R", "Bridge", "FINALIZED", "2026-01-02 00:00:00", "Ann", "USD", "USD 113,500.00", "3", "1", "1", "1", "LINE_ITEM_OPTIMAL", "C-1"]
    assert [r.value for r in rows[13:]] == ["S", "Procurement Project", "DRAFT", "Pending Finalization", "Procurement Specialist", "INR", "INR 0.00", "0", "0", "0", "0", "MANUAL_ALLOCATION", "N/A"]


def test_requisition_by_supplier_quote_or_name(spark):
    asked = spark.createDataFrame([("R", k) for k in ("7", "Q7", "Seven", "8", "8", "nobody")] + [("S", "7")], "rfq_id string, key string")
    rows = exports.requisition(splits(spark), asked, lines(spark)).collect()
    found = {k: sorted((r.rfq_line_id, r.line_value) for r in rows if r.key == k) for k in {r.key for r in rows}}
    both = [("L1", D("60.00")), ("L2", D("5.50"))]
    assert found == {"7": both, "Q7": both, "Seven": both, "8": [("L1", D("48.00"))]}
    assert {(r.key, r.total_value) for r in rows} == {("7", D("65.50")), ("Q7", D("65.50")), ("Seven", D("65.50")), ("8", D("48.00"))}


def test_requisition_files_keep_ids_as_texts(spark, tmp_path):
    rows = splits(spark)
    exports.write_requisitions(rows, f"file://{tmp_path}/out")
    assert {p.name for p in (tmp_path / "out").glob("supplier_id=*")} == {"supplier_id=7", "supplier_id=8"}
    back = spark.read.schema(rows.schema).parquet(f"file://{tmp_path}/out")
    assert sorted(back.select(*rows.columns).collect()) == sorted(rows.collect())


def test_comparisons_newest_first_with_defaults(spark):
    log = spark.createDataFrame([("C1", "R", None, datetime(2026, 1, 1)), ("C2", "S", "Second", datetime(2026, 1, 2)), ("C3", "R", None, datetime(2026, 1, 2))], "comparison_id string, rfq_id string, title string, created_at timestamp")
    ranked = spark.createDataFrame([("R", "7", 1, D(90)), ("R", "8", 2, D(95)), ("S", "8", 999, D(1))], "rfq_id string, supplier_id string, rank int, total_base decimal(18,2)")
    rfqs = spark.createDataFrame([("R", "USD")], "rfq_id string, base_currency string")
    suppliers = spark.createDataFrame([("7", "Seven")], "supplier_id string, supplier_name string")
    rows = exports.comparison_listing(log, ranked, rfqs, suppliers).collect()
    assert [tuple(r)[:3] + tuple(r)[4:] for r in rows] == [
        ("C3", "R", "Comparison for R", 2, "Seven", "90.00", "USD"), ("C2", "S", "Second", 1, "Split Optimal", "—", "INR"), ("C1", "R", "Comparison for R", 2, "Seven", "90.00", "USD"),
    ]


def test_most_recent_orders_ties_by_id_and_rows_without_time_last(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", None)], "id string, as_of int")
    found = exports.most_recent({"x": (rows, 3), "y": (rows.where("false"), 2), "z": (rows, 9)}).collect()
    assert [(r.what, r.place, r.id) for r in found] == [("x", 1, "c"), ("x", 2, "b"), ("x", 3, "a"), ("z", 1, "c"), ("z", 2, "b"), ("z", 3, "a"), ("z", 4, "d")]


def test_penalties_and_caps_explain_the_confidence(spark):
    issues = spark.createDataFrame([("A", None, "NO_LINE_ITEMS", "CRITICAL"), ("B", 3, "UNIT_PRICE_INVALID", "HIGH"), ("B", 4, "SHORT_DESCRIPTION", "MEDIUM"), ("C", None, "OTHER", "LOW")], "quote_id string, line_index int, code string, severity string")
    reconciled = spark.createDataFrame([("A", "CALCULATED_ONLY"), ("B", "DISCREPANCY"), ("C", "RECONCILED")], "quote_id string, status string")
    quotes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "quote_id string")
    scored = finance.confidence(issues, quotes, reconciled)
    rows = exports.confidence_reasons(issues, reconciled, scored).collect()
    caps = {r.quote_id: r.reason for r in rows if r.kind == "CAP"}
    assert caps == {"A": "at most 0.30 because of a critical issue", "B": "at most 0.55 because of a total that differs"}
    for r in scored.collect():
        cap = float(caps[r.quote_id].split()[2]) if r.quote_id in caps else 1.0
        lost = sum(x.penalty for x in rows if x.quote_id == r.quote_id)
        assert r.confidence == round(max(0.10, min(cap, 1 - lost)), 2)
    texts = {r.reason for r in rows}
    assert {"HIGH: items[3].unit_price: the price is not positive", "LOW: OTHER: OTHER", "CRITICAL: items: no line was found"} <= texts
