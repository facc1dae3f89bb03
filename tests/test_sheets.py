import datetime
import re
from decimal import Decimal

from pyspark.sql import functions as F

from bidloom.functions import text as t
from bidloom.functions import vocabulary as v
from bidloom.operators import fields, sheets
from bidloom.plans import sheets as plans
from bidloom.sources.domain import table

SCHEMA = "doc_id string, sheet int, sheet_name string, row_no int, is_hidden boolean, cells array<string>"


def made(spark, rows, doc="d", sheet=0, name="Quotation"):
    return spark.createDataFrame([(doc, sheet, name, i, hidden, cells) for i, (hidden, cells) in enumerate(rows)], SCHEMA)


QUOTE = [
    (False, ["Supplier: Acme Tools", "", "Quote No: QT/7"]),
    (False, ["Date: 05/03/2026", "Validity:", "30-06-2026"]),
    (False, ["", "", ""]),
    (False, ["Sr", "Part No", "Description", "Qty", "UOM", "Unit Price", "CGST %", "SGST %", ""]),
    (False, ["1", "A-1", "Copper cable 4 sq", "10", "mtr", "₹1,250.50", "9", "9"]),
    (False, ["", "", "with drum", "", ""]),
    (True, ["", "X", "internal costing markup", "0", "", "0"]),
    (False, ["2", "", "BRG-6205 ball bearing", "", "Nos", "on request", "9", "9"]),
    (False, ["", "", "Sub Total", "12,505.00"]),
    (False, ["Grand Total:", "₹14,755.90"]),
    (False, ["Freight", "500", "18"]),
    (False, ["", ""]),
    (False, ["", ""]),
    (False, ["SKU", "Min Qty", "Max Qty", "Unit Price"]),
    (False, ["A-1", "1", "20", "1250.5"]),
    (False, ["A-1", "21", "", "1200"]),
    (False, ["A-1", "21", "", "1200"]),
]


def test_a_whole_quotation(spark):
    rows = made(spark, QUOTE)
    sliced = sheets.slices(rows).cache()
    kinds = sheets.table_kinds(sliced)
    assert {(r.table_no, r.table_kind) for r in kinds.collect()} == {(1, "MAIN_LINE_ITEMS"), (2, "VOLUME_PRICING")}
    main = sliced.join(sheets.main_tables(kinds).select(*sheets.TABLE), sheets.TABLE)
    roles = sheets.column_roles(sheets.column_stats(main))
    assert {r.role: r.col_no for r in roles.collect()} == {"part_number": 1, "description": 2, "qty": 3, "uom": 4, "unit_price": 5, "cgst": 6, "sgst": 7}
    kinded = sheets.row_kinds(main, roles)
    assert {r.row_no: r.row_kind for r in kinded.collect()} == {4: "ITEM", 5: "CONTINUATION", 6: "NOTE", 7: "CONTINUATION"}
    items = fields.line_items(kinded)
    (item,) = items.collect()
    assert (item.raw_description, item.part_number, item.quoted_qty, item.quoted_uom, item.unit_price, item.tax_rate_pct) == ("Copper cable 4 sq\nwith drum\nBRG-6205 ball bearing", "A-1", Decimal(10), "MTR", Decimal("1250.5"), Decimal(18))
    docs, blocks = rows.select("doc_id").distinct(), sliced.where("kind IN ('META', 'TEXT')").select("doc_id", "sheet", "row_no", "cells")
    pairs = fields.key_values(blocks, main.where("kind = 'ROW'"))
    assert fields.supplier(docs, blocks, pairs, kinded).first().supplier == "Acme Tools"
    assert fields.quote_number(docs, blocks, pairs, kinded).first().quote_number == "QT/7"
    when = fields.dates(docs, blocks, pairs, kinded).first()
    assert (when.quote_date, when.valid_until) == (datetime.date(2026, 3, 5), datetime.date(2026, 6, 30))
    assert fields.currency(docs, rows, kinded).first().currency == "INR"
    assert fields.stated_total(docs, blocks, kinded).first().stated_total == Decimal("14755.90")
    assert [(r.charge_type, r.amount, r.tax_rate_pct) for r in fields.text_charges(blocks).collect()] == [("FREIGHT", Decimal(500), Decimal(18))]
    tiers = {(r.line_index, r.min_qty, r.max_qty, r.unit_price) for r in fields.tiers(sliced, kinds, blocks, items).collect()}
    assert tiers == {(0, Decimal(1), Decimal(20), Decimal("1250.5")), (0, Decimal(21), None, Decimal(1200))}


def test_rows_without_anything(spark):
    empty = made(spark, [])
    assert sheets.slices(empty).count() == 0 and sheets.regions(empty).count() == 0
    blank = made(spark, [(False, ["", ""]), (False, [])])
    assert sheets.slices(blank).count() == 0
    assert [r.cells for r in sheets.assemble_rows(sheets.cells_of(made(spark, [(False, ["a", "", "b", ""])]))).collect()] == [["a", "", "b"]]


def test_merges(spark):
    cells = sheets.cells_of(made(spark, [(False, ["top", ""]), (False, ["", "own"])]))
    merges = spark.createDataFrame([("d", 0, 0, 1, 0, 1)], "doc_id string, sheet int, min_row int, max_row int, min_col int, max_col int")
    got = {(r.row_no, r.col_no): r.value for r in sheets.fill_merges(cells, merges).collect()}
    assert got == {(0, 0): "top", (0, 1): "top", (1, 0): "top", (1, 1): "own"}


def test_value_ends_at_a_label(spark):
    rows = spark.createDataFrame([("Acme Tools Date: 1",), ("Date of offer ref no 7",), ("plain",), ("",)], "x string")
    assert [r[0] for r in rows.select(fields.clean_value(F.col("x"))).collect()] == ["Acme Tools", "Date of offer", "plain", ""]


def test_merges_of_rows(spark):
    rows = made(spark, [(False, ["top", "", "x"]), (False, ["", "own", ""]), (False, ["", ""])]).union(made(spark, [(False, ["", "b"])], doc="e")).union(made(spark, [(False, ["", ""])], sheet=1))
    merges = spark.createDataFrame([("d", 0, 0, 1, 0, 1), ("d", 0, 1, 2, 1, 2), ("d", 0, 0, 2, 9, 9), ("d", 0, 7, 8, 0, 1), ("e", 0, 0, 0, 0, 1)], "doc_id string, sheet int, min_row int, max_row int, min_col int, max_col int")
    key = lambda r: (r.doc_id, r.sheet, r.row_no, r.col_no, r.value, r.is_merged)
    want = sorted(map(key, sheets.fill_merges(sheets.cells_of(rows), merges).collect()))
    assert sorted(map(key, sheets.fill_merged_rows(rows, merges).collect())) == want
    assert len(want) == 12 and ("d", 0, 1, 2, "own", True) in want and ("d", 0, 0, 1, "top", True) in want


def test_the_query_gives_every_cell():
    assert "sha256" not in plans.ORACLE["fill_merges"]


def test_sheets_are_dealt_once(spark):
    rows = plans.written(spark, "/root/testdata/sf0.001")
    plan = sheets.slices(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    of_view = table(spark, "/root/testdata/sf0.001", "sheet_rows")
    assert rows.exceptAll(of_view).isEmpty() and of_view.exceptAll(rows).isEmpty()


def test_white_space_and_numbers(spark):
    got = spark.createDataFrame([(" \u00a0 a b\u2003\n",), ("₹ 1,250.5",), ("12 kg",), ("%",), ("",), (None,), ("-3.",)], "x string").select(t.strip(F.col("x")), t.is_numeric(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("a b", False), ("₹ 1,250.5", True), ("12 kg", False), ("%", False), ("", False), (None, None), ("-3.", False)]


def test_words_anywhere_find_the_same():
    words = [re.sub(r"\\s\*|\(\?:\w+\)\?|\\|\?", "", w) for w in sum(v.HEADERS.values(), []) + sum(v.ANYWHERE.values(), [])]
    for a in words:
        for text in (a, f"x{a}", f"{a}s", f"9 {a} no", f"part {a}"):
            assert all(bool(re.search(v.lenient(r), text)) == bool(re.search(v.anywhere(r), text)) for r in v.HEADERS), text


def test_signs_leave_out_no_header(spark):
    words = [re.sub(r"\\s\*|\(\?:\w+\)\?|\\|\?", "", w) for w in sum(v.HEADERS.values(), []) + sum(v.ANYWHERE.values(), [])]
    texts = spark.createDataFrame([(x,) for a in words for x in (a, f"x{a}", f"{a}s", f"9 {a} no")], "x string")
    roles = list(v.HEADERS)
    got = texts.select("x", F.array(*(v.says(F.col("x"), r) for r in roles)).alias("says"), F.array(*(v.may_say(F.col("x"), r) for r in roles)).alias("may")).collect()
    for row in got:
        want = [bool(re.search(v.lenient(r), row.x)) for r in roles]
        assert row.says == want and all(m for m, w in zip(row.may, want) if w), row.x
    assert all(any(s in w for s in v.TIER_SIGNS) for w in v.TIER_WORDS)


def test_rows_are_sorted_once_for_all_windows(spark):
    rows = made(spark, [(False, ["Description", "Qty", "Rate"]), (False, ["a", "1", "2"]), (False, ["Bank details"]), (False, ["b", "1", "2"]), (False, ["Min Qty", "Max Qty", "Price"]), (False, ["1", "2", "3"]), (False, ["", ""]), (False, [""]), (False, ["4", "5", "6"])])
    out = sheets.slices(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    got = [(r.row_no, r.table_no, r.kind) for r in out.orderBy("row_no").collect()]
    assert got == [(0, 1, "HEADER"), (1, 1, "ROW"), (2, 1, "TEXT"), (3, 1, "TEXT"), (4, 2, "HEADER"), (5, 2, "ROW"), (8, 2, "TEXT")]


def test_slices_are_kept_without_their_text(spark):
    sliced = sheets.slices(made(spark, QUOTE))
    kept = plans.Sheets._kept(sliced, "slices")
    assert "text" not in spark.read.parquet(*kept.inputFiles()).columns
    assert sorted((r.row_no, r.text) for r in kept.collect()) == sorted((r.row_no, r.text) for r in sliced.collect())
