import datetime
from decimal import Decimal

import pytest

from bidloom.operators import accuracy, sheets
from bidloom.plans import cells as cell_plans
from bidloom.plans.commercial import Tables
from bidloom.sources import files


def test_a_hidden_price_column_changes_the_roles(spark, tmp_path):
    sheet = [["Sr", "Description", "Qty", "UOM", "Cost Price", "Unit Price"], ["1", "Copper cable", "10", "mtr", "90", "120"], ["2", "Ball bearing", "5", "Nos", "40", "55"], ["", "internal", "0", "", "0", "0"]]
    rows = [("d", 0, "Quotation", r, c, None if v == "" else v, f"={c}*2" if c == 5 and r else v, r == 3, c == 4) for r, row in enumerate(sheet) for c, v in enumerate(row)]
    spark.createDataFrame(rows, "doc_id string, sheet int, sheet_name string, row_no int, col_no int, value string, formula string, is_hidden_row boolean, is_hidden_col boolean").write.parquet(str(tmp_path / "c"))
    cells = files.read_cells(spark, str(tmp_path / "c"))
    assert sheets.cell_profile(cells).collect() == [("d", 0, 22, 3, 1, 1)]

    def roles(policy):
        sliced = sheets.slices(sheets.rows_of_cells(cells, policy)).cache()
        main = sliced.join(sheets.main_tables(sheets.table_kinds(sliced)).select(*sheets.TABLE), sheets.TABLE)
        return {r.role: r.col_no for r in sheets.column_roles(sheets.column_stats(main)).collect()}

    assert roles("FLAG_REVIEW") == roles("SMART_INCLUDE")
    assert roles("SMART_INCLUDE")["unit_price"] == 4
    assert roles("EXCLUDE_ALL")["unit_price"] == 5
    assert {r.row_no for r in sheets.rows_of_cells(cells, "EXCLUDE_ALL").collect()} == {0, 1, 2}
    assert {r.row_no: r.is_hidden for r in sheets.rows_of_cells(cells).collect()} == {0: False, 1: False, 2: False, 3: True}


def test_a_bare_cell_table_has_defaults(spark, tmp_path):
    spark.createDataFrame([("d", 0, 0, " a "), ("d", 0, 2, None)], "doc_id string, row_no int, col_no int, value string").write.parquet(str(tmp_path / "c"))
    cells = files.read_cells(spark, str(tmp_path / "c"))
    assert {(r.value, r.has_formula, r.is_hidden_row, r.is_hidden_col, r.sheet) for r in cells.collect()} == {("a", False, False, False, 0), ("", False, False, False, 0)}
    assert sheets.rows_of_cells(cells, "EXCLUDE_ALL").first().cells == ["a"]


HEAD = "doc_id string, supplier string, quote_number string, quote_date date, landed decimal(18,2)"
LINE = "doc_id string, line_index int, raw_description string, quoted_qty decimal(18,4), quoted_uom string, unit_price decimal(18,4), tax_rate_pct decimal(9,4)"


def test_field_report(spark):
    day = datetime.date(2026, 3, 5)
    true = spark.createDataFrame([("a", "Acme Tools India", "Q1", day, Decimal(200)), ("b", "Orient", None, None, Decimal(0)), ("c", "Gone", "Q3", day, Decimal(50)), ("e", "Empty", "", day, Decimal(10))], HEAD)
    found = spark.createDataFrame([("a", "acme tools", "Q-1", day, Decimal(150)), ("b", "Someone", "X", day, Decimal(9)), ("e", "Empty", "Q9", None, Decimal(11)), ("z", "Unasked", None, None, None)], HEAD)
    one = Decimal(1)
    true_lines = spark.createDataFrame([("a", 0, "bolt m8", one, "PCS", one, None), ("a", 1, "nut", one, "PCS", one, one), ("b", 5, "rod", one, "KG", one, one), ("c", 0, "x", one, "KG", one, one)], LINE)
    found_lines = spark.createDataFrame([("a", 0, "M8 BOLT zinc", one, "PCS", None, None), ("b", 9, None, one, "kg", one, one), ("b", 10, "rod", one, "KG", one, one), ("e", 0, "y", one, "KG", one, one)], LINE)
    got = {r.doc_id: [float(x) for x in r[1:]] for r in accuracy.field_report(found, true, found_lines, true_lines).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    assert got["a"] == pytest.approx([100, 0, 100, 50, 50, 50, 50, 0, 50, 75, 52.5])
    assert got["b"] == pytest.approx([0, 100, 100, 0, 0, 100, 0, 100, 100, 100, 60])
    assert got["c"] == pytest.approx([0] * 11)
    assert got["e"] == pytest.approx([100, 100, 0, 0, 0, 0, 0, 0, 0, 100, 30])


def test_cells_of_sheets_are_dealt_once(spark):
    made = cell_plans.cells(Tables(spark, "/root/testdata/sf0.001"))
    for df in (sheets.cell_profile(made), sheets.rows_of_cells(made, "EXCLUDE_ALL")):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
