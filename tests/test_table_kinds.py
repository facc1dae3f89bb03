"""A table's rules are found once, and main tables are those that are read for items."""

from bidloom.operators import sheets

SLICED = "doc_id string, sheet int, sheet_name string, table_no bigint, row_no int, kind string, is_hidden boolean, cells array<string>, text string, score double"


def sliced(spark, tables):
    rows = []
    for doc, no, *lines in tables:
        for i, cells in enumerate(lines):
            rows.append((doc, 0, "Quotation", no, 100 * no + i, "ROW" if i else "HEADER", False, cells, "\t".join(cells), 0.9))
    return spark.createDataFrame(rows, SLICED)


TABLES = [
    ("a", 1, ["Min Qty", "Max Qty", "Unit Price"], ["1", "20", "5"]),
    ("a", 2, ["Part No", "Description", "Qty", "Unit Price"], ["P-1", "Bolt", "3", "9"]),
    ("a", 3, ["Description", "Qty", "Unit Price"], ["Nut", "3", "9"]),
    ("b", 1, ["Min Qty", "Max Qty", "Unit Price"], ["1", "20", "5"]),
]


def test_main_tables_are_read_for_items(spark):
    found = sheets.main_tables(sheets.table_kinds(sliced(spark, TABLES)))
    assert [(r.doc_id, r.table_no, r.table_kind, r.confidence) for r in found.collect()] == [("a", 2, "MAIN_LINE_ITEMS", 0.95)]


def test_rules_stand_in_the_plan_once(spark):
    plan = sheets.main_tables(sheets.table_kinds(sliced(spark, TABLES)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("HISTORICAL_REFERENCE") <= 2  # the rule that gives it, and the one that routes it
