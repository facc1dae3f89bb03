import hashlib

import pytest

from bidloom.operators import accuracy, requirements
from bidloom.sources import files


def test_documents_and_cells(spark, tmp_path):
    data = {"a.csv": '﻿Item;Qty\r\n"two\nlines; one cell";3\r\n'.encode(), "b.txt": "caf\xe9\tx\ny".encode("latin-1"), "c.zip": b"PK", "d.csv": b""}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    found = files.with_doc_id(files.documents(spark, f"file://{tmp_path}")).cache()
    assert {r.name: r.reader for r in found.collect()} == {"a.csv": "csv", "b.txt": "csv", "c.zip": None}
    assert found.where("error IS NOT NULL").first().name == "c.zip"
    assert {r.doc_id for r in found.collect()} == {"Q-" + hashlib.sha256(x).hexdigest()[:8].upper() for x in data.values() if x}
    cells = files.csv_cells(found.where("reader = 'csv'").drop("doc_id").withColumnRenamed("name", "doc_id"))
    got = {(r.doc_id, r.row_no, r.col_no): r.value for r in cells.collect()}
    assert got == {("a.csv", 0, 0): "Item", ("a.csv", 0, 1): "Qty", ("a.csv", 1, 0): "two\nlines; one cell", ("a.csv", 1, 1): "3", ("b.txt", 0, 0): "café", ("b.txt", 0, 1): "x", ("b.txt", 1, 0): "y", ("b.txt", 1, 1): ""}


@pytest.mark.parametrize(("text", "sign"), [("a;b;c", ";"), ("a,b;c", ","), ("plain", ","), ("x\n\ta|b|c", "\t")])
def test_delimiter(text, sign):
    assert files.delimiter(text) == (sign if sign != "\t" else "|")


def test_records_keep_bad_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{oops\n')
    rows = files.records(spark, f"file://{tmp_path}", "a long").collect()
    assert {(r.a, r._bad) for r in rows} == {(1, None), (None, "{oops")}


def test_token_sets(spark):
    rows = [("steel pipe", "pipe steel long"), ("abc", "xyz"), ("", "a"), ("a b", "a c")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(accuracy.token_set_ratio(df.a, df.b)).collect()]
    assert got[:3] == [1.0, 0.0, 0.0] and got[3] == pytest.approx(2 / 3)


def test_quantities_and_units_are_never_made_up(spark):
    asked = spark.createDataFrame([("R", 1, "", "", "", "N/A", "-", ""), ("R", 2, "known", "", "pipe", "5", "kg", "")], "rfq_id string, pos int, sku string, internal_sku string, description string, qty string, uom string, internal_item_id string")
    items = spark.createDataFrame([("ITEM-1", "KNOWN")], "internal_item_id string, internal_sku string")
    rows = {r.pos: r for r in requirements.rfq_lines(asked, items).collect()}
    assert (rows[1].sku, rows[1].requested_quantity, rows[1].requested_uom, rows[1].is_new) == ("SKU-001", None, None, True)
    assert (rows[2].sku, rows[2].requested_uom, rows[2].is_new) == ("KNOWN", "KG", False)
