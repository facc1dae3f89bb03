"""Queries over quotation sheets and their DuckDB SQL. A sheet is written from each order: its header fields, its line items
with continuations and hidden helper rows, totals, charges, terms, tiers, and for some a sheet of old prices."""

from __future__ import annotations

import re
import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions import vocabulary as v
from bidloom.operators import sheets
from bidloom.sources.domain import VIEWS, sql, table, uses
from bidloom.sources.stage import kept_dealt

QUERIES, ORACLE = {}, {}

DAY = "(1 + k % 28)"
#: The steps that some rows are written for.
TIER_STEPS = [{"step": "1", "low": "'1'", "high": "'20'"}, {"step": "2", "low": "'21'", "high": "'40'"}, {"step": "3", "low": "'41'", "high": "''"}]
CHARGE_STEPS = [{"step": "1", "name": "'Freight by road'", "amount": "'250'", "tax": "'18'"}, {"step": "2", "name": "'Packing'", "amount": "'75'", "tax": "''"}, {"step": "3", "name": "'Freight again'", "amount": "'250'", "tax": "'5'"}, {"step": "4", "name": "'Insurance'", "amount": "''", "tax": "''"}]
#: What a sheet is written from: whether orders or their lines, sheet, row, whether it is hidden, cells, condition, steps.
PARTS = [
    ("heads", 0, "0", "false", "CASE k % 5 WHEN 0 THEN array('Supplier: Acme Tools ' || k % 90 || ' Date', '', 'Quote No: QT/' || k) WHEN 1 THEN array('Vendor Name:', 'Bharat Steel ' || k % 70, 'Ref No:', 'R-' || k) WHEN 2 THEN array('Orient Cables Industries', 'Quotation ref # OC' || k, '') WHEN 3 THEN array('QUOTATION', '', '') ELSE array('Quoted by', 'North Star ' || k % 40 || ' Traders') END", "", None),
    ("heads", 0, "1", "false", f"CASE WHEN k % 7 < 3 THEN array('Date: {DAY}/03/2026', 'Validity: 30-06-2026', 'GSTIN: 27AAA') WHEN k % 7 < 5 THEN array('Quote date', '2026-03-1' || k % 9, 'Currency', CASE k % 3 WHEN 0 THEN 'USD' WHEN 1 THEN '€' ELSE 'INR' END) ELSE array('Offer of {DAY}.04.2026', '', '') END", "", None),
    ("heads", 0, "2", "false", "array('', '', '')", "", None),
    ("heads", 0, "5", "false", "CASE k % 4 WHEN 0 THEN array('Sr', 'Part No', 'Description', 'Qty', 'UOM', 'Unit Price', 'Disc %', 'GST %', 'Lead Time') WHEN 1 THEN array('Sr', 'Supplier Part No', 'Item Description', 'Quantity', 'Unit', 'Rate', 'Discount', 'CGST %', 'SGST %', '') WHEN 2 THEN array('Sr', 'Mfg PN', 'Particulars', 'Order Qty', 'Units', 'Basic Rate', 'Rebate', 'IGST', 'Total') ELSE array('Sr', 'Item Code', 'Goods', 'Qty', 'UOM', 'Price', '', '', 'Amount') END", "k % 13 <> 0", None),
    ("lines", 0, "10 * nth", "false", "array(cast(nth AS string), CASE WHEN item % 6 = 0 THEN '' ELSE code END, CASE WHEN item % 6 = 0 THEN 'AB-' || item || 'X ' || words ELSE words END, CASE WHEN item % 10 = 9 THEN '' ELSE cast(qty AS string) END, CASE item % 5 WHEN 0 THEN 'Nos' WHEN 1 THEN 'mtr' WHEN 2 THEN 'KG' WHEN 3 THEN 'Ltr' ELSE 'box' END, CASE item % 3 WHEN 0 THEN '₹' || price || '.50' WHEN 1 THEN cast(price AS string) ELSE CASE WHEN item % 8 = 1 THEN 'on request' ELSE 'Rs. ' || price || ',000' END END, cast(disc AS string), cast(tax AS string), CASE WHEN k % 4 = 0 THEN (item % 40) || ' days' WHEN k % 4 = 1 THEN cast(tax AS string) ELSE cast(price * qty AS string) END)", "", None),
    ("lines", 0, "10 * nth + 1", "false", "array('', '', 'with mill certificate ' || item, '', '', '')", "item % 5 = 0", None),
    ("lines", 0, "10 * nth + 2", "true", "array('', 'X-' || item, 'internal costing markup', '0', '', '0', '', '', '')", "item % 7 = 0", None),
    ("lines", 0, "10 * nth + 3", "true", "array('', 'Y-' || item, 'spare set', '2', 'set', '15', '', '', '')", "item % 17 = 0", None),
    ("heads", 0, "500", "false", "CASE k % 3 WHEN 0 THEN array('', '', 'Sub Total', '', '', '', '', '', cast(total AS string)) WHEN 1 THEN array('', '', 'Invoice Total', '', '', '', '', '', cast(total AS string)) ELSE array('', '', 'Special discount', '1', '', cast(total AS string)) END", "", None),
    ("heads", 0, "501", "false", "array('', '', 'Grand Total', '₹' || total || '.25', '')", "k % 4 <> 1", None),
    ("heads", 0, "502", "false", "array('Freight', '250.00', '18')", "k % 2 = 0", None),
    ("heads", 0, "503", "false", "array('Packing & Forwarding: 75.50', 'GST 12%')", "k % 3 = 0", None),
    ("heads", 0, "510", "false", "array('', '')", "", None),
    ("heads", 0, "511", "false", "array('', '', '')", "", None),
    ("heads", 0, "520", "false", "array('Payment terms: ' || k % 60 || ' days credit', 'Delivery: 2 weeks FOB Mumbai')", "", None),
    ("lines", 0, "529", "false", "array('VOLUME PRICING - ' || code)", "k % 12 = 0 AND nth = 1", None),
    ("heads", 0, "530", "false", "CASE WHEN k % 12 = 0 THEN array('Min Qty', 'Max Qty', 'Unit Price') ELSE array('SKU', 'Min Qty', 'Max Qty', 'Unit Price') END", "k % 6 = 0", None),
    ("lines", 0, "530 + t.step", "false", "CASE WHEN k % 12 = 0 THEN array(t.low, t.high, cast(price - t.step AS string)) ELSE array(code, t.low, t.high, cast(price - t.step AS string)) END", "k % 6 = 0 AND nth = 1", TIER_STEPS),
    ("heads", 0, "540", "false", "array('Charge Particulars', 'Amount', 'GST %')", "k % 5 = 0", None),
    ("heads", 0, "540 + t.step", "false", "array(t.name, t.amount, t.tax)", "k % 5 = 0", CHARGE_STEPS),
    ("heads", 1, "0", "false", "array('Item', 'Rate', 'Qty', 'Previous Price')", "k % 4 = 1", None),
    ("lines", 1, "nth", "false", "array(words, cast(price AS string), cast(qty AS string), cast(price + 7 AS string))", "k % 4 = 1", None),
]
#: A line's values in a sheet.
LINE = "p_partkey AS item, p_brand || '-' || p_partkey AS code, p_name || ' ' || p_type || ' ' || p_size || 'mm' AS words, cast(l_quantity AS int) AS qty, cast(round(l_extendedprice) AS bigint) div cast(l_quantity AS bigint) AS price, cast(round(l_discount * 100) AS int) AS disc, cast(round(l_tax * 100) AS int) AS tax"


def _rows_view() -> str:
    """The sheets' rows in SQL, one part after the other."""
    text = []
    for source, sheet, row, hidden, cells, where, steps in PARTS:
        names = ("doc_id", f"{sheet} AS sheet", f"{row} AS row_no", f"{hidden} AS hidden", f"{cells} AS cells") if not text else ("doc_id", str(sheet), row, hidden, cells)
        one = ", ".join(names) + f" FROM {{sheet_{source}}}"
        if steps:
            if source == "lines":
                one = "l." + one + " l"
            first = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in steps[0].items())
            one += ", (" + " UNION ALL SELECT ".join([first, *(", ".join(s.values()) for s in steps[1:])]) + ") t"
        text.append(one + (f" WHERE {where}" if where else ""))
    return "SELECT doc_id, cast(sheet AS int) AS sheet, CASE sheet WHEN 0 THEN 'Quotation' ELSE 'Prices backup' END AS sheet_name, cast(row_no AS int) AS row_no, hidden AS is_hidden, cells FROM (SELECT " + " UNION ALL SELECT ".join(text) + ") x"


def written(spark, sf_dir: str) -> DataFrame:
    """The rows of ``sheet_rows``, dealt by document once: an order and its lines meet in one part, where every row of its
    sheets is written. The view reads and deals the lines again for each kind of row."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    lines = lines.select(F.expr("'D-' || l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("k"), F.lit(False).alias("is_head"), *order, "p_partkey", "p_brand", "p_name", "p_type", "p_size")
    heads = table(spark, sf_dir, "orders").select(F.expr("'D-' || o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("k"), F.lit(True).alias("is_head"), "o_totalprice")
    entries = lines.unionByName(heads, allowMissingColumns=True).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    entries = entries.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("is_head", *order)))
    entries = entries.selectExpr("doc_id", "is_head", "k", "nth", "cast(round(o_totalprice) AS bigint) AS total", *LINE.split(", "))

    made = []
    for of, sheet, row, hidden, cells, where, steps in PARTS:
        for step in steps or [{}]:
            fixed = lambda x: re.sub(r"\bt\.(\w+)", lambda m: step[m[1]], x).replace("~/", "div")  # noqa: B023, E731
            one = f"named_struct('sheet', {sheet}, 'sheet_name', '{'Prices backup' if sheet else 'Quotation'}', 'row_no', cast({fixed(row)} AS int), 'is_hidden', {hidden}, 'cells', {fixed(cells)})"
            made.append(f"CASE WHEN {'is_head' if of == 'heads' else 'NOT is_head'} AND {where or 'true'} THEN {one} END AS part_{len(made)}")
    # Each row is a column of its own: all in one array would be one method, too long to be compiled.
    entries = entries.selectExpr("doc_id", *made)
    return entries.select("doc_id", F.inline(F.filter(F.array(*(f"part_{i}" for i in range(len(made)))), lambda x: x.isNotNull())))


VIEWS |= {
    "sheet_lines": """
        SELECT 'D-' || l_orderkey AS doc_id, l_orderkey AS k, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS int) AS nth,
               p_partkey AS item, p_brand || '-' || p_partkey AS code, p_name || ' ' || p_type || ' ' || p_size || 'mm' AS words, cast(l_quantity AS int) AS qty,
               cast(round(l_extendedprice) AS bigint) ~/ cast(l_quantity AS bigint) AS price, cast(round(l_discount * 100) AS int) AS disc, cast(round(l_tax * 100) AS int) AS tax
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "sheet_heads": """
        SELECT 'D-' || o_orderkey AS doc_id, o_orderkey AS k, cast(round(o_totalprice) AS bigint) AS total FROM {orders}""",
    "sheet_rows": _rows_view(),
    "sheet_merges": """
        SELECT doc_id, 0 AS sheet, 0 AS min_row, 1 AS max_row, 0 AS min_col, 1 AS max_col FROM {sheet_heads} UNION ALL SELECT doc_id, 0, 500, 501, 2, 4 FROM {sheet_heads} WHERE k % 2 = 0""",
}


#: Java leaves methods of more bytes than that uncompiled; beyond it Spark writes each expression as methods of their own.
LONGEST = "spark.sql.codegen.hugeMethodLimit"


class Sheets:
    """A data set's sheets, and what each stage of reading them gives."""

    def __init__(self, spark, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        spark.conf.set(LONGEST, "8000")

    def view(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, name, {"sheet_rows": self._rows_name} if uses(name, "sheet_rows") else None)

    @cached_property
    def rows(self) -> DataFrame:
        return written(self._spark, self._dir)

    @cached_property
    def _rows_name(self) -> str:
        name = f"sheet_rows_{uuid.uuid4().hex}"
        self.rows.createOrReplaceTempView(name)
        return name

    @staticmethod
    def _kept(rows: DataFrame, name: str) -> DataFrame:
        """rows, dealt by document as they are, written once, but for their text, which their cells give."""
        return kept_dealt(rows.drop("text"), name, "doc_id").withColumn("text", F.array_join("cells", "\t"))

    @cached_property
    def sliced(self) -> DataFrame:
        """Written once: everything after it reads it several times."""
        return self._kept(sheets.slices(self.rows), "slices")

    @cached_property
    def kinds(self) -> DataFrame:
        return sheets.table_kinds(self.sliced)

    @cached_property
    def main(self) -> DataFrame:
        """The rows of each document's main table."""
        return self._kept(self.sliced.where("kind IN ('HEADER', 'ROW')").join(sheets.main_tables(self.kinds).select(*sheets.TABLE), sheets.TABLE), "main")

    @cached_property
    def roles(self) -> DataFrame:
        return sheets.column_roles(sheets.column_stats(self.main))


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Sheets(spark, sf_dir)), sql(oracle)
        return f

    return keep


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


FILLED = "list_filter({}, lambda c: c <> '')"
LOW = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
NUMBER = r"regexp_matches(regexp_replace({}, '[₹$€,\s%]', '', 'g'), '^[-+]?\d*\.?\d+$')"


def some(words: str, pattern: str) -> str:
    return f"(len(list_filter({words}, lambda c: regexp_matches(c, {q(pattern)}))) > 0)"


def count_hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


WORDS = f"list_filter(has, lambda c: c <> '' AND NOT {NUMBER.format('c')})"
VIEWS |= {
    "o_header_scores": f"""
        SELECT *, CASE WHEN len(has) < 2 OR len(list_filter(has, lambda c: {NUMBER.format("c")})) / len(has) >= 0.4 THEN 0 WHEN {count_hits("line", v.TIER_WORDS)} >= 2 OR list_has_any(has, ['min qty', 'from qty', 'tier']) THEN 0.95
            WHEN named AND price AND amount THEN 0.9 WHEN named AND price THEN 0.75 WHEN named AND amount THEN 0.7 WHEN price AND amount THEN 0.6 WHEN n_roles >= 3 THEN 0.65 ELSE 0 END::DOUBLE AS score
        FROM (SELECT *, array_to_string(has, ' ') AS line, {some("words", v.lenient("description"))} OR {some("words", v.lenient("part_number"))} AS named, {some("words", v.lenient("qty"))} OR {some("words", v.lenient("uom"))} AS amount, {some("words", v.lenient("unit_price"))} AS price,
            {" + ".join(some("words", v.lenient(r)) + "::INT" for r in v.HEADERS)} AS n_roles FROM (SELECT *, {WORDS} AS words FROM (SELECT *, list_transform({FILLED.format("cells")}, lambda c: {LOW.format("c")}) AS has FROM {{sheet_rows}})))""",
    "o_numbered": f"""
        SELECT *, sum((score >= 0.5)::INT) OVER (PARTITION BY doc_id, sheet ORDER BY row_no) AS table_no, len({FILLED.format("cells")}) = 0 AS blank, trim(array_to_string({FILLED.format("cells")}, ' ')) AS said FROM {{o_header_scores}}""",
    "o_ended": f"""
        SELECT *, max(ends) OVER (PARTITION BY doc_id, sheet, table_no ORDER BY row_no) AS ended, max(CASE WHEN score >= 0.5 THEN len(regexp_replace(array_to_string(list_transform(cells, lambda c: CASE WHEN c = '' THEN '0' ELSE '1' END), ''), '0+$', '')) END) OVER (PARTITION BY doc_id, sheet, table_no) AS width,
            max(table_no) OVER (PARTITION BY doc_id, sheet) AS n_tables
        FROM (SELECT *, score < 0.5 AND (regexp_matches(lower(said), {q(v.DIVIDER)}) OR regexp_matches(lower(said), {q(v.FOOTER)}) OR (blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id, sheet, table_no ORDER BY row_no), false))) AS ends FROM {{o_numbered}})""",
    "o_slices": f"""
        SELECT doc_id, sheet, sheet_name, table_no::BIGINT AS table_no, row_no, kind, is_hidden, kept AS cells, array_to_string(kept, chr(9)) AS text, score
        FROM (SELECT *, CASE WHEN kind IN ('HEADER', 'ROW') THEN list_resize(cells, width, '') ELSE {FILLED.format("cells")} END AS kept
        FROM (SELECT *, CASE WHEN table_no = 0 THEN CASE WHEN n_tables > 0 THEN 'META' ELSE 'TEXT' END WHEN score >= 0.5 THEN 'HEADER' WHEN ended THEN 'TEXT' ELSE 'ROW' END AS kind FROM {{o_ended}} WHERE NOT blank)) WHERE kind <> 'ROW' OR len({FILLED.format("kept")}) > 0""",
}

@query("assemble_rows", f"SELECT doc_id, sheet, row_no, len({FILLED.format('cells')})::INT AS n_filled, rtrim(array_to_string(cells, '|'), '|') AS line FROM {{sheet_rows}}")
def assemble_rows(s):
    rows = sheets.assemble_rows(sheets.cells_of(s.rows))
    return rows.select("doc_id", "sheet", "row_no", F.size(sheets.filled(F.col("cells"))).alias("n_filled"), F.array_join("cells", "|").alias("line"))


@query("fill_merges", """
WITH c AS (SELECT doc_id, sheet, row_no, unnest(range(len(cells)))::INT AS col_no, unnest(cells) AS value FROM {sheet_rows})
SELECT c.doc_id, c.sheet, c.row_no, c.col_no, coalesce(t.value, c.value) AS value, t.value IS NOT NULL AS is_merged FROM c
LEFT JOIN {sheet_merges} m ON m.doc_id = c.doc_id AND m.sheet = c.sheet AND c.row_no BETWEEN m.min_row AND m.max_row AND c.col_no BETWEEN m.min_col AND m.max_col AND c.value = ''
LEFT JOIN c t ON t.doc_id = m.doc_id AND t.sheet = m.sheet AND t.row_no = m.min_row AND t.col_no = m.min_col""")
def fill_merges(s):
    return sheets.fill_merged_rows(s.rows, s.view("sheet_merges"))


@query("visible_rows", "SELECT doc_id, sheet, count(*) AS n_rows, count(*) FILTER (WHERE NOT is_hidden) AS n_visible FROM {sheet_rows} GROUP BY 1, 2")
def visible_rows(s):
    n = lambda policy, name: sheets.visible_rows(s.rows, policy).groupBy("doc_id", "sheet").agg(F.count("*").alias(name))
    return n("SMART_INCLUDE", "n_rows").join(n("EXCLUDE_ALL", "n_visible"), ["doc_id", "sheet"], "left")


@query("sheet_profile", f"""
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY density DESC, sheet) = 1 AS is_primary FROM (SELECT doc_id, sheet, count(*) AS n_rows, max(len(cells))::INT AS n_cols, sum(len({FILLED.format('cells')}))::BIGINT AS n_filled, count(*) FILTER (WHERE is_hidden) AS n_hidden,
round(sum(len({FILLED.format('cells')})) / (count(*) * max(len(cells))), 4)::DOUBLE AS density FROM {{sheet_rows}} GROUP BY 1, 2)""")
def sheet_profile(s):
    return sheets.sheet_profile(s.rows)


@query("classify_regions", rf"""
WITH r AS (SELECT *, list_filter(cells, lambda c: trim(c) <> '') AS has FROM {{sheet_rows}} WHERE NOT is_hidden),
n AS (SELECT *, sum((len(has) > 0 AND before = 0)::INT) OVER (PARTITION BY doc_id, sheet ORDER BY row_no) AS region FROM (SELECT *, coalesce(lag(len(has)) OVER (PARTITION BY doc_id, sheet ORDER BY row_no), 0) AS before FROM r)),
h AS (SELECT *, len(has) >= 2 AND len(list_filter(has, lambda c: try_cast(nullif(regexp_replace(c, '[^0-9.+-]', '', 'g'), '') AS DOUBLE) IS NOT NULL)) / len(has) <= 0.5 AND regexp_matches(array_to_string(has, ' '), {q(v.HEADER_WORDS)}) AS header FROM n WHERE len(has) > 0),
g AS (SELECT doc_id, sheet, region::BIGINT AS region, min(row_no) AS first_row, max(row_no) AS last_row, max(len(cells))::INT AS n_cols, avg(len(has) / len(cells)) AS density, arg_min(header, row_no) AS header, bool_or(regexp_matches(array_to_string(cells, ' '), {q(v.TERMINAL)})) AS terminal FROM h GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(bool_or(n_cols >= 2 AND density >= 0.15 AND header) OVER (PARTITION BY doc_id, sheet ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM g)
SELECT doc_id, sheet, region, first_row, last_row, n_cols, round(density, 4) AS density, CASE WHEN terminal AND after THEN 'POST_TABLE_METADATA' WHEN n_cols < 2 OR density < 0.15 THEN CASE WHEN after THEN 'POST_TABLE_METADATA' ELSE 'HEADER_METADATA' END
WHEN header THEN 'TABLE' WHEN after THEN 'POST_TABLE_METADATA' ELSE 'HEADER_METADATA' END AS kind FROM b""")
def classify_regions(s):
    return sheets.regions(s.rows)


@query("header_rows", "SELECT doc_id, sheet, row_no, score FROM {o_header_scores} WHERE score >= 0.5")
def header_rows(s):
    return sheets.header_rows(s.rows).select("doc_id", "sheet", "row_no", "score")


@query("slice_tables", "SELECT doc_id, sheet, table_no, row_no, kind, text, is_hidden FROM {o_slices}")
def slice_tables(s):
    return s.sliced.select("doc_id", "sheet", "table_no", "row_no", "kind", "text", "is_hidden")


def anywhere(words: str) -> str:
    return f"(regexp_matches(line, {q(words)}) OR regexp_matches(lower(sheet_name), {q(words)}))"


READ = ("description", "unit_price", "qty", "part_number", "uom", "amount", "tax")
VIEWS |= {
    "o_tables": f"""
        SELECT *, array_to_string(heads, ' ') AS line FROM (SELECT *, list_transform({FILLED.format("headers")}, lambda c: {LOW.format("c")}) AS heads FROM (
        SELECT doc_id, sheet, sheet_name, table_no, max(cells) FILTER (WHERE kind = 'HEADER') AS headers, count(*) FILTER (WHERE kind = 'ROW') AS n_rows, count(*) FILTER (WHERE kind = 'ROW' AND regexp_matches(lower(text), {q(v.CHARGE_ROWS)})) AS charge_rows
        FROM {{o_slices}} WHERE kind IN ('HEADER', 'ROW') GROUP BY 1, 2, 3, 4))""",
    "o_kinds": f"""
        SELECT *, round(CASE WHEN table_kind = 'MAIN_LINE_ITEMS' THEN 10 * confidence + least(20, 1.5 * n_rows) + 2 * (has_{" + has_".join((*READ, "discount"))}) - CASE WHEN regexp_matches(lower(sheet_name), '{v.DECOY}') THEN 5 ELSE 0 END ELSE 0 END, 4)::DOUBLE AS main_score
        FROM (SELECT *, CASE WHEN table_kind = 'HISTORICAL_REFERENCE' THEN 0.9 WHEN table_kind = 'VOLUME_PRICING' THEN 0.95 WHEN table_kind IN ('CHARGES', 'DISCOUNT_TABLE', 'TAX_TABLE') THEN 0.85 WHEN table_kind IN ('TERMS', 'SUMMARY_TOTALS') THEN 0.9
            WHEN table_kind = 'METADATA' THEN 0.8 WHEN table_kind = 'UNKNOWN' THEN 0.3 WHEN main AND signals >= 3 THEN 0.95 WHEN main THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence
        FROM (SELECT *, CASE WHEN {anywhere(v.HISTORICAL)} THEN 'HISTORICAL_REFERENCE'
            WHEN {" + ".join(f"(contains(line, '{w}') OR contains(lower(sheet_name), '{w}'))::INT" for w in v.TIER_WORDS)} >= 2 OR list_has_any(heads, ['min qty', 'from qty', 'tier', 'max qty']) THEN 'VOLUME_PRICING'
            WHEN regexp_matches(line, 'particulars|description') AND n_rows > 0 AND charge_rows / n_rows >= 0.5 THEN 'CHARGES' WHEN regexp_matches(line, '{v.DISCOUNTS}') THEN 'DISCOUNT_TABLE' WHEN regexp_matches(line, '{v.TAXES}') THEN 'TAX_TABLE'
            WHEN {anywhere(v.TERMS_ANYWHERE)} AND (regexp_matches(line, '{v.TERMS}') OR contains(lower(sheet_name), 'terms_charges')) THEN 'TERMS' WHEN len(heads) <= 2 AND regexp_matches(line, '{v.METADATA}') THEN 'METADATA'
            WHEN {count_hits("line", v.SUMMARY)} >= 2 THEN 'SUMMARY_TOTALS' WHEN main OR (signals >= 2 AND n_rows >= 1) THEN 'MAIN_LINE_ITEMS' ELSE 'UNKNOWN' END AS table_kind
        FROM (SELECT *, has_description = 1 AND (has_unit_price = 1 OR has_qty = 1) AS main, has_{" + has_".join(READ)} AS signals FROM (SELECT *, {", ".join(f"{some('heads', v.lenient(r))}::INT AS has_{r}" for r in (*READ, "discount"))} FROM {{o_tables}}))))""",
    "o_routed": """
        SELECT *, CASE WHEN table_kind = 'VOLUME_PRICING' THEN 'TIERS' WHEN table_kind = 'MAIN_LINE_ITEMS' THEN 'ITEMS' WHEN table_kind IN ('HISTORICAL_REFERENCE', 'SUMMARY_TOTALS', 'TERMS') THEN NULL
            WHEN regexp_matches(lower(array_to_string(headers, ' ')), 'min qty|from qty|tier') THEN 'TIERS' WHEN regexp_matches(lower(array_to_string(headers, ' ')), 'description|item|product|particulars') THEN 'ITEMS' END AS route FROM {o_kinds}""",
    "o_main": "SELECT doc_id, sheet, table_no, n_rows, main_score FROM {o_routed} WHERE route = 'ITEMS' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY main_score DESC, sheet, table_no) = 1",
    "o_main_rows": "SELECT s.* FROM {o_slices} s JOIN {o_main} m ON m.doc_id = s.doc_id AND m.sheet = s.sheet AND m.table_no = s.table_no WHERE kind IN ('HEADER', 'ROW')",
    "o_stats": f"""
        SELECT doc_id, sheet, table_no, col_no::INT AS col_no, max({LOW.format("value")}) FILTER (WHERE kind = 'HEADER') AS header, count(*) FILTER (WHERE has) AS n_values, count(*) FILTER (WHERE has AND number) AS n_numbers,
            count(*) FILTER (WHERE has AND upper(trim(value)) IN ({", ".join(f"'{u}'" for u in v.UNIT_CELLS)})) AS n_units, count(*) FILTER (WHERE has AND code) AS n_codes, count(*) FILTER (WHERE has AND NOT number AND length(trim(value)) >= 3) AS n_texts
        FROM (SELECT *, kind = 'ROW' AND trim(value) <> '' AS has, {NUMBER.format("value")} AS number, length(trim(value)) BETWEEN 2 AND 40 AND (regexp_matches(value, '[0-9]')::INT + regexp_matches(value, '\\p{{L}}')::INT + regexp_matches(value, '[-_./#]')::INT >= 2) AS code
        FROM (SELECT *, unnest(range(len(cells))) AS col_no, unnest(cells) AS value FROM {{o_main_rows}})) GROUP BY 1, 2, 3, 4""",
}


@query("table_kinds", "SELECT doc_id, sheet, table_no, line AS heads, n_rows, table_kind, confidence, main_score FROM {o_kinds}")
def table_kinds(s):
    return s.kinds.select("doc_id", "sheet", "table_no", "heads", "n_rows", "table_kind", "confidence", "main_score")


@query("route_tables", "SELECT doc_id, sheet, table_no, route FROM {o_routed}")
def route_tables(s):
    return sheets.routed(s.kinds).select("doc_id", "sheet", "table_no", "route")


@query("main_tables", "SELECT * FROM {o_main}")
def main_tables(s):
    return sheets.main_tables(s.kinds).select("doc_id", "sheet", "table_no", "n_rows", "main_score")


@query("column_stats", "SELECT * FROM {o_stats}")
def column_stats(s):
    return sheets.column_stats(s.main)


def role_score(role: str) -> str:
    if role == "uom":
        score = "CASE WHEN n_numbers / n_values > 0.4 THEN 0 WHEN n_units / n_values > 0.3 THEN 1 ELSE 0.5 END"
    elif role in v.NUMBERS:
        score = "CASE WHEN n_numbers / n_values >= 0.4 THEN 1 ELSE 0.2 END"
    elif role in v.CODES:
        score = "CASE WHEN n_codes / n_values >= 0.4 THEN 1 ELSE 0.7 END"
    elif role == "supplier":
        score = "CASE WHEN n_codes / n_values > 0.6 THEN 0 WHEN n_numbers / n_values > 0.7 THEN 0.1 ELSE 1 END"
    elif role == "description":
        score = "CASE WHEN n_numbers / n_values > 0.7 THEN 0.1 ELSE 1 END"
    else:
        score = "0.9"
    never = f"AND NOT regexp_matches(header, {q(v.NEVER[role])})" if role in v.NEVER else ""
    return f"CASE WHEN regexp_matches(header, {q(v.strict(role))}) {never} THEN round({v.WEIGHTS.get(role, 1.0)} * CASE WHEN n_values = 0 THEN 0.5 ELSE {score} END, 6) END"


VIEWS |= {
    "o_roles": f"""
        WITH s AS ({" UNION ALL ".join(f"SELECT doc_id, sheet, table_no, col_no, '{r}' AS role, {i} AS pos, ({role_score(r)})::DOUBLE AS score FROM {{o_stats}}" for i, r in enumerate(v.HEADERS))}),
        b AS (SELECT * FROM s WHERE score > 0.2 QUALIFY row_number() OVER (PARTITION BY doc_id, sheet, table_no, col_no ORDER BY score DESC, pos) = 1),
        r AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, sheet, table_no, role ORDER BY score DESC, col_no) = 1)
        SELECT doc_id, sheet, table_no, role, col_no, score FROM r UNION ALL
        SELECT doc_id, sheet, table_no, 'description', min(col_no), 0::DOUBLE FROM {{o_stats}} x WHERE n_texts / nullif(n_values, 0) >= 0.5 AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND r.sheet = x.sheet AND r.table_no = x.table_no AND (r.role = 'description' OR r.col_no = x.col_no)) GROUP BY 1, 2, 3""",
    "o_map": "SELECT doc_id, sheet, table_no, " + ", ".join(f"max(col_no) FILTER (WHERE role = '{r}') AS c_{r}" for r in v.HEADERS) + " FROM {o_roles} GROUP BY 1, 2, 3",
    "o_row_kinds": f"""
        SELECT *, CASE WHEN is_hidden AND (regexp_matches(line, {q(v.HELPERS)}) OR (c_qty IS NOT NULL AND c_unit_price IS NOT NULL AND coalesce(trim(cells[c_qty + 1]), '') IN ('', '0', '0.0') AND coalesce(trim(cells[c_unit_price + 1]), '') IN ('', '0', '0.0'))) THEN 'NOTE'
            {" ".join(f"WHEN regexp_matches(line, {q(w)}) THEN '{k}'" for k, w in v.ROWS.items())}
            WHEN NOT coalesce(regexp_matches(cells[c_qty + 1], '[0-9]'), false) AND NOT coalesce(regexp_matches(cells[c_unit_price + 1], '[0-9]'), false) THEN 'CONTINUATION' ELSE 'ITEM' END AS row_kind
        FROM (SELECT r.*, lower(trim(text, ' ' || chr(9))) AS line, m.* EXCLUDE (doc_id, sheet, table_no) FROM {{o_main_rows}} r LEFT JOIN {{o_map}} m ON m.doc_id = r.doc_id AND m.sheet = r.sheet AND m.table_no = r.table_no WHERE kind = 'ROW')""",
}


@query("column_roles", "SELECT * FROM {o_roles}")
def column_roles(s):
    return s.roles


@query("row_kinds", "SELECT doc_id, sheet, table_no, row_no, row_kind FROM {o_row_kinds}")
def row_kinds(s):
    return sheets.row_kinds(s.main, s.roles).select("doc_id", "sheet", "table_no", "row_no", "row_kind")


VIEWS |= {
    "sheet_files": "SELECT doc_id, row_no, cells FROM {sheet_rows} WHERE sheet = 0",
    "sheet_pages": "SELECT doc_id, cast(1 + row_no ~/ 500 AS int) AS page, row_no AS line_no, array_to_string(list_filter(cells, lambda c: c <> ''), '   ') AS text FROM {sheet_rows} WHERE sheet = 0",
    "o_csv": f"""
        SELECT *, CASE WHEN pos IS NULL THEN 'TEXT' WHEN row_no < pos THEN 'META' WHEN row_no = pos THEN 'HEADER' ELSE 'ROW' END AS kind FROM (SELECT *, max(CASE WHEN row_no = pos THEN len(regexp_replace(array_to_string(list_transform(cells, lambda c: CASE WHEN trim(c) = '' THEN '0' ELSE '1' END), ''), '0+$', '')) END) OVER (PARTITION BY doc_id) AS width
        FROM (SELECT *, min(CASE WHEN {count_hits("line", v.CSV_WORDS)} >= 2 THEN row_no END) OVER (PARTITION BY doc_id) AS pos FROM (SELECT *, lower(array_to_string(cells, ' ')) AS line FROM {{sheet_files}})))""",
}


@query("csv_tables", f"SELECT doc_id, row_no, kind, array_to_string(CASE WHEN kind IN ('HEADER', 'ROW') THEN list_resize(cells, width, '') WHEN kind = 'META' THEN {FILLED.format('cells')} ELSE cells END, '|') AS line FROM {{o_csv}}")
def csv_tables(s):
    return sheets.csv_tables(s.view("sheet_files")).select("doc_id", "row_no", "kind", F.array_join("cells", "|").alias("line"))


VIEWS |= {
    "o_lines": rf"""
        SELECT *, CASE WHEN pos IS NULL THEN CASE WHEN len(tokens) >= 3 AND len(list_filter(tokens, lambda x: regexp_matches(x, '\d'))) >= 2 THEN 'ROW' ELSE 'TEXT' END WHEN line_no < pos THEN 'TEXT' WHEN line_no = pos THEN 'HEADER'
            WHEN len(list_filter(parts[:width], lambda x: regexp_matches(x, '\d'))) > 0 THEN 'ROW' ELSE 'TEXT' END AS kind
        FROM (SELECT *, max(CASE WHEN line_no = pos THEN len(parts) END) OVER (PARTITION BY doc_id) AS width
        FROM (SELECT *, CASE WHEN max(found) OVER (PARTITION BY doc_id) >= 2 THEN first_value(line_no) OVER (PARTITION BY doc_id ORDER BY found DESC, line_no) END AS pos, CASE WHEN len(wide) < 2 THEN tokens ELSE wide END AS parts
        FROM (SELECT *, {count_hits("lower(text)", v.LINE_WORDS)} AS found, list_filter(list_transform(regexp_split_to_array(text, '\s{{2,}}|\t'), lambda x: trim(x)), lambda x: x <> '') AS wide, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS tokens FROM {{sheet_pages}})))""",
}
@query("line_tables", "SELECT doc_id, line_no, kind, CASE WHEN kind = 'TEXT' THEN text WHEN pos IS NULL THEN array_to_string(tokens, '|') ELSE array_to_string(list_resize(parts, width, ''), '|') END AS line FROM {o_lines}")
def line_tables(s):
    return sheets.line_tables(pages(s)).select("doc_id", "line_no", "kind", F.array_join("cells", "|").alias("line"))


def pages(s) -> DataFrame:
    """A sheet as printed: its rows' values, three spaces apart."""
    return s.view("sheet_files").select("doc_id", (1 + F.floor(F.col("row_no") / 500)).cast("int").alias("page"), F.col("row_no").alias("line_no"), F.array_join(sheets.filled(F.col("cells")), "   ").alias("text"))


@query("header_lines", "SELECT doc_id, page, line_no, text, page = 1 AND row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) <= 8 AS is_header_metadata FROM {o_lines} WHERE kind = 'TEXT'")
def header_lines(s):
    return sheets.header_lines(pages(s), sheets.line_tables(pages(s)))
