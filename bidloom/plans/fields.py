"""Queries of what quotation sheets say, and their DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions import text as t
from bidloom.functions import vocabulary as v
from bidloom.operators import fields, sheets
from bidloom.plans.sheets import FILLED, Sheets, q
from bidloom.plans.text import TAX
from bidloom.sources.domain import VIEWS, sql

QUERIES, ORACLE = {}, {}


class Fields(Sheets):
    """What the stages after table detection read."""

    @cached_property
    def docs(self) -> DataFrame:
        # Every document has a row that says something, which slices keep.
        return self.sliced.select("doc_id").distinct()

    @cached_property
    def blocks(self) -> DataFrame:
        return self.sliced.where("kind IN ('META', 'TEXT')").select("doc_id", "sheet", "row_no", "cells")

    @cached_property
    def kinded(self) -> DataFrame:
        return sheets.row_kinds(self.main, self.roles)

    @cached_property
    def pairs(self) -> DataFrame:
        return fields.key_values(self.blocks, self.main.where("kind = 'ROW'"))

    @cached_property
    def items(self) -> DataFrame:
        return fields.line_items(self.kinded)


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Fields(spark, sf_dir)), sql(oracle)
        return f

    return keep


def num(x: str, other: str = "0") -> str:
    plain = rf"regexp_replace(regexp_replace({x}, '[₹$€£]', '', 'g'), '(\d),(\d)', '\1\2', 'g')"
    return rf"coalesce(try_cast(nullif(regexp_extract({plain}, '[-+]?\d+(?:\.\d+)?'), '') AS DECIMAL(18,4)), {other})::DECIMAL(18,4)"


def cuts(source: str, columns: str) -> str:
    """source with its column value cut at labels, word by word."""
    for word in v.CUT_AT:
        source = rf"(SELECT * REPLACE (trim(CASE WHEN regexp_matches(value, '(?i)^{word}[\s#.:/-]') THEN value ELSE regexp_replace(value, '(?is)^(.+?)\b{word}[\s#.:/-].*$', '\1') END) AS value) FROM {source})"
    return f"SELECT {columns} FROM {source}"


def firm_words() -> str:
    return "[" + ", ".join(f"'{w}'" for w in v.FIRM_WORDS) + "]"


LIST = "(" + ", ".join(f"'{x}'" for x in v.NO_SUPPLIER) + ")"
DATE = "coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%d/%m/%Y'), try_strptime({x}, '%d-%m-%Y'), try_strptime({x}, '%d.%m.%Y'))::DATE"
VIEWS |= {
    "o_blocks": "SELECT doc_id, sheet, row_no, cells FROM {o_slices} WHERE kind IN ('META', 'TEXT')",
    "o_pairs": r"""
        SELECT doc_id, 0 AS source, sheet, row_no, row_number() OVER (PARTITION BY doc_id, sheet, row_no ORDER BY i) - 1 AS nth, lower(k) AS key, x AS value FROM (WITH RECURSIVE s AS (
          SELECT doc_id, sheet, row_no, list_filter(list_transform(cells, lambda c: trim(c)), lambda c: c <> '') AS p, 1 AS i, NULL::VARCHAR AS k, NULL::VARCHAR AS x, 0 AS step FROM {o_blocks}
          UNION ALL
          SELECT doc_id, sheet, row_no, p, i + CASE WHEN two THEN 2 ELSE 1 END, CASE WHEN colon AND (l <> '' AND r <> '' OR two) THEN l WHEN two THEN p[i] END, CASE WHEN colon AND l <> '' AND r <> '' THEN r WHEN two THEN trim(p[i + 1]) END, step + 1
          FROM (SELECT *, CASE WHEN colon THEN l <> '' AND r = '' AND i < len(p) ELSE i < len(p) AND NOT contains(p[i + 1], ':') END AS two
            FROM (SELECT *, contains(p[i], ':') AS colon, trim(split_part(p[i], ':', 1)) AS l, trim(substr(p[i], strpos(p[i], ':') + 1)) AS r FROM s WHERE i <= len(p))))
          SELECT * FROM s WHERE k IS NOT NULL)
        UNION ALL SELECT doc_id, 1, sheet, row_no, col_no, lower(trim(split_part(c, ':', 1))), trim(substr(c, strpos(c, ':') + 1)) FROM (SELECT doc_id, sheet, row_no, unnest(range(len(cells))) AS col_no, unnest(cells) AS c FROM {o_main_rows} WHERE kind = 'ROW')
          WHERE contains(c, ':') AND trim(split_part(c, ':', 1)) <> '' AND trim(substr(c, strpos(c, ':') + 1)) <> ''""",
    "o_cut": cuts("{o_pairs}", "*"),
    "o_docs": "SELECT DISTINCT doc_id FROM {sheet_rows}",
}


@query("kv_pairs", "SELECT doc_id, source::INT AS source, sheet, row_no, nth::INT AS nth, key, value FROM {o_pairs}")
def kv_pairs(s):
    return s.pairs


@query("clean_values", "SELECT doc_id, source::INT AS source, sheet, row_no, nth::INT AS nth, value FROM {o_cut}")
def clean_values(s):
    return s.pairs.select("doc_id", *fields.PLACE, fields.clean_value(F.col("value")).alias("value"))


def first_in_column(role: str) -> str:
    return f"SELECT doc_id, arg_min(trim(cells[c_{role} + 1]), row_no) AS v FROM {{o_row_kinds}} WHERE trim(cells[c_{role} + 1]) <> '' GROUP BY doc_id"


def chosen(name: str, parts: list[str], other: str) -> str:
    many = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, v FROM ({p})" for i, p in enumerate(parts))
    return f"SELECT doc_id, coalesce(v, {other}) AS {name} FROM {{o_docs}} LEFT JOIN (SELECT doc_id, arg_min(v, i) AS v FROM ({many}) WHERE v IS NOT NULL GROUP BY doc_id) x USING (doc_id)"


PLACE = "[source, sheet, row_no, nth]"
SUPPLIERS = [
    f"SELECT * FROM ({first_in_column('supplier')}) WHERE lower(v) NOT IN {LIST}",
    f"""SELECT doc_id, arg_min(said, {PLACE}) AS v FROM (SELECT *, regexp_replace(value, '^[:\\s-]+', '') AS said FROM {{o_cut}} WHERE regexp_matches(key, {q(v.SUPPLIER_KEY)}))
        WHERE length(said) >= 3 AND lower(said) NOT IN {LIST} AND NOT regexp_matches(said, {q(v.TITLE)}) AND NOT regexp_matches(said, {q(v.LABEL)}) GROUP BY doc_id""",
    f"""SELECT doc_id, arg_min(head, [sheet, row_no]) AS v FROM (SELECT *, trim(cells[1]) AS head, list_filter(regexp_split_to_array(trim(cells[1]), '\\s+'), lambda w: w <> '') AS w FROM {{o_blocks}} QUALIFY row_number() OVER (PARTITION BY doc_id, sheet ORDER BY row_no) <= 4)
        WHERE length(head) >= 4 AND len(w) BETWEEN 2 AND 10 AND lower(head) NOT IN {LIST} AND NOT regexp_matches(head, {q(v.TITLE)}) AND NOT regexp_matches(head, {q(v.LABEL)}) AND NOT regexp_matches(head, '^[A-Za-z\\s]{{1,20}}:\\s*.+')
        AND len(list_filter(w, lambda x: list_contains({firm_words()}, lower(x)) OR (length(x) >= 4 AND regexp_matches(x, '^[A-ZÀ-ÖØ-Þ]')))) > 0 GROUP BY doc_id""",
]


@query("resolve_supplier", chosen("supplier", SUPPLIERS, "'Unknown Supplier'"))
def resolve_supplier(s):
    return fields.supplier(s.docs, s.blocks, s.pairs, s.kinded)


CODE = "length({x}) >= 3 AND lower({x}) NOT IN ('no', 'number', 'ref', 'dated', 'date')"
NUMBERS = [
    f"SELECT * FROM ({first_in_column('quote_number')}) WHERE length(v) >= 3",
    f"""SELECT doc_id, arg_min(said, {PLACE}) AS v FROM (SELECT *, regexp_extract(regexp_replace(value, '^[:\\s#-]+', ''), '[A-Za-z0-9\\-_/]+') AS said FROM {{o_cut}} WHERE regexp_matches(key, {q(v.NUMBER_KEY)})) WHERE {CODE.format(x="said")} GROUP BY doc_id""",
    f"SELECT doc_id, arg_min(near, [sheet, row_no]) AS v FROM (SELECT *, regexp_extract(array_to_string(cells, chr(9)), {q(v.NUMBER_NEAR)}, 1) AS near FROM {{o_blocks}}) WHERE {CODE.format(x='near')} GROUP BY doc_id",
]


@query("resolve_quote_number", chosen("quote_number", NUMBERS, "NULL"))
def resolve_quote_number(s):
    return fields.quote_number(s.docs, s.blocks, s.pairs, s.kinded)


DATES = [
    f"SELECT doc_id, arg_min(d, row_no) AS v FROM (SELECT *, {DATE.format(x='trim(cells[c_quote_date + 1])')} AS d FROM {{o_row_kinds}}) WHERE d IS NOT NULL GROUP BY doc_id",
    f"SELECT doc_id, arg_min(d, {PLACE}) AS v FROM (SELECT *, {DATE.format(x='value')} AS d FROM {{o_cut}} WHERE regexp_matches(key, {q(v.DATE_KEY)})) WHERE d IS NOT NULL GROUP BY doc_id",
    f"SELECT doc_id, arg_min(d, [sheet, row_no]) AS v FROM (SELECT *, coalesce({', '.join(DATE.format(x=f'regexp_extract(array_to_string(cells, chr(9)), {q(p)}, 1)') for p in v.DATES_NEAR)}) AS d FROM {{o_blocks}}) WHERE d IS NOT NULL GROUP BY doc_id",
]


@query("resolve_dates", f"""SELECT d.*, x.v AS valid_until FROM ({chosen("quote_date", DATES, "NULL")}) d LEFT JOIN
(SELECT doc_id, arg_min(d, {PLACE}) AS v FROM (SELECT *, {DATE.format(x="value")} AS d FROM {{o_cut}} WHERE regexp_matches(key, {q(v.VALIDITY_KEY)})) WHERE d IS NOT NULL GROUP BY doc_id) x ON x.doc_id = d.doc_id""")
def resolve_dates(s):
    return fields.dates(s.docs, s.blocks, s.pairs, s.kinded)


SIGNS = "SELECT doc_id, CASE WHEN bool_or(regexp_matches(l, '₹|INR|Rs\\.')) THEN 'INR' WHEN bool_or(regexp_matches(l, '\\$|USD')) THEN 'USD' WHEN bool_or(regexp_matches(l, '€|EUR')) THEN 'EUR' END AS v FROM (SELECT doc_id, array_to_string(cells, ' ') AS l FROM {sheet_rows}) GROUP BY doc_id"


@query("resolve_currency", chosen("currency", [SIGNS], "'INR'"))
def resolve_currency(s):
    return fields.currency(s.docs, s.rows, s.kinded)


def charge(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), {q(rf'{chr(92)}b(?:{"|".join(w)}){chr(92)}b')}) THEN '{k}'" for k, w in v.CHARGES.items()) + " END"


def last_head(pattern: str, unless: str = "") -> str:
    no = f" AND NOT regexp_matches(lower(h[i]), '{unless}')" if unless else ""
    return f"list_max(list_filter(range(1, len(h) + 1), lambda i: regexp_matches(lower(h[i]), '{pattern}'){no}))"


NEAR = "CASE kind " + " ".join(rf"WHEN '{k}' THEN regexp_extract(line, {q(rf'(?i)\b(?:{"|".join(w)})[\s#.:/-]*₹?\s*(\d+(?:\.\d+)?)')}, 1)" for k, w in v.CHARGES.items()) + " END"
VIEWS |= {
    "o_heads": "SELECT doc_id, sheet, table_no, cells AS h FROM {o_slices} WHERE kind = 'HEADER'",
    "o_table_charges": f"""
        SELECT doc_id, 0 AS source, sheet, row_no, kind2 AS charge_type, amount, tax AS tax_rate_pct FROM (SELECT *, CASE WHEN trim(cells[a]) <> '' THEN {num("cells[a]")} ELSE list_filter(list_transform(has[2:], lambda c: {num("c")}), lambda x: x > 0)[1] END AS amount,
            CASE WHEN trim(cells[t]) <> '' THEN {num("cells[t]")} ELSE {TAX.format(x="text")}::DECIMAL(18,4) END AS tax, {charge("has[1]")} AS kind2
        FROM (SELECT s.*, {FILLED.format("list_transform(cells, lambda c: trim(c))")} AS has, {last_head("amount|value|charge|rate")} AS a, {last_head("tax|gst", "amount|value|charge|rate")} AS t FROM {{o_slices}} s JOIN {{o_heads}} h ON h.doc_id = s.doc_id AND h.sheet = s.sheet AND h.table_no = s.table_no WHERE kind = 'ROW'))
        WHERE kind2 IS NOT NULL AND amount > 0""",
    "o_text_charges": f"""
        SELECT doc_id, 1 AS source, sheet, row_no, kind AS charge_type, amount, CASE WHEN {num("p[i + 2]")} > 0 AND {num("p[i + 2]")} <= 40 THEN {num("p[i + 2]")} ELSE {TAX.format(x="line")}::DECIMAL(18,4) END AS tax_rate_pct
        FROM (SELECT *, CASE WHEN {num("p[i + 1]")} > 0 THEN {num("p[i + 1]")} ELSE try_cast(nullif({NEAR}, '') AS DECIMAL(18,4)) END AS amount FROM (SELECT *, {charge("p[i]")} AS kind
        FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, array_to_string(cells, chr(9)) AS line, {FILLED.format("list_transform(regexp_split_to_array(array_to_string(cells, chr(9)), '[' || chr(9) || ':]+'), lambda c: trim(c))")} AS p FROM {{o_blocks}}))))
        WHERE kind IS NOT NULL AND amount > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, sheet, row_no ORDER BY i) = 1""",
    "o_all_charges": "SELECT * FROM {o_table_charges} UNION ALL SELECT * FROM {o_text_charges}",
}
CHARGE = "doc_id, source::INT AS source, sheet, row_no, charge_type, amount, tax_rate_pct"


@query("charges_from_tables", f"SELECT {CHARGE} FROM {{o_table_charges}}")
def charges_from_tables(s):
    return fields.table_charges(s.sliced)


@query("charges_from_text", f"SELECT {CHARGE} FROM {{o_text_charges}}")
def charges_from_text(s):
    return fields.text_charges(s.blocks)


@query("distinct_charges", f"SELECT {CHARGE} FROM {{o_all_charges}} QUALIFY row_number() OVER (PARTITION BY doc_id, charge_type, amount ORDER BY source, sheet, row_no) = 1")
def distinct_charges(s):
    return fields.distinct_charges(fields.table_charges(s.sliced).unionByName(fields.text_charges(s.blocks)))


STATED = [
    f"SELECT doc_id, arg_max({num('text')}, row_no) AS v FROM {{o_row_kinds}} WHERE row_kind = 'SUBTOTAL' AND contains(lower(text), 'grand total') AND {num('text')} > 0 GROUP BY doc_id",
    f"SELECT doc_id, arg_min(n, [sheet, row_no]) AS v FROM (SELECT *, {num(f'regexp_extract(array_to_string(cells, chr(9)), {q(v.STATED_TOTAL)}, 1)')} AS n FROM {{o_blocks}}) WHERE n > 0 GROUP BY doc_id",
]


@query("stated_totals", chosen("stated_total", STATED, "NULL"))
def stated_totals(s):
    return fields.stated_total(s.docs, s.blocks, s.kinded)


def cell(role: str) -> str:
    return f"nullif(trim(cells[c_{role} + 1]), '')"


BAD = "(" + ", ".join(f"'{x}'" for x in [*t.STANDARD_UNITS, *v.NO_CODE]) + ")"
PARTS = " + ".join(f"CASE WHEN c_{c} IS NOT NULL THEN {num(f'cells[c_{c} + 1]')} ELSE 0 END" for c in ("cgst", "sgst", "igst", "cess"))
UNIT = "CASE WHEN u IS NULL THEN 'PCS' ELSE coalesce(CASE rtrim(lower(u), '.') " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in t.UOM_CODES.items()) + " END, upper(u)) END"
VIEWS |= {
    "o_item_rows": f"""
        SELECT *, sum(is_item::INT) OVER (PARTITION BY doc_id ORDER BY sheet, row_no) - 1 AS line_index FROM (SELECT *, row_kind = 'ITEM' AND {cell("description")} IS NOT NULL AND lower({cell("description")}) NOT IN ({", ".join(f"'{x}'" for x in fields.NOT_ITEMS)}) AS is_item FROM {{o_row_kinds}})
        WHERE is_item OR row_kind = 'CONTINUATION'""",
    "o_items": f"""
        SELECT doc_id, i.line_index::INT AS line_index, sheet, table_no, row_no, d.said AS raw_description, coalesce({", ".join(cell(c) for c in v.CODES)}, CASE WHEN length(code) >= 3 AND upper(code) NOT IN {BAD} AND NOT regexp_matches(code, '^\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}$') AND NOT regexp_matches(code, '^\\d+$') THEN code END) AS part_number,
            CASE WHEN {num(cell("qty"), "1")} > 0 THEN {num(cell("qty"), "1")} ELSE 1 END::DECIMAL(18,4) AS quoted_qty, {UNIT} AS quoted_uom, CASE WHEN {num(cell("unit_price"))} = 0 THEN coalesce(spare, 0) ELSE {num(cell("unit_price"))} END::DECIMAL(18,4) AS unit_price, {num(cell("discount"))} AS discount_pct,
            (CASE WHEN coalesce(c_cgst, c_sgst, c_igst, c_cess) IS NOT NULL THEN {PARTS} WHEN {num(cell("tax"))} > 0 THEN {num(cell("tax"))} ELSE {TAX.format(x="text")} END)::DECIMAL(18,4) AS tax_rate_pct, nullif(regexp_extract({cell("lead_time")}, '(\\d+)', 1), '')::INT AS lead_time_days,
            CASE WHEN coalesce(c_cgst, c_sgst, c_igst, c_cess) IS NOT NULL THEN (c_cgst IS NOT NULL)::INT + (c_sgst IS NOT NULL)::INT + (c_igst IS NOT NULL)::INT + (c_cess IS NOT NULL)::INT WHEN {num(cell("tax"))} > 0 OR {TAX.format(x="text")} > 0 THEN 1 ELSE 0 END::INT AS n_components
        FROM (SELECT *, {cell("uom")} AS u, regexp_extract({cell("description")}, '{v.LEADING_CODE}', 1) AS code, list_filter(list_transform(list_filter(range(len(cells)), lambda i: i <> coalesce(c_qty, -1) AND i <> coalesce(c_description, -1)), lambda i: {num("cells[i + 1]")}), lambda x: x > 0)[1] AS spare FROM {{o_item_rows}} WHERE is_item) i
        JOIN (SELECT doc_id, line_index, string_agg(trim(cells[coalesce(c_description, 0) + 1]), chr(10) ORDER BY row_no) FILTER (WHERE trim(cells[coalesce(c_description, 0) + 1]) <> '') AS said FROM {{o_item_rows}} GROUP BY 1, 2) d USING (doc_id, line_index)""",
}


@query("line_items", "SELECT doc_id, line_index, row_no, raw_description, quoted_qty, quoted_uom, unit_price, discount_pct, lead_time_days FROM {o_items}")
def line_items(s):
    return s.items.select("doc_id", "line_index", "row_no", "raw_description", "quoted_qty", "quoted_uom", "unit_price", "discount_pct", "lead_time_days")


@query("part_numbers", "SELECT doc_id, line_index, part_number FROM {o_items}")
def part_numbers(s):
    return s.items.select("doc_id", "line_index", "part_number")


@query("tax_components", "SELECT doc_id, line_index, n_components, tax_rate_pct FROM {o_items}")
def tax_components(s):
    return s.items.select("doc_id", "line_index", F.size("tax_components").alias("n_components"), "tax_rate_pct")


VIEWS |= {
    "o_tier_tables": f"SELECT doc_id, sheet, table_no, len(h) AS n, {last_head('sku|part|code')} AS c, coalesce({last_head('min|from', 'sku|part|code')}, 1) AS lo, coalesce({last_head('max|to', 'sku|part|code|min|from')}, CASE WHEN len(h) > 1 THEN 2 END) AS hi, coalesce({last_head('price|rate', 'sku|part|code|min|from|max|to')}, CASE WHEN len(h) > 2 THEN 3 END) AS pr FROM (SELECT *, headers AS h FROM {{o_routed}} WHERE route = 'TIERS')",
    "o_titles": "SELECT b.doc_id, b.sheet, arg_min(part_number, [-b.row_no, line_index]) AS title_code FROM {o_blocks} b JOIN {o_items} i ON i.doc_id = b.doc_id WHERE regexp_matches(lower(array_to_string(b.cells, chr(9))), 'volume pricing|tier pricing') AND contains(lower(array_to_string(b.cells, chr(9))), lower(part_number)) GROUP BY 1, 2",
    "o_tier_rows": f"""
        SELECT s.doc_id, s.sheet, s.table_no, s.row_no, CASE WHEN c IS NOT NULL THEN nullif(trim(cells[c]), '') ELSE title_code END AS code, {num("cells[lo]")} AS min_qty, CASE WHEN regexp_matches(trim(cells[hi]), '^\\d+$') THEN {num("cells[hi]")} END AS max_qty, {num("cells[pr]")} AS tier_price
        FROM {{o_slices}} s JOIN {{o_tier_tables}} t ON t.doc_id = s.doc_id AND t.sheet = s.sheet AND t.table_no = s.table_no LEFT JOIN {{o_titles}} x ON x.doc_id = s.doc_id AND x.sheet = s.sheet
        WHERE kind = 'ROW' AND {num("cells[pr]")} > 0 AND NOT coalesce(regexp_matches(lower(cells[lo]), 'freight|packing|insurance|total|terms|notes|delivery|shipping'), false)""",
}


@query("link_tiers", """
SELECT doc_id, line_index, min_qty, max_qty, tier_price AS unit_price FROM (SELECT r.doc_id, r.sheet, r.table_no, r.row_no, r.min_qty, r.max_qty, r.tier_price, min(i.line_index) AS line_index FROM {o_tier_rows} r
JOIN (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_items FROM {o_items}) i ON i.doc_id = r.doc_id AND (i.part_number = r.code OR contains(lower(i.raw_description), lower(r.code)) OR i.n_items = 1) GROUP BY ALL) GROUP BY ALL""")
def link_tiers(s):
    return fields.tiers(s.sliced, s.kinds, s.blocks, s.items).select("doc_id", "line_index", "min_qty", "max_qty", "unit_price")


EVIDENCE = {"raw_description": "description", "quoted_qty": "qty", "quoted_uom": "uom", "unit_price": "unit_price", "discount_pct": "discount", "tax_rate_pct": "tax"}


@query("evidence_rows", " UNION ALL ".join(f"""SELECT doc_id, line_index::INT AS line_index, '{f}' AS field_name, {cell(r)} AS raw_value, CASE WHEN {cell(r)} IS NOT NULL THEN chr(65 + c_{r}) || (row_no + 1) END AS cell_range, CASE WHEN {cell(r)} IS NOT NULL THEN 'column_cell' ELSE 'default' END AS method,
CASE WHEN {cell(r)} IS NOT NULL THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN {cell(r)} IS NOT NULL THEN 'CONFIRMED' ELSE 'INFERRED' END AS status FROM {{o_item_rows}} WHERE is_item""" for f, r in EVIDENCE.items()))
def evidence_rows(s):
    return fields.evidence(s.kinded, s.items)
