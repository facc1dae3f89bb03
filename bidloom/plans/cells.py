"""Queries of cell tables and of accuracy by field, and their DuckDB SQL."""

from pyspark.sql import functions as F

from bidloom.operators import accuracy, sheets
from bidloom.plans.commercial import Tables
from bidloom.plans import files as _file_views  # noqa: F401  their views are named here
from bidloom.plans.sheets import Sheets
from bidloom.sources import files
from bidloom.sources.domain import VIEWS, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql(oracle)
        return f

    return keep


#: Some documents hide their sixth column; the ninth holds formulas.
HIDES = "(doc_id LIKE '%1' OR doc_id LIKE '%4' OR doc_id LIKE '%6')"
VIEWS["o_cells"] = f"SELECT doc_id, sheet, row_no, is_hidden, {HIDES} AS hides, unnest(cells) AS value, unnest(range(len(cells))) AS col_no FROM {{sheet_rows}}"


def cells(t):
    """The sheets' cells with flags and formulas, dealt by document as their rows are: a table of them takes many times their
    room, and reading it back would deal all cells again."""
    hides = F.col("doc_id").rlike("[146]$")
    rows = Sheets(t.spark, t.sf_dir).rows.select("doc_id", "sheet", "sheet_name", "row_no", F.col("is_hidden").alias("is_hidden_row"), F.posexplode("cells").alias("col_no", "value"))
    rows = rows.withColumns({"is_hidden_col": hides & (F.col("col_no") == 5), "formula": F.when((F.col("col_no") == 8) & (F.col("value") != ""), F.concat(F.lit("=D*"), F.col("value"))).otherwise(F.col("value"))})
    return files.as_cells(rows)


@query("cell_profile", "SELECT doc_id, sheet, count(*) FILTER (WHERE trim(value) <> '') AS n_cells, count(*) FILTER (WHERE col_no = 8 AND value <> '') AS n_formulas, count(DISTINCT row_no) FILTER (WHERE is_hidden) AS n_hidden_rows, count(DISTINCT col_no) FILTER (WHERE hides AND col_no = 5) AS n_hidden_cols FROM {o_cells} GROUP BY 1, 2")
def cell_profile(t):
    return sheets.cell_profile(cells(t))


@query("visible_cells", """
SELECT doc_id, count(*) AS n_rows, sha256(string_agg(sheet || ':' || row_no || ':' || line, chr(10) ORDER BY sheet, row_no)) AS rows_sha256
FROM (SELECT doc_id, sheet, row_no, rtrim(array_to_string(list_transform(cells, lambda c, i: CASE WHEN i = 6 AND hides THEN '' ELSE trim(c) END), '|'), '|') AS line FROM (SELECT *, """ + HIDES + """ AS hides FROM {sheet_rows}) WHERE NOT is_hidden) GROUP BY doc_id""")
def visible_cells(t):
    """A digest of each document's rows without what is hidden."""
    rows = sheets.rows_of_cells(cells(t), "EXCLUDE_ALL")
    line = F.concat_ws(":", "sheet", "row_no", F.array_join("cells", "|"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("sheet", "row_no", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(lines, "\n"), 256).alias("rows_sha256"))


def ratios(pairs: str) -> str:
    """SQL for the likeness of word sets of pairs (a, b); its views are named after pairs'."""
    again = lambda text: text.replace("{o_texts}", f"{{{pairs}}}").replace("{o_sets}", f"{{{pairs}_sets}}").replace("{o_set_pairs}", f"{{{pairs}_set_pairs}}").replace("{o_indel}", f"{{{pairs}_indel}}")
    for name in ("sets", "set_pairs", "indel"):
        VIEWS[f"{pairs}_{name}"] = again(VIEWS[f"o_{name}"])
    return again("""
        SELECT a, b, CASE WHEN both_ <> '' AND (l = '' OR r = '') THEN 1 ELSE greatest(p.ratio, coalesce(q.ratio, 0), coalesce(s.ratio, 0)) END::DOUBLE AS ratio FROM {o_sets} o LEFT JOIN {o_indel} p ON p.x = trim(both_ || ' ' || l) AND p.y = trim(both_ || ' ' || r)
        LEFT JOIN {o_indel} q ON both_ <> '' AND q.x = both_ AND q.y = trim(both_ || ' ' || l) LEFT JOIN {o_indel} s ON both_ <> '' AND s.x = both_ AND s.y = trim(both_ || ' ' || r)""")


LINE = "doc_id, line_index, k, p_name, p_type, cast(qty AS decimal(18, 4)) AS quoted_qty, uom AS quoted_uom, price AS unit_price, tax AS tax_rate_pct"
VIEWS |= {
    "true_heads": """
        SELECT doc_id, CASE k % 3 WHEN 0 THEN 'Acme Tools India' WHEN 1 THEN 'Bharat Steel Works' ELSE 'Orient Cables' END AS supplier, CASE WHEN k % 5 <> 0 THEN 'QT/' || k END AS quote_number, CASE WHEN k % 7 <> 0 THEN day END AS quote_date, landed
        FROM (SELECT doc_id, min(k) AS k, cast('2026-03-05' AS date) AS day, cast(sum(price) AS decimal(18, 2)) AS landed FROM {eval_lines} GROUP BY doc_id) x""",
    "found_heads": """
        SELECT doc_id, CASE k % 4 WHEN 0 THEN 'acme tools' WHEN 1 THEN 'BHARAT STEEL WORKS LTD' WHEN 2 THEN 'Orient Cabels' END AS supplier, CASE WHEN k % 6 = 0 THEN 'QT-' || k ELSE 'QT/' || k END AS quote_number,
               CASE WHEN k % 8 <> 0 THEN day END AS quote_date, cast(landed + (CASE k % 9 WHEN 0 THEN 1 WHEN 1 THEN 250 WHEN 2 THEN 3 * landed ELSE 0 END) AS decimal(18, 2)) AS landed
        FROM (SELECT doc_id, min(k) AS k, cast('2026-03-05' AS date) AS day, cast(sum(price) AS decimal(18, 2)) AS landed FROM {eval_lines} GROUP BY doc_id) x WHERE k % 23 <> 0""",
    "head_lines_true": f"SELECT doc_id, line_index, p_name || ' ' || p_type AS raw_description, quoted_qty, quoted_uom, unit_price, tax_rate_pct FROM (SELECT {LINE} FROM {{eval_lines}}) x",
    "head_lines_found": f"""
        SELECT doc_id, line_index, CASE k % 3 WHEN 0 THEN upper(p_type || ' ' || p_name) WHEN 1 THEN replace(p_name, ' ', '') || ' ' || p_type ELSE p_name || ' spare' END AS raw_description, CASE WHEN k % 10 = 0 THEN NULL ELSE quoted_qty END AS quoted_qty,
               CASE WHEN k % 7 = 0 THEN 'SET' ELSE quoted_uom END AS quoted_uom, unit_price, CASE WHEN k % 19 = 0 THEN NULL ELSE tax_rate_pct END AS tax_rate_pct FROM (SELECT {LINE} FROM {{eval_lines}}) x WHERE line_index <= 5 OR doc_id NOT LIKE '%5'""",
    "o_head_names": "SELECT DISTINCT lower(f.supplier) AS a, lower(t.supplier) AS b FROM {found_heads} f JOIN {true_heads} t ON t.doc_id = f.doc_id WHERE f.supplier IS NOT NULL",
    "o_head_pairs": "SELECT t.doc_id, f.quoted_qty IS NOT DISTINCT FROM t.quoted_qty AS qty, f.quoted_uom = t.quoted_uom AS uom, f.unit_price = t.unit_price AS price, f.tax_rate_pct IS NOT DISTINCT FROM t.tax_rate_pct AS tax, lower(f.raw_description) AS a, lower(t.raw_description) AS b FROM {head_lines_true} t JOIN {head_lines_found} f ON f.doc_id = t.doc_id AND f.line_index = t.line_index",
    "o_head_texts": "SELECT DISTINCT a, b FROM {o_head_pairs}",
}
VIEWS["o_head_name_ratio"], VIEWS["o_head_text_ratio"] = ratios("o_head_names"), ratios("o_head_texts")
PCTS = ("supplier", "quote_number", "quote_date", "item_count", "description", "quantity", "uom", "unit_price", "tax", "landed")


@query("field_report", f"""
SELECT *, ((2 * ({" + ".join(f"floor({p}_pct * 1e4::DOUBLE + 0.5)::BIGINT" for p in PCTS)}) + 10000) // 20000) / 10 AS overall_pct FROM (
SELECT t.doc_id, CASE WHEN n.ratio >= 0.8 THEN 100 ELSE 0 END::DOUBLE AS supplier_pct, CASE WHEN t.quote_number IS NULL OR f.quote_number = t.quote_number THEN 100 ELSE 0 END::DOUBLE AS quote_number_pct, CASE WHEN t.quote_date IS NULL OR f.quote_date = t.quote_date THEN 100 ELSE 0 END::DOUBLE AS quote_date_pct,
  round(greatest(0, 100 - abs(coalesce(m.n, 0) - c.n) * 100.0::DOUBLE / c.n), 4) AS item_count_pct, ((2 * coalesce(m.description, 0) + 1000000 * c.n) // (2000000 * c.n)) / 10 AS description_pct, {", ".join(f"round(coalesce(m.{x}, 0) * 100.0::DOUBLE / c.n, 1) AS {x}_pct" for x in PCTS[5:9])},
  round(CASE WHEN t.landed <= 0 OR abs(coalesce(f.landed, 0) - t.landed) <= 1 THEN 100 ELSE greatest(0, 100 - abs(coalesce(f.landed, 0) - t.landed)::DOUBLE / t.landed::DOUBLE * 100) END::DOUBLE, 4) AS landed_pct
FROM {{true_heads}} t LEFT JOIN {{found_heads}} f ON f.doc_id = t.doc_id LEFT JOIN {{o_head_name_ratio}} n ON n.a = lower(f.supplier) AND n.b = lower(t.supplier) JOIN (SELECT doc_id, count(*) AS n FROM {{head_lines_true}} GROUP BY 1) c ON c.doc_id = t.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n, sum(floor(ratio * 1e9::DOUBLE + 0.5)::BIGINT)::BIGINT AS description, count(*) FILTER (qty) AS quantity, count(*) FILTER (uom) AS uom, count(*) FILTER (price) AS unit_price, count(*) FILTER (tax) AS tax FROM {{o_head_pairs}} p JOIN {{o_head_text_ratio}} r ON r.a = p.a AND r.b = p.b GROUP BY 1) m ON m.doc_id = t.doc_id)""")
def field_report(t):
    return accuracy.field_report(t.found_heads, t.true_heads, t.head_lines_found, t.head_lines_true)
