"""Queries over document lines and their DuckDB SQL."""

from bidloom.operators import grid
from bidloom.sources.domain import VIEWS, sql, table

QUERIES, ORACLE = {}, {}

VIEWS |= {
    "o_doc_lines": "SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {documents})",
    "o_cells": "SELECT *, list_filter(regexp_split_to_array(text, '[ \\t]+'), lambda x: x <> '') AS c, trim(text, ' ') = '' AS blank FROM {o_doc_lines}",
    "o_rows": "SELECT doc_id, line_no, len(c)::INT AS n_cells FROM {o_cells} WHERE len(c) >= 3 AND len(list_filter(c, lambda x: regexp_matches(x, '[0-9]'))) >= 2",
}


def query(name: str, operator, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(grid.doc_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ORACLE[name] = sql(oracle)


query("segment_regions", grid.segment_regions, """
SELECT doc_id, region::BIGINT AS region, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines, max(len(c))::INT AS n_cols
FROM (SELECT *, sum(CASE WHEN NOT blank AND before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS region FROM (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS before FROM {o_cells})) WHERE NOT blank GROUP BY 1, 2""")
query("numeric_rows", grid.numeric_rows, "SELECT * FROM {o_rows}")
query("document_profile", grid.profile, "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT blank) AS n_filled, round(count(*) FILTER (WHERE NOT blank) / count(*)::DOUBLE, 4) AS density, max(len(c))::INT AS n_cols FROM {o_cells} GROUP BY 1")
query("scan_warnings", grid.scan_warnings, """
SELECT doc_id, n_chars, CASE WHEN n_chars = 0 THEN 'SCANNED_PDF_NO_TEXT' WHEN n_rows IS NULL THEN 'PDF_TABLE_EXTRACTION_UNSUPPORTED' END AS warning
FROM (SELECT doc_id, sum(length(trim(text, ' ')))::BIGINT AS n_chars FROM {o_doc_lines} GROUP BY 1) LEFT JOIN (SELECT doc_id, count(*) AS n_rows FROM {o_rows} GROUP BY 1) USING (doc_id)""")
query("merge_continuations", grid.merge_continuations, """
SELECT doc_id, item_no::BIGINT AS item_no, count(*) AS n_lines, string_agg(text, ' ' ORDER BY line_no) AS text
FROM (SELECT *, sum(CASE WHEN regexp_matches(text, '^[A-ZÀ-ÖØ-Þ]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS item_no FROM {o_cells} WHERE NOT blank) WHERE item_no > 0 GROUP BY 1, 2""")
