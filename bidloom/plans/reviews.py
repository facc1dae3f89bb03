"""Queries of reviews and accuracy, and their DuckDB SQL."""

from pyspark.sql import functions as F

from bidloom.operators import finance, master, matching, review
from bidloom.plans.commercial import Tables
from bidloom.plans.procurement import VIEWS
from bidloom.sources.domain import sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql(oracle)
        return f

    return keep


#: A truth that differs from the quoted lines in every tenth quantity and every seventh unit, and has lines of its own.
VIEWS["o_truth"] = """
SELECT quote_id, CASE WHEN item_key % 13 = 0 THEN line_index + 50 ELSE line_index END AS line_index, CASE WHEN item_key % 10 = 0 THEN quoted_qty + 1 ELSE quoted_qty END::DECIMAL(18,4) AS quoted_qty,
       CASE WHEN item_key % 7 = 0 THEN 'SET' ELSE quoted_uom END AS quoted_uom, unit_price, CASE WHEN item_key % 3 = 0 THEN landed + 0.5 WHEN item_key % 11 = 0 THEN landed + 2 ELSE landed END::DECIMAL(18,2) AS landed FROM {o_amounts}"""


@query("review_issues", """
SELECT quote_id, line_index, 'MATCH_REVIEW_REQUIRED' AS code, 'MEDIUM' AS severity FROM {o_prices} WHERE is_provisional UNION ALL SELECT quote_id, line_index, 'UOM_INCOMPATIBLE', 'HIGH' FROM {o_prices} WHERE uom_factor IS NULL
UNION ALL SELECT quote_id, line_index, 'UNMATCHED_ITEM', 'HIGH' FROM {o_exact} WHERE matched_item IS NULL UNION ALL SELECT quote_id, NULL, 'FINANCIAL_DISCREPANCY', 'HIGH' FROM {o_reconciled} WHERE status = 'DISCREPANCY'""")
def review_issues(t):
    return review.review_issues(t.prices(), t.exact(), t.reconciled())


@query("quote_listing", "SELECT q.quote_id, q.rfq_id, supplier_name, currency, q.n_lines, coalesce(quote_total, 0)::DECIMAL(18,2) AS quote_total, coalesce(coverage_pct, 0.0)::DOUBLE AS coverage_pct, coalesce(state, 'PENDING') AS state FROM {quotes} q LEFT JOIN {o_totals} t ON t.quote_id = q.quote_id LEFT JOIN {o_coverage} c ON c.quote_id = q.quote_id")
def quote_listing(t):
    return review.quote_listing(t.quotes, t.totals(), master.rfq_coverage(t.rfqs, t.matches))


PCT = ", ".join(f"round(100 * avg(CASE WHEN {ok} THEN 1 ELSE 0 END), 2) AS {c}_pct" for c, ok in (("quoted_qty", "t.quoted_qty = a.quoted_qty"), ("quoted_uom", "t.quoted_uom = a.quoted_uom"), ("unit_price", "t.unit_price = a.unit_price"), ("landed", "abs(t.landed - a.landed) <= 1")))


@query("field_accuracy", f"SELECT t.quote_id, count(*) AS n_lines, {PCT} FROM {{o_truth}} t LEFT JOIN {{o_amounts}} a ON a.quote_id = t.quote_id AND a.line_index = t.line_index GROUP BY t.quote_id")
def field_accuracy(t):
    actual = finance.line_amounts(t.quote_lines)
    key = F.col("item_key")
    truth = actual.withColumns({
        "line_index": F.when(key % 13 == 0, F.col("line_index") + 50).otherwise(F.col("line_index")),
        "quoted_qty": F.when(key % 10 == 0, F.col("quoted_qty") + 1).otherwise(F.col("quoted_qty")).cast("decimal(18,4)"),
        "quoted_uom": F.when(key % 7 == 0, "SET").otherwise(F.col("quoted_uom")),
        "landed": F.when(key % 3 == 0, F.col("landed") + F.lit("0.5").cast("decimal(3,1)")).when(key % 11 == 0, F.col("landed") + 2).otherwise(F.col("landed")).cast("decimal(18,2)"),
    })
    return review.field_accuracy(actual, truth)
