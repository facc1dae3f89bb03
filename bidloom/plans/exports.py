"""Queries of what leaves an award, listings and reasons, and their DuckDB SQL."""

from pyspark.sql import functions as F

from bidloom.operators import award, exports, finance, lifecycle
from bidloom.plans import lifecycle as _views  # noqa: F401  views of logs
from bidloom.plans.commercial import Tables
from bidloom.plans.procurement import bids
from bidloom.plans.rules import splits_checked
from bidloom.sources.domain import VIEWS, sql
from bidloom.sources.stage import new_path

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql(oracle)
        return f

    return keep


VIEWS |= {
    "titled_rfqs": "SELECT rfq_id, base_currency, CASE WHEN n_lines = 2 THEN 'Supply of ' || first_line WHEN n_lines = 1 THEN '' END AS title FROM {rfqs}",
    "signed_awards": "SELECT *, CASE WHEN version % 2 = 0 THEN 'Buyer ' || version END AS awarded_by, CASE version % 3 WHEN 0 THEN 'LINE_ITEM_OPTIMAL' WHEN 1 THEN 'SINGLE_SUPPLIER_L1' END AS scenario FROM {award_versions}",
    "requisition_keys": "SELECT DISTINCT rfq_id, CASE WHEN rfq_id LIKE '%1' THEN quote WHEN rfq_id LIKE '%2' THEN supplier_name WHEN rfq_id LIKE '%3' THEN 'nobody' ELSE supplier_id END AS key FROM {split_base}",
    "titled_comparisons": "SELECT *, CASE WHEN length(comparison_id) % 2 = 0 THEN 'Round ' || comparison_id END AS title FROM {comparison_log}",
    "o_accepted": """
        SELECT c.rfq_id, c.rfq_line_id, alloc_no, split_no, c.supplier_id, coalesce(supplier_name, c.supplier_id) AS supplier_name, c.quote_id, qty, split_value, b.unit_cost AS unit_landed_cost, b.quoted_qty, coalesce(b.is_l1_for_line, false) AS is_l1
        FROM {o_splits_checked} c LEFT JOIN {o_bids} b ON b.rfq_line_id = c.rfq_line_id AND b.supplier_id = c.supplier_id AND b.quote_id = c.quote_id LEFT JOIN {suppliers} u ON u.supplier_id = c.supplier_id WHERE qty IS NOT NULL""",
    "o_last_signed": "SELECT * FROM {signed_awards} QUALIFY row_number() OVER (PARTITION BY rfq_id ORDER BY version DESC) = 1",
}


def accepted(t):
    return t.once("accepted", lambda: exports.accepted(splits_checked(t), bids(t), t.suppliers))


def split_states(t):
    return award.allocation_states(splits_checked(t), t.rfq_lines)


@query("award_sheet", """
SELECT s.rfq_id, s.rfq_line_id, sku AS item_sku, description AS item_description, required AS required_qty, requested_uom AS uom, coalesce(supplier_name, 'UNALLOCATED') AS supplier_name, coalesce(quote_id, 'N/A') AS quote_id, coalesce(qty, 0)::DECIMAL(18,4) AS awarded_qty,
  coalesce(unit_landed_cost, 0)::DECIMAL(18,4) AS unit_landed_cost, coalesce(split_value, 0)::DECIMAL(18,2) AS line_award_value, 'INR' AS currency, state AS allocation_state, CASE WHEN is_l1 THEN 'YES' ELSE 'NO' END AS l1_line_optimal
FROM {o_split_states} s JOIN {rfq_lines} r ON r.rfq_line_id = s.rfq_line_id AND r.rfq_id = s.rfq_id LEFT JOIN {o_accepted} a ON a.rfq_id = s.rfq_id AND a.rfq_line_id = s.rfq_line_id""")
def award_sheet(t):
    return exports.award_sheet(accepted(t), split_states(t), t.rfq_lines, t.rfqs)


KV = {
    "RFQ Reference Number": "rfq_id", "RFQ Project Title": "CASE WHEN title <> '' THEN title ELSE 'Procurement Project' END", "Award Status": "coalesce(status, 'DRAFT')",
    "Award Baseline Date": "CASE WHEN status = 'FINALIZED' THEN awarded_at::VARCHAR ELSE 'Pending Finalization' END", "Awarded By": "coalesce(awarded_by, 'Procurement Specialist')", "Base Sourcing Currency": "'INR'",
    "Total Award Commitment": "'INR ' || format('{{:,.2f}}', coalesce(total, 0)::DOUBLE)", "Total RFQ Scope Items": "n_lines::VARCHAR", "Fully Allocated Lines": "n_full::VARCHAR", "Partially Allocated Lines": "n_partial::VARCHAR",
    "Unallocated Scope Lines": "n_open::VARCHAR", "Selected Sourcing Strategy": "coalesce(scenario, 'MANUAL_ALLOCATION')", "Commercial Evaluation ID": "coalesce(comparison_id, 'N/A')",
}
STATE = "count(*) FILTER (WHERE state = '{0}')"


@query("award_summary_rows", f"""
WITH w AS (SELECT q.rfq_id, q.title, a.status, a.awarded_at, a.awarded_by, a.scenario, a.comparison_id, s.total, n_lines, n_full, n_partial, n_open FROM {{titled_rfqs}} q LEFT JOIN {{o_last_signed}} a ON a.rfq_id = q.rfq_id
  LEFT JOIN (SELECT rfq_id, sum(value) AS total, count(*) AS n_lines, {STATE.format("FULLY_ALLOCATED")} AS n_full, {STATE.format("PARTIALLY_ALLOCATED")} AS n_partial, {STATE.format("UNALLOCATED")} AS n_open FROM {{o_split_states}} GROUP BY 1) s ON s.rfq_id = q.rfq_id)
""" + " UNION ALL ".join(f"SELECT rfq_id, {i}::INT AS row_no, '{label}' AS label, {value.replace('{{', '{').replace('}}', '}')} AS value FROM w" for i, (label, value) in enumerate(KV.items(), 1)))
def award_summary_rows(t):
    last = t.signed_awards.groupBy("rfq_id").agg(F.max_by(F.struct("status", "awarded_at", "awarded_by", "scenario", "comparison_id"), "version").alias("a")).select("rfq_id", "a.*")
    return exports.award_summary(t.titled_rfqs, split_states(t), last)


REQUISITION = """
SELECT a.rfq_id, k.key, a.supplier_id, supplier_name, quote_id, a.rfq_line_id, alloc_no, split_no, sku AS item_sku, description AS item_description, qty AS allocated_qty, requested_uom AS uom, unit_landed_cost, split_value AS line_value, quoted_qty AS quoted_capacity,
  (sum(split_value) OVER (PARTITION BY a.rfq_id, k.key))::DECIMAL(18,2) AS total_value
FROM {o_accepted} a JOIN {requisition_keys} k ON k.rfq_id = a.rfq_id AND (k.key = a.supplier_id OR k.key = a.quote_id OR k.key = a.supplier_name) JOIN {rfq_lines} r ON r.rfq_line_id = a.rfq_line_id"""


@query("requisition_by_key", REQUISITION)
def requisition_by_key(t):
    return exports.requisition(accepted(t), t.requisition_keys, t.rfq_lines)


@query("requisition_files", "SELECT supplier_id, count(*) AS n_splits, count(DISTINCT rfq_id) AS n_rfqs, sum(split_value)::DECIMAL(18,2) AS value FROM {o_accepted} GROUP BY 1")
def requisition_files(t):
    path, rows = new_path(t.spark, "requisitions"), accepted(t)
    exports.write_requisitions(rows, path)
    back = t.spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("supplier_id").agg(F.count("*").alias("n_splits"), F.countDistinct("rfq_id").alias("n_rfqs"), F.sum("split_value").cast("decimal(18,2)").alias("value"))


@query("comparison_listing", """
SELECT comparison_id, c.rfq_id, coalesce(title, 'Comparison for ' || c.rfq_id) AS title, created_at, coalesce(n, 0)::BIGINT AS supplier_count, coalesce(supplier_name, 'Split Optimal') AS l1_supplier, coalesce(l1.total_base::VARCHAR, '—') AS l1_landed_cost, 'INR' AS base_currency
FROM {titled_comparisons} c LEFT JOIN (SELECT rfq_id, count(*) AS n FROM {o_ranked} GROUP BY 1) k ON k.rfq_id = c.rfq_id LEFT JOIN (SELECT rfq_id, supplier_id, total_base FROM {o_ranked} WHERE rank = 1) l1 ON l1.rfq_id = c.rfq_id LEFT JOIN {suppliers} s ON s.supplier_id = l1.supplier_id""")
def comparison_listing(t):
    return exports.comparison_listing(t.titled_comparisons, t.ranked(), t.rfqs, t.suppliers)


RECENT = {"rfqs": ("SELECT rfq_id AS id, max(created_at) AS as_of FROM {comparison_log} GROUP BY 1", 5), "quotes": ("SELECT quote_id AS id, max(ts) AS as_of FROM {requotes} GROUP BY 1", 6), "comparisons": ("SELECT comparison_id AS id, created_at AS as_of FROM {comparison_log}", 5)}


@query("dashboard_recent", " UNION ALL ".join(f"SELECT '{k}' AS what, place::INT AS place, id, as_of::VARCHAR AS as_of FROM (SELECT *, row_number() OVER (ORDER BY as_of DESC, id DESC) AS place FROM ({q})) WHERE place <= {n}" for k, (q, n) in RECENT.items()))
def dashboard_recent(t):
    made = lifecycle.latest_comparisons(t.comparison_log).select(F.col("rfq_id").alias("id"), F.col("created_at").alias("as_of"))
    quoted = t.requotes.groupBy(F.col("quote_id").alias("id")).agg(F.max("ts").alias("as_of"))
    compared = t.comparison_log.select(F.col("comparison_id").alias("id"), F.col("created_at").alias("as_of"))
    return exports.most_recent({"rfqs": (made, 5), "quotes": (quoted, 6), "comparisons": (compared, 5)})


REASON = "CASE code WHEN 'SUPPLIER_UNKNOWN' THEN 'supplier_name: no supplier was found' WHEN 'QUOTE_NUMBER_MISSING' THEN 'quote_number: no number was found' WHEN 'NO_LINE_ITEMS' THEN 'items: no line was found' WHEN 'UNIT_PRICE_INVALID' THEN place || '.unit_price: the price is not positive' WHEN 'QUANTITY_INVALID' THEN place || '.quoted_qty: the quantity is not positive' WHEN 'UOM_NON_STANDARD' THEN place || '.quoted_uom: the unit is not a standard one' ELSE place || '.raw_description: the description is too short' END"


@query("confidence_reasons", f"""
WITH i AS (SELECT *, 'items[' || line_index || ']' AS place FROM {{o_issues}}), n AS (SELECT quote_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high FROM i GROUP BY 1)
SELECT quote_id, line_index, 'ISSUE' AS kind, CASE severity WHEN 'CRITICAL' THEN 0.5 WHEN 'HIGH' THEN 0.25 WHEN 'MEDIUM' THEN 0.1 ELSE 0.05 END::DOUBLE AS penalty, severity || ': ' || {REASON} AS reason FROM i
UNION ALL SELECT quote_id, NULL, 'RECONCILIATION', CASE WHEN status = 'DISCREPANCY' THEN 0.25 ELSE 0 END, status || ': ' || CASE status WHEN 'DISCREPANCY' THEN 'the calculated total differs from the stated one' WHEN 'RECONCILED' THEN 'the calculated total is the stated one' ELSE 'no total is stated; the sums were checked against each other' END FROM {{o_reconciled}}
UNION ALL SELECT q.quote_id, NULL, 'CAP', 0, CASE WHEN critical > 0 THEN 'at most 0.30 because of a critical issue' WHEN status = 'DISCREPANCY' THEN 'at most 0.55 because of a total that differs' ELSE 'at most 0.65 because of an issue of high severity' END
FROM {{quotes}} q LEFT JOIN n ON n.quote_id = q.quote_id LEFT JOIN {{o_reconciled}} r ON r.quote_id = q.quote_id WHERE critical > 0 OR high > 0 OR status = 'DISCREPANCY'""")
def confidence_reasons(t):
    reconciled = t.once("reconciled", t.reconciled)
    return exports.confidence_reasons(t.issues(), reconciled, finance.confidence(t.issues(), t.quotes, reconciled))
