"""Queries of states over time, references and exports, and their DuckDB SQL."""

from pyspark.sql import functions as F

from bidloom.operators import award, commercial, lifecycle, master, matching
from bidloom.plans.commercial import Tables
from bidloom.plans.procurement import CODE, gates, proposal
from bidloom.sources.domain import VIEWS, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql(oracle)
        return f

    return keep


VIEWS |= {
    "rfq_events": "SELECT 'RFQ-' || user_id AS rfq_id, event_id AS id, ts, CASE event_type WHEN 'purchase' THEN 'ARCHIVE' WHEN 'error' THEN 'CANCEL' WHEN 'signup' THEN 'RESTORE' ELSE 'DELETE' END AS action FROM {events} WHERE event_type IN ('purchase', 'error', 'signup') OR event_id % 7 = 0",
    "renames": "SELECT 'S-' || (user_id % 200) AS supplier_id, event_id AS id, ts AS renamed_at, CASE WHEN event_id % 3 = 0 THEN 'Firm ' || (user_id % 50) ELSE 'House ' || event_id END AS new_name FROM {events} WHERE event_type = 'purchase'",
    "fx_offers": """
        SELECT 'USD' AS from_cur, 'INR' AS to_cur, 'CACHE' AS provider, 2 AS provider_rank, cast(86.10 AS decimal(18, 8)) AS rate, 4000 AS age UNION ALL SELECT 'USD', 'INR', 'PROVIDER', 3, cast(86.40 AS decimal(18, 8)), 10 UNION ALL
        SELECT 'EUR', 'INR', 'MANUAL', 1, cast(91.00 AS decimal(18, 8)), 9000 UNION ALL SELECT 'EUR', 'INR', 'CACHE', 2, cast(92.00 AS decimal(18, 8)), 30 UNION ALL SELECT 'GBP', 'INR', 'MANUAL', 1, cast(0 AS decimal(18, 8)), 1 UNION ALL SELECT 'GBP', 'INR', 'FALLBACK', 9, cast(108.00 AS decimal(18, 8)), 0""",
    "comparison_log": "SELECT 'RFQ-' || (o_orderkey % 1000) AS rfq_id, 'COMP-' || o_orderkey AS comparison_id, o_orderdate AS created_at FROM {orders}",
    "award_versions": """
        SELECT rfq_id, cast(row_number() OVER (PARTITION BY rfq_id ORDER BY created_at, comparison_id) AS int) AS version, CASE WHEN k % 3 = 0 THEN 'REOPENED' WHEN k % 3 = 1 THEN 'DRAFT' ELSE 'FINALIZED' END AS status, comparison_id, total, created_at AS awarded_at
        FROM (SELECT 'RFQ-' || (o_orderkey % 1000) AS rfq_id, o_orderkey AS k, 'COMP-' || o_orderkey AS comparison_id, o_orderdate AS created_at, cast(o_totalprice AS decimal(18, 2)) AS total FROM {orders} WHERE o_orderkey % 4 <> 3) x""",
    "requotes": """
        SELECT 'Q-' || (l_partkey ~/ 2) || '-' || l_suppkey AS quote_id, cast(l_partkey % 2 AS int) AS line_index, l_shipdate AS ts, cast(l_orderkey * 8 + l_linenumber AS bigint) AS id, l_partkey + l_suppkey + l_linenumber AS k, cast(cast(l_quantity AS int) AS varchar(20)) AS qty, l_returnflag AS flag, l_partkey AS part
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey, l_partkey ORDER BY l_shipdate, l_quantity, l_returnflag) AS nth FROM {lineitem}) x WHERE nth = 1""",
    "corrections": """
        SELECT quote_id, line_index, ts AS corrected_at, id, CASE k % 7 WHEN 0 THEN 'quoted_qty' WHEN 1 THEN 'unit_price' WHEN 2 THEN 'quoted_uom' WHEN 3 THEN 'lead_time_days' WHEN 4 THEN 'raw_description' WHEN 5 THEN 'discount_pct' ELSE 'note' END AS field_name,
               CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 2 THEN 'SET' WHEN k % 7 = 4 THEN 'corrected ' || qty WHEN k % 9 = 0 THEN 'many' ELSE qty END AS corrected_value FROM {requotes} WHERE k % 2 = 0 OR k % 5 = 0""",
    "line_decisions": """
        SELECT quote_id, line_index, ts, id, CASE flag WHEN 'A' THEN CASE WHEN k % 4 = 0 THEN 'CHOOSE' ELSE 'ACCEPT' END WHEN 'R' THEN 'REJECT' ELSE 'REOPEN' END AS action,
               CASE WHEN flag = 'A' AND k % 5 = 0 THEN 'no such item' WHEN flag = 'A' AND k % 5 <> 1 THEN lower(internal_sku) END AS chosen_sku
        FROM {requotes} LEFT JOIN {item_master} ON master_pos = part + k % 2 WHERE k % 3 = 0""",
    "o_rfq_states": "SELECT r.rfq_id, CASE WHEN action IN ('ARCHIVE', 'DELETE') THEN 'ARCHIVED' WHEN action = 'CANCEL' THEN 'CANCELLED' ELSE 'ACTIVE' END AS state, coalesce(n, 0)::BIGINT AS n_events FROM {rfqs} r LEFT JOIN (SELECT rfq_id, arg_max(action, (ts, id)) AS action, count(*) AS n FROM {rfq_events} GROUP BY 1) e ON e.rfq_id = r.rfq_id",
}


@query("rfq_lifecycle", "SELECT * FROM {o_rfq_states}")
def rfq_lifecycle(t):
    return lifecycle.rfq_states(t.rfqs, t.rfq_events)


@query("rfq_lifecycle_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE state = 'ACTIVE' AND coalesce(gate, '') <> 'FINALIZED') AS active, count(*) FILTER (WHERE state = 'ACTIVE' AND gate = 'FINALIZED') AS closed, count(*) FILTER (WHERE state = 'CANCELLED') AS cancelled, count(*) FILTER (WHERE state = 'ARCHIVED') AS archived FROM {o_rfq_states} s LEFT JOIN {o_gate} g ON g.rfq_id = s.rfq_id")
def rfq_lifecycle_counts(t):
    return lifecycle.rfq_counts(lifecycle.rfq_states(t.rfqs, t.rfq_events), gates(t))


@query("supplier_references", """
SELECT s.supplier_id, coalesce(nq, 0)::BIGINT AS n_quotes, coalesce(nc, 0)::BIGINT AS n_comparisons, coalesce(na, 0)::BIGINT AS n_awards FROM {suppliers} s LEFT JOIN (SELECT supplier_id, count(DISTINCT quote_id) AS nq FROM {quotes} GROUP BY 1) q ON q.supplier_id = s.supplier_id
LEFT JOIN (SELECT supplier_id, count(DISTINCT rfq_id) AS nc FROM {o_ranked} GROUP BY 1) c ON c.supplier_id = s.supplier_id LEFT JOIN (SELECT supplier_id, count(DISTINCT rfq_id) AS na FROM {o_propose_optimal} GROUP BY 1) a ON a.supplier_id = s.supplier_id""")
def supplier_references(t):
    return lifecycle.supplier_references(t.suppliers, t.quotes, t.ranked(), proposal(t))


@query("bulk_status", "SELECT internal_item_id, CASE WHEN import_batch_id = 'IMP-2' THEN 'INACTIVE' ELSE status END AS status, coalesce(import_batch_id = 'IMP-2' AND status <> 'INACTIVE', false) AS changed FROM {item_master}")
def bulk_status(t):
    return lifecycle.set_status(t.item_master, t.item_master.where("import_batch_id = 'IMP-2'"), "INACTIVE")


@query("rename_supplier", "SELECT supplier_id, renamed_at, old_name, new_name, is_current FROM (SELECT r.*, coalesce(lag(new_name) OVER w, supplier_name) AS old_name, lead(id) OVER w IS NULL AS is_current FROM {renames} r JOIN {suppliers} s ON s.supplier_id = r.supplier_id WINDOW w AS (PARTITION BY r.supplier_id ORDER BY renamed_at, id)) WHERE old_name <> new_name")
def rename_supplier(t):
    return lifecycle.name_history(t.suppliers, t.renames)


@query("effective_master", f"""
WITH a AS (SELECT * FROM {{item_master}} WHERE status = 'ACTIVE'), l AS (SELECT *, {CODE.format("sku")} AS code FROM {{rfq_lines}}),
n AS (SELECT *, row_number() OVER (PARTITION BY rfq_id, code ORDER BY line_pos, rfq_line_id) AS i, row_number() OVER (PARTITION BY rfq_id, internal_item_id ORDER BY line_pos, rfq_line_id) AS j FROM l)
SELECT NULL::VARCHAR AS rfq_id, internal_item_id, internal_sku, canonical_description FROM a UNION ALL SELECT rfq_id, internal_item_id, sku, description FROM n
WHERE (i = 1 AND code NOT IN (SELECT {CODE.format("internal_sku")} FROM a)) OR (j = 1 AND internal_item_id NOT IN (SELECT internal_item_id FROM a))""")
def effective_master(t):
    return lifecycle.effective_master(t.item_master, t.rfq_lines)


@query("line_for_rfq", """
WITH e AS (SELECT x.*, m.rfq_line_id FROM {o_exact} x LEFT JOIN (SELECT quote_id, line_index, rfq_line_id FROM {matches} WHERE item_key % 3 <> 1) m ON m.quote_id = x.quote_id AND m.line_index = x.line_index),
h AS (SELECT r.rfq_id, r.rfq_line_id, e.quote_id, CASE WHEN e.rfq_line_id = r.rfq_line_id THEN 0 WHEN e.matched_item = r.internal_item_id THEN 1 ELSE 2 END AS rank, line_index FROM {rfq_lines} r JOIN e ON e.rfq_id = r.rfq_id AND (e.rfq_line_id = r.rfq_line_id OR e.matched_item = r.internal_item_id OR e.part_number = r.sku))
SELECT rfq_id, rfq_line_id, quote_id, line_index, rank AS matched_by FROM h QUALIFY row_number() OVER (PARTITION BY rfq_id, rfq_line_id, quote_id ORDER BY rank, line_index) = 1""")
def line_for_rfq(t):
    lines = t.matches.where("item_key % 3 <> 1").select("quote_id", "line_index", "rfq_line_id")
    return lifecycle.line_for_rfq(t.exact().join(lines, ["quote_id", "line_index"], "left"), t.rfq_lines)


@query("fx_resolve", """
SELECT from_cur, 'INR' AS to_cur, (CASE WHEN from_cur = 'INR' THEN 1 ELSE rate END)::DECIMAL(18,8) AS rate, CASE WHEN from_cur = 'INR' THEN 'IDENTITY' ELSE coalesce(provider, 'MISSING') END AS provider FROM (SELECT DISTINCT currency AS from_cur FROM {quotes}) q
LEFT JOIN (SELECT * FROM {fx_offers} WHERE rate > 0 AND (provider <> 'CACHE' OR age <= 3600) QUALIFY row_number() OVER (PARTITION BY from_cur ORDER BY provider_rank, age) = 1) o USING (from_cur)""")
def fx_resolve(t):
    return lifecycle.resolve_rates(t.quotes.select(F.col("currency").alias("from_cur"), F.lit("INR").alias("to_cur")).distinct(), t.fx_offers)


VIEWS |= {
    "o_latest_comparison": "SELECT rfq_id, arg_max(comparison_id, (created_at, comparison_id)) AS comparison_id, max(created_at) AS created_at FROM {comparison_log} GROUP BY 1",
    "o_awards": "SELECT rfq_id, arg_max(version, version) AS version, arg_max(status, version) AS status, arg_max(comparison_id, version) AS comparison_id, arg_max(total, version) AS total, arg_max(awarded_at, version) AS awarded_at, count(*) AS n_versions FROM {award_versions} GROUP BY 1",
}


@query("latest_comparison", "SELECT * FROM {o_latest_comparison}")
def latest_comparison(t):
    return lifecycle.latest_comparisons(t.comparison_log)


@query("award_current", "SELECT * FROM {o_awards}")
def award_current(t):
    return lifecycle.current_awards(t.award_versions)


@query("newer_comparison", "SELECT a.rfq_id, a.version, a.status, a.status = 'FINALIZED' AND coalesce(a.comparison_id <> c.comparison_id, false) AS has_newer_comparison FROM {o_awards} a LEFT JOIN {o_latest_comparison} c ON c.rfq_id = a.rfq_id")
def newer_comparison(t):
    return lifecycle.outdated_awards(lifecycle.current_awards(t.award_versions), lifecycle.latest_comparisons(t.comparison_log))


#: Fields that the corrections of this fixture name, and their types.
CORRECTED = {"quoted_qty": "DECIMAL(18,4)", "unit_price": "DECIMAL(18,4)", "quoted_uom": "VARCHAR", "lead_time_days": "INTEGER", "raw_description": "VARCHAR", "discount_pct": "DECIMAL(9,4)"}
LAST = ", ".join(f"arg_max({{'v': corrected_value}}, (corrected_at, id)) FILTER (WHERE field_name = '{f}') AS n_{f}" for f in CORRECTED)
TAKEN = {f: f"(n_{f} IS NOT NULL AND (n_{f}.v IS NULL OR try_cast(n_{f}.v AS {kind}) IS NOT NULL))" for f, kind in CORRECTED.items()}
NOW = ", ".join(f"(CASE WHEN {TAKEN[f]} THEN try_cast(n_{f}.v AS {kind}) ELSE {f} END)::{kind} AS {f}" for f, kind in CORRECTED.items())


@query("apply_corrections", f"""
SELECT q.quote_id, q.line_index, {NOW}, tax_rate_pct, ({" + ".join(f"{x}::INT" for x in TAKEN.values())})::INT AS n_corrected
FROM {{quote_lines}} q LEFT JOIN (SELECT quote_id, line_index, {LAST} FROM {{corrections}} GROUP BY 1, 2) c ON c.quote_id = q.quote_id AND c.line_index = q.line_index""")
def apply_corrections(t):
    return lifecycle.apply_corrections(t.quote_lines, t.corrections).select("quote_id", "line_index", *CORRECTED, "tax_rate_pct", "n_corrected")


def stages(t):
    return master.rfq_stage(t.rfqs, t.quotes, master.rfq_coverage(t.rfqs, t.matches), t.ranked(), gates(t))


@query("rfq_workspace", """
WITH s AS (SELECT r.rfq_id, n_lines, coalesce(nq, 0)::BIGINT AS n_quotes, CASE WHEN gate = 'FINALIZED' THEN 'AWARD_FINALIZED' WHEN coalesce(nq, 0) = 0 THEN 'QUOTES_PENDING' WHEN nr > 0 THEN 'MATCHING_REVIEW' WHEN nk > 0 THEN 'EVALUATED' ELSE 'READY_FOR_COMPARISON' END AS stage, coalesce(done, 0)::BIGINT AS n_complete, coalesce(open, 0)::BIGINT AS n_in_review
FROM {rfqs} r LEFT JOIN (SELECT rfq_id, count(*) AS nq FROM {quotes} GROUP BY 1) q ON q.rfq_id = r.rfq_id LEFT JOIN (SELECT rfq_id, sum(n_review) AS nr, count(*) FILTER (WHERE state = 'COMPLETE') AS done, count(*) FILTER (WHERE state = 'REVIEW') AS open FROM {o_coverage} GROUP BY 1) c ON c.rfq_id = r.rfq_id
LEFT JOIN (SELECT rfq_id, count(*) FILTER (WHERE rank < 999) AS nk FROM {o_ranked} GROUP BY 1) k ON k.rfq_id = r.rfq_id LEFT JOIN {o_gate} g ON g.rfq_id = r.rfq_id)
SELECT *, CASE stage WHEN 'QUOTES_PENDING' THEN 'COLLECT_QUOTES' WHEN 'MATCHING_REVIEW' THEN 'REVIEW_MATCHES' WHEN 'READY_FOR_COMPARISON' THEN 'RUN_COMPARISON' WHEN 'EVALUATED' THEN 'PREPARE_AWARD' ELSE 'EXPORT_AWARD' END AS next_action FROM s""")
def rfq_workspace(t):
    return lifecycle.workspace(t.rfqs, stages(t), master.rfq_coverage(t.rfqs, t.matches))


@query("dashboard_counts", "SELECT 'rfqs' AS what, count(*) AS n FROM {rfqs} UNION ALL SELECT 'quotes', count(*) FROM {quotes} UNION ALL SELECT 'items', count(*) FROM {item_master} UNION ALL SELECT 'active_items', count(*) FROM {item_master} WHERE status = 'ACTIVE' UNION ALL SELECT 'active_suppliers', count(*) FROM {suppliers} WHERE status = 'ACTIVE'")
def dashboard_counts(t):
    return lifecycle.dashboard(t.rfqs, t.quotes, t.item_master, t.suppliers)


@query("award_allocation_view", """
SELECT p.rfq_id, p.rfq_line_id, sku, description, p.requested_quantity AS required_qty, requested_uom, coalesce(supplier_name, 'UNALLOCATED') AS supplier_name, quote_id, unit_cost, line_value, allocation_state, CASE WHEN is_l1_for_line THEN 'YES' ELSE 'NO' END AS l1_line_optimal
FROM {o_propose_single} p JOIN {rfq_lines} r ON r.rfq_line_id = p.rfq_line_id LEFT JOIN {suppliers} s ON s.supplier_id = p.supplier_id""")
def award_allocation_view(t):
    return lifecycle.allocation_view(proposal(t, "SINGLE_SUPPLIER_L1"), t.rfq_lines, t.suppliers)


VIEWS["o_award_totals"] = "SELECT rfq_id, sum(line_value)::DECIMAL(18,2) AS total_value, count(*) FILTER (WHERE allocation_state = 'FULLY_ALLOCATED') AS n_full, count(*) FILTER (WHERE allocation_state <> 'FULLY_ALLOCATED') AS n_open, count(DISTINCT supplier_id) AS n_suppliers FROM {o_propose_optimal} GROUP BY rfq_id"


@query("award_summary", " UNION ALL ".join(f"SELECT rfq_id, '{k}' AS label, {c}::VARCHAR AS value FROM {{o_award_totals}}" for k, c in (("Total value", "total_value"), ("Lines allocated", "n_full"), ("Lines open", "n_open"), ("Suppliers", "n_suppliers"))))
def award_summary(t):
    return lifecycle.award_summary(award.proposal_totals(proposal(t)))


@query("requisitions", "SELECT p.rfq_id, p.supplier_id, supplier_name, quote_id, rfq_line_id, requested_quantity, unit_cost, line_value, (sum(line_value) OVER (PARTITION BY p.rfq_id, p.supplier_id))::DECIMAL(18,2) AS supplier_total FROM {o_propose_optimal} p JOIN {suppliers} s ON s.supplier_id = p.supplier_id")
def requisitions(t):
    return lifecycle.requisitions(proposal(t), t.suppliers)


@query("erp_export", """
SELECT p.rfq_id, p.rfq_line_id, replace(sku, ',', ';') AS item_sku, replace(description, ',', ';') AS item_description, coalesce(p.requested_quantity::VARCHAR, '0') AS required_qty, coalesce(requested_uom, 'PCS') AS required_uom, CASE WHEN p.supplier_id IS NULL THEN 'UNALLOCATED' ELSE replace(coalesce(supplier_name, p.supplier_id), ',', ';') END AS supplier_name,
  coalesce(p.supplier_id, 'N/A') AS supplier_id, CASE WHEN p.supplier_id IS NULL THEN 'N/A' ELSE quote_id END AS quote_id, CASE WHEN p.supplier_id IS NULL THEN '0' ELSE coalesce(p.requested_quantity::VARCHAR, '0') END AS awarded_qty, CASE WHEN p.supplier_id IS NULL THEN '0.00' ELSE unit_cost::VARCHAR END AS unit_landed_cost,
  CASE WHEN p.supplier_id IS NULL THEN '0.00' ELSE line_value::VARCHAR END AS line_total_value, base_currency, coalesce(comparison_id, '') AS comparison_id, 'AWD-' || p.rfq_id || coalesce('-' || version, '') AS award_id, CASE WHEN a.status = 'FINALIZED' THEN strftime(awarded_at, '%Y-%m-%d') ELSE '' END AS awarded_at
FROM {o_propose_optimal} p JOIN {rfq_lines} r ON r.rfq_line_id = p.rfq_line_id LEFT JOIN {suppliers} s ON s.supplier_id = p.supplier_id LEFT JOIN {rfqs} q ON q.rfq_id = p.rfq_id LEFT JOIN {o_awards} a ON a.rfq_id = p.rfq_id""")
def erp_export(t):
    return lifecycle.erp_export(proposal(t), t.rfq_lines, t.suppliers, t.rfqs, lifecycle.current_awards(t.award_versions))


@query("finalise_requests", "SELECT g.rfq_id, CASE WHEN status = 'FINALIZED' THEN 'REJECTED_ALREADY_FINALIZED' WHEN gate = 'REJECTED' THEN 'REJECTED_WITH_ERRORS' WHEN gate = 'NEEDS_ACKNOWLEDGEMENT' AND n_lines < 2 THEN 'REJECTED_UNALLOCATED' ELSE 'FINALIZED' END AS outcome FROM {o_gate} g LEFT JOIN {o_awards} a ON a.rfq_id = g.rfq_id LEFT JOIN {rfqs} r ON r.rfq_id = g.rfq_id")
def finalise_requests(t):
    return lifecycle.finalise(gates(t), lifecycle.current_awards(t.award_versions), t.rfqs.where("n_lines >= 2"))


VIEWS["allocations"] = "SELECT rfq_id, rfq_line_id, 1 AS alloc_no, supplier_id FROM {submitted} UNION ALL SELECT rfq_id, rfq_line_id, 1, 'S-2' FROM {submitted} WHERE length(rfq_line_id) % 2 = 0 UNION ALL SELECT rfq_id, rfq_line_id, 2, supplier_id FROM {submitted} WHERE length(rfq_id) % 2 = 0"


@query("repeated_allocations", "SELECT rfq_id, rfq_line_id, alloc_no, 'DUPLICATE_LINE' AS error FROM (SELECT *, min(alloc_no) OVER (PARTITION BY rfq_id, rfq_line_id) AS first FROM {allocations}) WHERE alloc_no > first")
def repeated_allocations(t):
    return lifecycle.repeated_allocations(t.allocations)


@query("final_match_status", "SELECT e.quote_id, e.line_index, CASE WHEN match_method <> 'NO_MATCH' AND q.quote_id IS NOT NULL AND uom_factor IS NULL THEN 'UOM_INCOMPATIBLE' WHEN match_method <> 'NO_MATCH' THEN 'EXACT_MATCH' ELSE 'UNMATCHED' END AS match_state FROM {o_exact} e LEFT JOIN {o_qty} q ON q.quote_id = e.quote_id AND q.line_index = e.line_index")
def final_match_status(t):
    return lifecycle.final_status(t.exact(), commercial.quoted_quantity(t.matches, t.uom_units))


@query("award_revisions", """
SELECT rfq_id, row_number() OVER (PARTITION BY rfq_id ORDER BY version) AS revision, awarded_at AS reopened_at, p.status AS previous_status, p.comparison_id AS previous_comparison_id, p.total AS previous_total
FROM {award_versions} v LEFT JOIN (SELECT rfq_id, version + 1 AS version, status, comparison_id, total FROM {award_versions}) p USING (rfq_id, version) WHERE v.status = 'REOPENED'""")
def award_revisions(t):
    return lifecycle.award_revisions(t.award_versions)
