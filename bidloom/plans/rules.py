"""Queries of submitted awards, item dependencies and eligibility, and their DuckDB SQL."""

from pyspark.sql import functions as F

from bidloom.operators import allocations, award, catalog, commercial, ranking
from bidloom.plans.commercial import Tables
from bidloom.plans.procurement import bids, proposal
from bidloom.sources.domain import VIEWS, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql(oracle)
        return f

    return keep


VIEWS |= {
    # Splits named by supplier, by quote alone, by a quote that is not the supplier's, by the supplier's name; and lines allocated twice.
    "split_base": "SELECT s.*, replace(s.rfq_id, 'RFQ-', 'Q-') || replace(s.supplier_id, 'S-', '-') AS quote, supplier_name FROM {submitted} s LEFT JOIN {suppliers} u ON u.supplier_id = s.supplier_id",
    "award_splits": """
        SELECT rfq_id, 1 AS alloc_no, rfq_line_id, 1 AS split_no, supplier_id, CASE WHEN length(rfq_line_id) % 2 = 0 THEN quote END AS quote_id, allocated_qty, unit_cost FROM {split_base}
        UNION ALL SELECT rfq_id, 1, rfq_line_id, 2, NULL, quote, '2', NULL FROM {split_base} WHERE rfq_id LIKE '%1'
        UNION ALL SELECT rfq_id, 1, rfq_line_id, 3, supplier_id, 'Q-other', '1', NULL FROM {split_base} WHERE rfq_id LIKE '%2'
        UNION ALL SELECT rfq_id, 1, rfq_line_id, 4, supplier_name, quote, '1.5', NULL FROM {split_base} WHERE rfq_id LIKE '%3'
        UNION ALL SELECT rfq_id, 2, rfq_line_id, 1, supplier_id, '', '4', NULL FROM {split_base} WHERE rfq_id LIKE '%4'
        UNION ALL SELECT rfq_id, 2, rfq_line_id, 2, quote, NULL, '5', NULL FROM {split_base} WHERE rfq_id LIKE '%4'""",
    "o_splits_checked": """
        SELECT rfq_id, rfq_line_id, alloc_no, split_no, error, CASE WHEN ok THEN bid.supplier_id END AS supplier_id, CASE WHEN ok THEN bid.quote_id END AS quote_id, CASE WHEN ok THEN qty END AS qty,
               CASE WHEN ok THEN cast(round(qty::DECIMAL(20,4) * bid.unit_cost, 2) AS DECIMAL(18,2)) END AS split_value FROM (SELECT *, error IS NULL AND qty > 0 AS ok FROM (
        SELECT *, CASE WHEN line IS NULL THEN 'UNKNOWN_LINE' WHEN alloc_no > first THEN 'DUPLICATE_LINE' WHEN qty IS NULL THEN 'MALFORMED_QUANTITY' WHEN qty < 0 THEN 'NEGATIVE_QUANTITY' WHEN qty = 0 THEN NULL
          WHEN bid.supplier_id IS NULL THEN 'NO_ELIGIBLE_BID' WHEN bid.status = 'INACTIVE' THEN 'INACTIVE_SUPPLIER' WHEN unit_cost IS NOT NULL AND asked IS NULL THEN 'MALFORMED_PRICE' WHEN abs(asked - bid.unit_cost) > 0.01 THEN 'PRICE_DIFFERS' END AS error
        FROM (SELECT x.*, CASE WHEN x.s.supplier_id IS NOT NULL THEN CASE WHEN coalesce(x.quote_id, '') IN ('', x.s.quote_id, x.s.supplier_id) THEN x.s END WHEN x.q.supplier_id IS NOT NULL AND coalesce(x.supplier_id, '') IN ('', x.q.supplier_id, x.q.quote_id, x.q.supplier_name) THEN x.q END AS bid
        FROM (SELECT p.*, r.rfq_line_id AS line, min(alloc_no) OVER (PARTITION BY p.rfq_id, p.rfq_line_id) AS first, try_cast(allocated_qty AS DECIMAL(18,4)) AS qty, try_cast(p.unit_cost AS DECIMAL(18,4)) AS asked, s, q
        FROM {award_splits} p LEFT JOIN {rfq_lines} r ON r.rfq_id = p.rfq_id AND r.rfq_line_id = p.rfq_line_id
        LEFT JOIN {o_named_bids} s ON s.rfq_line_id = p.rfq_line_id AND (s.supplier_id = p.supplier_id OR s.quote_id = p.supplier_id) LEFT JOIN {o_named_bids} q ON q.rfq_line_id = p.rfq_line_id AND q.quote_id = p.quote_id) x)))""",
    "o_named_bids": "SELECT b.rfq_id, b.rfq_line_id, b.supplier_id, b.quote_id, b.unit_cost, supplier_name, status FROM {o_bids} b LEFT JOIN {suppliers} u ON u.supplier_id = b.supplier_id",
    "o_split_errors": "SELECT DISTINCT rfq_id, rfq_line_id, alloc_no, CASE WHEN error NOT IN ('UNKNOWN_LINE', 'DUPLICATE_LINE') THEN split_no END AS split_no, error FROM {o_splits_checked} WHERE error IS NOT NULL",
    "o_split_states": """
        SELECT *, CASE WHEN allocated > required THEN 'OVER_ALLOCATED' WHEN allocated = required AND required > 0 THEN 'FULLY_ALLOCATED' WHEN allocated > 0 THEN 'PARTIALLY_ALLOCATED' ELSE 'UNALLOCATED' END AS state, greatest(required - allocated, 0)::DECIMAL(18,4) AS unallocated
        FROM (SELECT r.rfq_id, r.rfq_line_id, coalesce(any_value(requested_quantity), 0)::DECIMAL(18,4) AS required, coalesce(sum(qty), 0)::DECIMAL(18,4) AS allocated, coalesce(sum(split_value), 0)::DECIMAL(18,2) AS value
        FROM {rfq_lines} r LEFT JOIN {o_splits_checked} c ON c.rfq_id = r.rfq_id AND c.rfq_line_id = r.rfq_line_id GROUP BY 1, 2)""",
    "catalog_items": """
        SELECT internal_item_id, internal_sku, canonical_description, import_batch_id, status FROM {item_master} UNION ALL
        SELECT 'ITEM-N' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN lower(p_brand || '-' || p_partkey) ELSE 'NEW-' || s_suppkey END, s_name, 'IMP-' || (s_suppkey % 4), 'ACTIVE' FROM {supplier} JOIN {part} ON p_partkey = s_suppkey""",
    "delete_requests": "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'item-n' || s_suppkey WHEN 1 THEN 'new-' || s_suppkey WHEN 2 THEN 'ITEM-' || s_suppkey ELSE 'nothing ' || s_suppkey END AS key FROM {supplier}",
    "o_uses": """
        SELECT 'RFQ' AS kind, rfq_id AS owner, internal_item_id, sku FROM {rfq_lines} UNION ALL SELECT 'QUOTE', quote_id, matched_item, NULL FROM {o_exact}
        UNION ALL SELECT 'COMPARISON', p.rfq_id, internal_item_id, sku FROM {o_prices} p JOIN {rfq_lines} r ON r.rfq_line_id = p.rfq_line_id
        UNION ALL SELECT 'AWARD', p.rfq_id, internal_item_id, sku FROM {o_propose_optimal} p JOIN {rfq_lines} r ON r.rfq_line_id = p.rfq_line_id WHERE supplier_id IS NOT NULL""",
    "o_used": """
        SELECT i.internal_item_id, i.internal_sku, count(DISTINCT owner) FILTER (WHERE kind = 'RFQ') AS n_rfq, count(DISTINCT owner) FILTER (WHERE kind = 'QUOTE') AS n_quote, count(DISTINCT owner) FILTER (WHERE kind = 'COMPARISON') AS n_comparison,
               count(DISTINCT owner) FILTER (WHERE kind = 'AWARD') AS n_award, count(DISTINCT kind || ' ' || owner) AS n_references
        FROM {catalog_items} i LEFT JOIN (SELECT kind, owner, i.internal_item_id FROM {o_uses} u JOIN {catalog_items} i ON u.internal_item_id = i.internal_item_id
          UNION ALL SELECT kind, owner, i.internal_item_id FROM {o_uses} u JOIN {catalog_items} i ON upper(u.sku) = upper(i.internal_sku)) u ON u.internal_item_id = i.internal_item_id GROUP BY 1, 2""",
    "o_undo": "SELECT i.import_batch_id, u.*, CASE WHEN n_references > 0 THEN 'DEACTIVATE' ELSE 'DELETE' END AS action FROM {catalog_items} i JOIN {o_used} u ON u.internal_item_id = i.internal_item_id WHERE import_batch_id IS NOT NULL",
    "o_price_issues": "SELECT rfq_id, supplier_id, unnest(issues) AS code FROM {o_prices}",
}


def splits_checked(t):
    return t.once("splits_checked", lambda: allocations.check_splits(t.award_splits, t.rfq_lines, bids(t), t.suppliers))


def used(t):
    """What uses the items of the catalogue: lines asked for, lines matched, lines compared, lines awarded."""
    lines = t.rfq_lines.select("rfq_line_id", "internal_item_id", "sku")
    of = lambda kind, rows, owner: rows.select(F.lit(kind).alias("kind"), F.col(owner).alias("owner"), "internal_item_id", "sku")
    matched = t.exact().withColumns({"internal_item_id": F.col("matched_item"), "sku": F.lit(None).cast("string")})
    uses = of("RFQ", t.rfq_lines, "rfq_id").union(of("QUOTE", matched, "quote_id"))
    compared = of("COMPARISON", t.prices().select("rfq_id", "rfq_line_id").distinct().join(lines, "rfq_line_id"), "rfq_id")
    awarded = of("AWARD", proposal(t).where("supplier_id IS NOT NULL").join(lines, "rfq_line_id"), "rfq_id")
    # Read by id and by SKU; a row or two for each RFQ line.
    uses = uses.union(t.once("compared", lambda: compared.union(awarded)))
    return t.once("used", lambda: catalog.dependencies(t.catalog_items, uses))


@query("check_splits", "SELECT * FROM {o_splits_checked}")
def check_splits(t):
    return splits_checked(t)


@query("split_errors", "SELECT * FROM {o_split_errors}")
def split_errors(t):
    return allocations.errors(splits_checked(t))


@query("split_states", "SELECT * FROM {o_split_states}")
def split_states(t):
    return award.allocation_states(splits_checked(t), t.rfq_lines)


@query("split_gate", """
SELECT s.rfq_id, n_over, n_open, coalesce(n_errors, 0) AS n_errors, CASE WHEN coalesce(n_errors, 0) > 0 OR n_over > 0 THEN 'REJECTED' WHEN n_open > 0 THEN 'NEEDS_ACKNOWLEDGEMENT' ELSE 'FINALIZED' END AS gate
FROM (SELECT rfq_id, count(*) FILTER (WHERE state = 'OVER_ALLOCATED') AS n_over, count(*) FILTER (WHERE unallocated > 0) AS n_open FROM {o_split_states} GROUP BY rfq_id) s LEFT JOIN (SELECT rfq_id, count(*) AS n_errors FROM {o_split_errors} GROUP BY rfq_id) e ON e.rfq_id = s.rfq_id""")
def split_gate(t):
    rows = splits_checked(t)
    return award.finalise_gate(award.allocation_states(rows, t.rfq_lines), allocations.errors(rows))


WARNED = "SELECT '{0}' AS scenario, *, n_unallocated > 0 AS has_unallocated, CASE WHEN n_unallocated > 0 THEN 'UNALLOCATED_QUANTITIES' END AS warning FROM (SELECT rfq_id, sum(line_value)::DECIMAL(18,2) AS total_value, count(*) AS n_required, count(*) FILTER (WHERE allocation_state = 'FULLY_ALLOCATED') AS n_full, count(*) FILTER (WHERE allocation_state = 'NOT_QUOTED') AS n_not_quoted, count(*) FILTER (WHERE allocation_state <> 'FULLY_ALLOCATED') AS n_unallocated FROM {{{1}}} GROUP BY rfq_id)"


@query("proposal_warnings", WARNED.format("SINGLE_SUPPLIER_L1", "o_propose_single") + " UNION ALL " + WARNED.format("LINE_ITEM_OPTIMAL", "o_propose_optimal"))
def proposal_warnings(t):
    one, two = (allocations.proposal_warnings(proposal(t, s)).withColumn("scenario", F.lit(s)) for s in ("SINGLE_SUPPLIER_L1", "LINE_ITEM_OPTIMAL"))
    return one.unionByName(two)


@query("eligibility_issues", """
SELECT s.rfq_id, s.supplier_id, scope, CASE WHEN scope = 'PARTIAL' THEN 'PARTIAL_SCOPE' ELSE reasons END AS reasons FROM (
SELECT rfq_id, supplier_id, CASE WHEN NOT fully_comparable AND comparable_items > 0 THEN 'PARTIAL' WHEN comparable_items = 0 OR total_base IS NULL OR exchange_rate IS NULL OR codes IS NOT NULL THEN 'INELIGIBLE' ELSE 'ELIGIBLE' END AS scope,
  concat_ws(',', CASE WHEN comparable_items = 0 THEN 'ZERO_COMPARABLE' END, CASE WHEN total_base IS NULL THEN 'NO_TOTAL' END, CASE WHEN exchange_rate IS NULL THEN 'NO_EXCHANGE_RATE' END, codes) AS reasons
FROM {o_supplier} LEFT JOIN (SELECT rfq_id, supplier_id, string_agg(DISTINCT 'BLOCKING_ISSUE:' || code, ',' ORDER BY 'BLOCKING_ISSUE:' || code) AS codes FROM {o_price_issues} GROUP BY 1, 2) c USING (rfq_id, supplier_id)) s""")
def eligibility_issues(t):
    rows = ranking.eligibility(t.supplier_totals(), commercial.price_issues(t.prices()))
    return rows.select("rfq_id", "supplier_id", "scope", F.array_join("reasons", ",").alias("reasons"))


@query("item_dependencies", "SELECT * FROM {o_used}")
def item_dependencies(t):
    return used(t)


@query("preview_undo", "SELECT * FROM {o_undo}")
def preview_undo(t):
    return catalog.preview_undo(t.catalog_items, used(t))


@query("preview_undo_counts", "SELECT import_batch_id, count(*) AS total_items, count(*) FILTER (WHERE action = 'DELETE') AS can_delete, count(*) FILTER (WHERE action = 'DEACTIVATE') AS must_deactivate FROM {o_undo} GROUP BY 1")
def preview_undo_counts(t):
    return catalog.undo_counts(catalog.preview_undo(t.catalog_items, used(t)))


@query("catalog_undone", "SELECT i.internal_item_id, i.internal_sku, canonical_description, i.import_batch_id, CASE WHEN i.import_batch_id IN ('IMP-0', 'IMP-3') THEN 'INACTIVE' ELSE status END AS status FROM {catalog_items} i JOIN {o_used} u ON u.internal_item_id = i.internal_item_id WHERE n_references > 0 OR i.import_batch_id IS NULL OR i.import_batch_id NOT IN ('IMP-0', 'IMP-3')")
def catalog_undone(t):
    batches = t.catalog_items.where("import_batch_id IN ('IMP-0', 'IMP-3')")
    return catalog.undone(t.catalog_items, catalog.preview_undo(t.catalog_items, used(t)), batches)


@query("guarded_delete", "SELECT DISTINCT key, internal_item_id, CASE WHEN internal_item_id IS NULL THEN 'NOT_FOUND' WHEN n_references > 0 THEN 'BLOCKED' ELSE 'DELETED' END AS outcome, n_references FROM {delete_requests} LEFT JOIN {o_used} ON upper(key) IN (upper(internal_item_id), upper(internal_sku))")
def guarded_delete(t):
    return catalog.guarded_delete(t.catalog_items, used(t), t.delete_requests)
