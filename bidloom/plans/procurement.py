"""Queries of matching, awards, master data, reviews and state, and their DuckDB SQL."""

from pyspark.sql import functions as F

from bidloom.functions import text
from bidloom.operators import award, master, matching
from bidloom.plans.commercial import Tables
from bidloom.sources.domain import VIEWS, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql(oracle)
        return f

    return keep


CODE = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
VIEWS |= {
    "o_codes": " UNION ALL ".join(f"SELECT internal_item_id, master_pos, {CODE.format(c)} AS code, {i} AS kind_rank, '{k}' AS kind FROM {{item_master}} WHERE status = 'ACTIVE'" for i, (c, k) in enumerate((("supplier_part_number", "SUPPLIER_SKU_EXACT"), ("manufacturer_part_number", "MANUFACTURER_PN_EXACT"), ("internal_sku", "INTERNAL_SKU_EXACT")))),
    "o_exact": f"""
        SELECT q.*, m.internal_item_id AS matched_item, coalesce(m.kind, 'NO_MATCH') AS match_method FROM (SELECT *, {CODE.format("part_number")} AS code FROM {{quote_lines}}) q
        LEFT JOIN (SELECT * FROM {{o_codes}} QUALIFY row_number() OVER (PARTITION BY code ORDER BY master_pos, kind_rank) = 1) m ON m.code = q.code""",
    "o_names": "SELECT DISTINCT p_name AS name FROM {part}",
    "o_bids": """
        SELECT rfq_id, rfq_line_id, supplier_id, quote_id, unit_landed_base AS unit_cost, quoted_qty, quoted_uom, row_number() OVER (PARTITION BY rfq_line_id ORDER BY unit_landed_base, supplier_id) = 1 AS is_l1_for_line
        FROM {o_prices} WHERE is_comparable AND unit_landed_base > 0""",
    "submitted": """
        SELECT rfq_id, CASE WHEN k % 23 = 0 THEN 'L-x' || k ELSE rfq_line_id END AS rfq_line_id, CASE WHEN k % 29 = 0 THEN 'S-none' ELSE supplier_id END AS supplier_id,
               CASE WHEN k % 13 = 0 THEN '-5' WHEN k % 17 = 0 THEN 'ten' WHEN k % 19 = 0 THEN '0' WHEN k % 7 = 0 THEN '5' WHEN k % 11 = 0 THEN '9999' ELSE cast(coalesce(requested_quantity, 0) AS varchar(40)) END AS allocated_qty,
               CASE WHEN k % 31 = 0 THEN 'cheap' WHEN k % 5 = 0 THEN '0.0100' END AS unit_cost
        FROM (SELECT r.rfq_id, r.rfq_line_id, r.requested_quantity, q.supplier_id, q.item_key AS k, row_number() OVER (PARTITION BY r.rfq_line_id ORDER BY q.supplier_id) AS nth
              FROM {rfq_lines} r JOIN {quote_lines} q ON r.rfq_line_id = 'L-' || q.item_key) x WHERE nth = 1""",
    "o_checked": """
        SELECT rfq_id, rfq_line_id, supplier_id, error, CASE WHEN error IS NULL THEN q END AS qty, CASE WHEN error IS NULL THEN cast(round(q::DECIMAL(20,4) * price, 2) AS DECIMAL(18,2)) END AS split_value FROM (
        SELECT *, CASE WHEN line IS NULL THEN 'UNKNOWN_LINE' WHEN q IS NULL THEN 'MALFORMED_QUANTITY' WHEN q < 0 THEN 'NEGATIVE_QUANTITY' WHEN q = 0 THEN 'ZERO_QUANTITY' WHEN price IS NULL THEN 'NO_ELIGIBLE_BID'
          WHEN status = 'INACTIVE' THEN 'INACTIVE_SUPPLIER' WHEN unit_cost IS NOT NULL AND p IS NULL THEN 'MALFORMED_PRICE' WHEN abs(p - price) > 0.01 THEN 'PRICE_DIFFERS' END AS error
        FROM (SELECT s.*, r.rfq_line_id AS line, b.unit_cost AS price, u.status, try_cast(s.allocated_qty AS DECIMAL(18,4)) AS q, try_cast(s.unit_cost AS DECIMAL(18,4)) AS p
        FROM {submitted} s LEFT JOIN {rfq_lines} r ON r.rfq_id = s.rfq_id AND r.rfq_line_id = s.rfq_line_id LEFT JOIN {o_bids} b ON b.rfq_line_id = s.rfq_line_id AND b.supplier_id = s.supplier_id LEFT JOIN {suppliers} u ON u.supplier_id = s.supplier_id))""",
    "o_states": """
        SELECT *, CASE WHEN allocated > required THEN 'OVER_ALLOCATED' WHEN allocated = required AND required > 0 THEN 'FULLY_ALLOCATED' WHEN allocated > 0 THEN 'PARTIALLY_ALLOCATED' ELSE 'UNALLOCATED' END AS state, greatest(required - allocated, 0)::DECIMAL(18,4) AS unallocated
        FROM (SELECT r.rfq_id, r.rfq_line_id, coalesce(r.requested_quantity, 0)::DECIMAL(18,4) AS required, coalesce(c.allocated, 0)::DECIMAL(18,4) AS allocated, coalesce(c.value, 0)::DECIMAL(18,2) AS value FROM {rfq_lines} r
        LEFT JOIN (SELECT rfq_id, rfq_line_id, sum(qty) AS allocated, sum(split_value) AS value FROM {o_checked} GROUP BY 1, 2) c ON c.rfq_id = r.rfq_id AND c.rfq_line_id = r.rfq_line_id)""",
    "o_gate": """
        SELECT s.rfq_id, n_over, n_open, coalesce(n_errors, 0) AS n_errors, CASE WHEN coalesce(n_errors, 0) > 0 OR n_over > 0 THEN 'REJECTED' WHEN n_open > 0 THEN 'NEEDS_ACKNOWLEDGEMENT' ELSE 'FINALIZED' END AS gate
        FROM (SELECT rfq_id, count(*) FILTER (WHERE state = 'OVER_ALLOCATED') AS n_over, count(*) FILTER (WHERE unallocated > 0) AS n_open FROM {o_states} GROUP BY rfq_id) s
        LEFT JOIN (SELECT rfq_id, count(*) AS n_errors FROM {o_checked} WHERE error <> 'ZERO_QUANTITY' GROUP BY rfq_id) e ON e.rfq_id = s.rfq_id""",
    "o_coverage": """
        SELECT *, round(n_matched * 100.0::DOUBLE / n_lines, 1) AS coverage_pct, CASE WHEN n_review > 0 THEN 'REVIEW' WHEN n_matched = n_lines THEN 'COMPLETE' ELSE 'PARTIAL' END AS state
        FROM (SELECT m.rfq_id, m.quote_id, count(DISTINCT CASE WHEN match_status <> 'REVIEW_REQUIRED' THEN rfq_line_id END) AS n_matched, count(DISTINCT CASE WHEN match_status = 'REVIEW_REQUIRED' THEN rfq_line_id END) AS n_review, any_value(n_lines) AS n_lines
        FROM {matches} m JOIN {rfqs} r ON r.rfq_id = m.rfq_id GROUP BY m.rfq_id, m.quote_id)""",
}
for scenario, wanted in (("single", "b.supplier_id = l.l1"), ("optimal", "b.is_l1_for_line")):
    VIEWS[f"o_propose_{scenario}"] = f"""
        SELECT r.rfq_id, r.rfq_line_id, r.requested_quantity, b.supplier_id, b.quote_id, b.unit_cost, b.is_l1_for_line, CASE WHEN b.supplier_id IS NULL THEN 'NOT_QUOTED' WHEN r.requested_quantity IS NOT NULL THEN 'FULLY_ALLOCATED' ELSE 'UNALLOCATED' END AS allocation_state,
               coalesce(cast(round(r.requested_quantity::DECIMAL(20,4) * b.unit_cost, 2) AS DECIMAL(18,2)), 0)::DECIMAL(18,2) AS line_value
        FROM {{rfq_lines}} r LEFT JOIN (SELECT b.* FROM {{o_bids}} b LEFT JOIN (SELECT rfq_id, supplier_id AS l1 FROM {{o_ranked}} WHERE rank = 1) l ON l.rfq_id = b.rfq_id
          QUALIFY row_number() OVER (PARTITION BY b.rfq_line_id ORDER BY CASE WHEN {wanted} THEN 0 ELSE 1 END, b.supplier_id) = 1) b ON b.rfq_line_id = r.rfq_line_id"""


def bids(t):
    return award.bids(t.prices())


def proposal(t, scenario="LINE_ITEM_OPTIMAL"):
    return award.propose(t.rfq_lines, bids(t), t.ranked(), scenario)


def checked(t):
    return t.once("checked", lambda: award.validate(t.submitted, t.rfq_lines, bids(t), t.suppliers))


def gates(t):
    return t.once("gates", lambda: award.finalise_gate(award.allocation_states(checked(t), t.rfq_lines), checked(t)))


@query("exact_match", "SELECT quote_id, line_index, matched_item, match_method FROM {o_exact}")
def exact_match(t):
    return t.exact().select("quote_id", "line_index", "matched_item", "match_method")


@query("bind_rfq_line", f"SELECT e.quote_id, e.line_index, arg_min(r.rfq_line_id, (r.line_pos, r.rfq_line_id)) AS rfq_line_id FROM {{o_exact}} e JOIN {{rfq_lines}} r ON r.rfq_id = e.rfq_id AND (r.internal_item_id = e.matched_item OR {CODE.format('r.sku')} = e.code) GROUP BY 1, 2")
def bind_rfq_line(t):
    return matching.bind_rfq_line(t.exact(), t.rfq_lines)


TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
VIEWS["o_signals"] = f"""
SELECT a.name AS quoted, b.name AS known, len(list_intersect({TOKENS.format("a.name")}, {TOKENS.format("b.name")}))::DOUBLE / (len({TOKENS.format("a.name")}) + len({TOKENS.format("b.name")}) - len(list_intersect({TOKENS.format("a.name")}, {TOKENS.format("b.name")}))) AS jaccard,
  0.5::DOUBLE AS spec_score, CASE WHEN contains(lower(a.name), lower(split_part(b.name, ' ', 1))) THEN 1.0 ELSE 0.5 END::DOUBLE AS brand_score FROM {{o_names}} a, {{o_names}} b"""
VIEWS["o_token_sort"] = """
SELECT quoted, known, 2 * prev[len(prev)] / (length(a) + length(b))::DOUBLE AS token_sort FROM (
WITH RECURSIVE step AS (
  SELECT x.name AS quoted, y.name AS known, array_to_string(list_sort(string_split(lower(x.name), ' ')), ' ') AS a, array_to_string(list_sort(string_split(lower(y.name), ' ')), ' ') AS b, 0 AS k,
         list_transform(range(length(y.name)), lambda z: 0::BIGINT) AS prev, []::BIGINT[] AS cur FROM {o_names} x, {o_names} y
  UNION ALL
  SELECT quoted, known, a, b, k + 1, CASE WHEN k % length(b) = length(b) - 1 THEN list_append(cur, v) ELSE prev END, CASE WHEN k % length(b) = length(b) - 1 THEN []::BIGINT[] ELSE list_append(cur, v) END
  FROM (SELECT *, CASE WHEN substr(a, 1 + k // length(b), 1) = substr(b, 1 + k % length(b), 1) THEN coalesce(prev[k % length(b)], 0) + 1 ELSE greatest(prev[1 + k % length(b)], coalesce(cur[k % length(b)], 0)) END AS v
        FROM step WHERE k < length(a) * length(b)))
SELECT * FROM step WHERE k = length(a) * length(b))"""


def name_pairs(t):
    """All pairs of the distinct part names: a few dozen values whatever the size of the table."""
    names = t.part.select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("quoted")).join(names.select(F.col("p_name").alias("known")))
    return matching.signals(pairs.withColumn("brand", F.split("known", " ")[0]), "quoted", "known", "brand").drop("brand")


@query("match_signals", "SELECT * FROM {o_signals}")
def match_signals(t):
    return name_pairs(t)


@query("token_sort_ratio", "SELECT * FROM {o_token_sort}")
def token_sort_ratio(t):
    return matching.composite(name_pairs(t), "quoted", "known").select("quoted", "known", "token_sort")


VIEWS["o_scored"] = "SELECT s.quoted, s.known, round(0.40::DOUBLE * token_sort + 0.25::DOUBLE * jaccard + 0.20::DOUBLE * spec_score + 0.15::DOUBLE * brand_score, 3) AS score FROM {o_signals} s JOIN {o_token_sort} k ON k.quoted = s.quoted AND k.known = s.known"


@query("top_candidates", """
SELECT quoted, known, score, place, coalesce(amb, false) AS ambiguous, CASE WHEN amb THEN 'REVIEW_REQUIRED' WHEN score >= 0.88 THEN 'HIGH_CONFIDENCE_MATCH' WHEN score >= 0.70 THEN 'REVIEW_REQUIRED' ELSE 'UNMATCHED' END AS status
FROM (SELECT *, place = 1 AND score >= 0.70 AND round(score - nxt, 3) < 0.08 AS amb FROM (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM {o_scored} WINDOW w AS (PARTITION BY quoted ORDER BY score DESC, known))) WHERE place <= 5""")
def top_candidates(t):
    return matching.top_candidates(matching.composite(name_pairs(t), "quoted", "known").select("quoted", "known", "score"), ["quoted"], "known")


SPECS = text.SPECS.replace("'", "''")
VIEWS["o_texts"] = f"""
SELECT *, array_to_string(list_sort(list_filter(string_split(t, ' '), lambda x: x <> '')), ' ') AS line, list_distinct(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS words, list_distinct(regexp_extract_all(t, '{SPECS}')) AS specs
FROM (SELECT DISTINCT lower(raw_description) AS t, NULL AS brand FROM {{o_exact}} WHERE match_method = 'NO_MATCH' UNION ALL SELECT DISTINCT lower(canonical_description), brand FROM {{item_master}} WHERE status = 'ACTIVE')"""
# Common subsequences with a bit for each character of the quoted text.
VIEWS["o_subsequences"] = """
SELECT q.t AS quoted, c.t AS known, c.brand, length(q.line) - bit_count(list_reduce(list_transform(string_split(c.line, ''), lambda x: coalesce(q.masks[x], 0::HUGEINT)), lambda r, m: ((r + (r & m)) | (r - (r & m))) & q.every, q.every)) AS common,
       length(q.line) + length(c.line) AS chars, len(list_intersect(q.words, c.words)) AS shared, len(q.words) + len(c.words) AS n_words, q.specs AS qs, c.specs AS cs, contains(q.t, lower(c.brand)) AS named
FROM (SELECT t, any_value(line) AS line, any_value(words) AS words, any_value(specs) AS specs, map_from_entries(list((x, mask))) AS masks, ((1::HUGEINT << length(any_value(line))) - 1) AS every
      FROM (SELECT t, line, words, specs, x, bit_or(1::HUGEINT << (i - 1)) AS mask FROM (SELECT *, unnest(string_split(line, '')) AS x, unnest(range(1, length(line) + 1)) AS i FROM {o_texts} WHERE brand IS NULL) GROUP BY ALL) GROUP BY t) q,
     (SELECT * FROM {o_texts} WHERE brand IS NOT NULL) c"""
VIEWS["o_close_texts"] = """
SELECT quoted, known, brand, round(CASE WHEN spec = 0 THEN least(score, 0.65) ELSE score END, 3) AS score FROM (
SELECT *, 0.40::DOUBLE * (2 * common / chars::DOUBLE) + 0.25::DOUBLE * (shared / (n_words - shared)::DOUBLE) + 0.20::DOUBLE * spec + 0.15::DOUBLE * CASE WHEN named THEN 1.0 ELSE 0.5 END AS score FROM (
SELECT *, CASE WHEN len(qs) = 0 OR len(cs) = 0 THEN 0.5 WHEN list_has_all(qs, cs) OR list_has_all(cs, qs) THEN 1.0 WHEN len(list_filter(qs, lambda a: len(list_filter(cs, lambda b: contains(a, b) OR contains(b, a))) = 0)) = 0 THEN 0.85 ELSE 0.0 END::DOUBLE AS spec FROM {o_subsequences}))"""
VIEWS["o_line_candidates"] = """
SELECT quote_id, line_index, internal_item_id, score, place, coalesce(amb, false) AS ambiguous, CASE WHEN amb THEN 'REVIEW_REQUIRED' WHEN score >= 0.88 THEN 'HIGH_CONFIDENCE_MATCH' WHEN score >= 0.70 THEN 'REVIEW_REQUIRED' ELSE 'UNMATCHED' END AS status
FROM (SELECT *, place = 1 AND score >= 0.70 AND round(score - nxt, 3) < 0.08 AS amb FROM (
  SELECT quoted, internal_item_id, score, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM {o_close_texts} c JOIN {item_master} i ON lower(i.canonical_description) = c.known AND i.brand = c.brand AND i.status = 'ACTIVE'
  WHERE score >= 0.62 WINDOW w AS (PARTITION BY quoted ORDER BY score DESC, master_pos, internal_item_id))) x JOIN {o_exact} e ON lower(e.raw_description) = x.quoted AND e.match_method = 'NO_MATCH' WHERE place <= 5"""


@query("line_candidates", "SELECT * FROM {o_line_candidates}")
def line_candidates(t):
    return t.candidates()


@query("award_bids", "SELECT * FROM {o_bids}")
def award_bids(t):
    return bids(t)


@query("propose_single_supplier", "SELECT * FROM {o_propose_single}")
def propose_single(t):
    return proposal(t, "SINGLE_SUPPLIER_L1")


@query("propose_line_optimal", "SELECT * FROM {o_propose_optimal}")
def propose_optimal(t):
    return proposal(t)


@query("proposal_totals", "SELECT rfq_id, sum(line_value)::DECIMAL(18,2) AS total_value, count(*) FILTER (WHERE allocation_state = 'FULLY_ALLOCATED') AS n_full, count(*) FILTER (WHERE allocation_state <> 'FULLY_ALLOCATED') AS n_open, count(DISTINCT supplier_id) AS n_suppliers FROM {o_propose_optimal} GROUP BY rfq_id")
def proposal_totals(t):
    return award.proposal_totals(proposal(t))


@query("validate_allocations", "SELECT * FROM {o_checked}")
def validate(t):
    return award.validate(t.submitted, t.rfq_lines, bids(t), t.suppliers)


@query("allocation_states", "SELECT * FROM {o_states}")
def states(t):
    return award.allocation_states(checked(t), t.rfq_lines)


@query("finalise_gate", "SELECT * FROM {o_gate}")
def gate(t):
    return gates(t)


@query("erp_flat", """
SELECT p.rfq_id, p.rfq_line_id, replace(sku, ',', ';') AS item_sku, replace(description, ',', ';') AS item_description, coalesce(requested_uom, 'PCS') AS required_uom, CASE WHEN p.supplier_id IS NULL THEN 'UNALLOCATED' ELSE replace(coalesce(supplier_name, p.supplier_id), ',', ';') END AS supplier_name,
  coalesce(p.supplier_id, 'N/A') AS supplier_id, CASE WHEN p.supplier_id IS NULL THEN 'N/A' ELSE quote_id END AS quote_id, CASE WHEN p.supplier_id IS NULL THEN '0.00' ELSE unit_cost::VARCHAR END AS unit_landed_cost, CASE WHEN p.supplier_id IS NULL THEN '0.00' ELSE line_value::VARCHAR END AS line_total_value
FROM {o_propose_optimal} p JOIN {rfq_lines} r ON r.rfq_line_id = p.rfq_line_id LEFT JOIN {suppliers} s ON s.supplier_id = p.supplier_id""")
def erp_flat(t):
    return award.erp_flat(proposal(t), t.rfq_lines, t.suppliers)


@query("supplier_summary", "SELECT *, round(value::DOUBLE * 100 / nullif(sum(value::DOUBLE) OVER (PARTITION BY rfq_id), 0), 2)::DECIMAL(9,2) AS share_pct FROM (SELECT rfq_id, supplier_id, count(*) AS n_lines, sum(requested_quantity)::DECIMAL(18,4) AS qty, sum(line_value)::DECIMAL(18,2) AS value FROM {o_propose_optimal} WHERE supplier_id IS NOT NULL GROUP BY 1, 2)")
def supplier_summary(t):
    return award.supplier_summary(proposal(t))


@query("active_items", "SELECT internal_item_id, internal_sku FROM {item_master} WHERE status = 'ACTIVE'")
def active_items(t):
    return t.item_master.where("status = 'ACTIVE'").select("internal_item_id", "internal_sku")


@query("active_suppliers", "SELECT supplier_id, supplier_name, currency FROM {suppliers} WHERE status = 'ACTIVE'")
def active_suppliers(t):
    return t.suppliers.where("status = 'ACTIVE'").select("supplier_id", "supplier_name", "currency")


VIEWS["o_asked"] = "SELECT DISTINCT CASE l_partkey % 3 WHEN 0 THEN lower('ITEM-' || l_partkey) WHEN 1 THEN upper(p_brand || '-' || l_partkey) ELSE 'nothing ' || l_partkey END AS key FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"


@query("lookup_items", "SELECT key, internal_item_id FROM (SELECT a.key, m.internal_item_id, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN upper(m.internal_item_id) = upper(key) THEN 0 ELSE 1 END, m.internal_item_id) AS k FROM {o_asked} a JOIN {item_master} m ON upper(m.internal_item_id) = upper(a.key) OR upper(m.internal_sku) = upper(a.key)) WHERE k = 1")
def lookup_items(t):
    return master.lookup_items(t.item_master, t.o_asked)


VIEWS["new_items"] = "SELECT CASE WHEN s_suppkey % 9 = 0 THEN ' ' WHEN s_suppkey % 2 = 0 THEN p_brand || '-' || p_partkey ELSE 'New-' || (s_suppkey ~/ 4) END AS sku, CASE WHEN s_suppkey % 5 <> 3 THEN 'M' || s_suppkey END AS mpn, CASE WHEN s_suppkey % 3 = 0 THEN 'kg' WHEN s_suppkey % 3 = 1 THEN '' END AS uom, s_name AS description, s_suppkey AS pos FROM {supplier} JOIN {part} ON p_partkey = s_suppkey"
VIEWS["o_new_items"] = "SELECT upper(trim(sku)) AS sku, mpn, upper(nullif(uom, '')) AS uom, description, pos FROM {new_items} WHERE trim(sku) <> '' AND coalesce(description, '') <> ''"


@query("upsert_catalog", """
WITH n AS (SELECT sku, arg_max(mpn, pos) FILTER (WHERE mpn IS NOT NULL) AS mpn, arg_max(uom, pos) FILTER (WHERE uom IS NOT NULL) AS uom, arg_min(description, pos) AS description, min(pos) AS pos FROM {o_new_items} GROUP BY sku)
SELECT internal_item_id, internal_sku AS sku, coalesce(n.mpn, manufacturer_part_number) AS mpn, coalesce(n.uom, stocking_uom) AS uom, canonical_description AS description FROM {item_master} LEFT JOIN n ON n.sku = internal_sku
UNION ALL SELECT printf('ITEM-%03d', (SELECT max(master_pos) FROM {item_master}) + row_number() OVER (ORDER BY pos, sku)), sku, mpn, coalesce(uom, 'PCS'), description FROM n WHERE sku NOT IN (SELECT internal_sku FROM {item_master})""")
def upsert_catalog(t):
    return master.upsert_catalog(t.item_master, t.new_items)


@query("replace_catalog", "SELECT printf('ITEM-%03d', row_number() OVER (ORDER BY pos, sku)) AS internal_item_id, sku, mpn, coalesce(uom, 'PCS') AS uom, description FROM {o_new_items}")
def replace_catalog(t):
    return master.upsert_catalog(t.item_master, t.new_items, "replace")


@query("import_batches", "SELECT import_batch_id, count(*) AS remaining, count(*) FILTER (WHERE status = 'ACTIVE') AS active, count(*) FILTER (WHERE status <> 'ACTIVE') AS inactive FROM {item_master} WHERE import_batch_id IS NOT NULL GROUP BY 1")
def import_batches(t):
    return master.import_batches(t.item_master)


VIEWS["o_refs"] = """
SELECT internal_item_id, count(DISTINCT CASE WHEN kind = 'RFQ' THEN owner END) AS n_rfq, count(DISTINCT CASE WHEN kind = 'QUOTE' THEN owner END) AS n_quote, count(DISTINCT CASE WHEN kind = 'AWARD' THEN owner END) AS n_award FROM (
SELECT internal_item_id, 'RFQ' AS kind, rfq_id AS owner FROM {rfq_lines} UNION ALL SELECT 'ITEM-' || item_key, 'QUOTE', quote_id FROM {matches} UNION ALL SELECT replace(rfq_line_id, 'L-', 'ITEM-'), 'AWARD', rfq_id FROM {o_propose_optimal} WHERE supplier_id IS NOT NULL) GROUP BY 1"""


def references(t):
    return master.item_references(t.rfq_lines, t.matches, proposal(t))


@query("item_references", "SELECT * FROM {o_refs}")
def item_references(t):
    return references(t)


@query("undo_import", "SELECT m.internal_item_id, CASE WHEN r.n_quote > 0 OR r.n_award > 0 THEN 'INACTIVE' ELSE 'DELETE' END AS action FROM {item_master} m LEFT JOIN {o_refs} r ON r.internal_item_id = m.internal_item_id WHERE import_batch_id = 'IMP-1'")
def undo_import(t):
    return master.undo_import(t.item_master, references(t), "IMP-1")


@query("catalog_facets", "SELECT string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands, string_agg(DISTINCT stocking_uom, ',' ORDER BY stocking_uom) AS uoms, count(*) FILTER (WHERE status = 'ACTIVE') AS active, count(*) FILTER (WHERE status <> 'ACTIVE') AS inactive FROM {item_master}")
def catalog_facets(t):
    return master.catalog_facets(t.item_master)


@query("rfq_coverage", "SELECT * FROM {o_coverage}")
def rfq_coverage(t):
    return master.rfq_coverage(t.rfqs, t.matches)


@query("rfq_stage", """
SELECT r.rfq_id, coalesce(nq, 0) AS n_quotes, coalesce(nr, 0) AS n_review, CASE WHEN gate = 'FINALIZED' THEN 'AWARD_FINALIZED' WHEN coalesce(nq, 0) = 0 THEN 'QUOTES_PENDING' WHEN nr > 0 THEN 'MATCHING_REVIEW' WHEN nk > 0 THEN 'EVALUATED' ELSE 'READY_FOR_COMPARISON' END AS stage
FROM {rfqs} r LEFT JOIN (SELECT rfq_id, count(*) AS nq FROM {quotes} GROUP BY 1) q ON q.rfq_id = r.rfq_id LEFT JOIN (SELECT rfq_id, sum(n_review)::BIGINT AS nr FROM {o_coverage} GROUP BY 1) c ON c.rfq_id = r.rfq_id
LEFT JOIN (SELECT rfq_id, count(*) FILTER (WHERE rank < 999) AS nk FROM {o_ranked} GROUP BY 1) k ON k.rfq_id = r.rfq_id LEFT JOIN {o_gate} g ON g.rfq_id = r.rfq_id""")
def rfq_stage(t):
    return master.rfq_stage(t.rfqs, t.quotes, master.rfq_coverage(t.rfqs, t.matches), t.ranked(), gates(t))


VIEWS["decision_log"] = "SELECT user_id AS key, event_id AS id, ts, value, CASE event_type WHEN 'purchase' THEN 'ACCEPT' WHEN 'error' THEN 'REJECT' WHEN 'signup' THEN 'REOPEN' END AS action FROM {events} WHERE event_type IN ('purchase', 'error', 'signup')"


@query("latest_decisions", "SELECT key, arg_max(action, (ts, id)) AS action, max(ts) AS decided_at, count(*) AS n_decisions, arg_max(action, (ts, id)) <> 'REOPEN' AS is_locked FROM {decision_log} GROUP BY key")
def latest_decisions(t):
    return master.latest_decisions(t.decision_log)


@query("decision_history", "SELECT key, id, action, value, row_number() OVER w AS revision, lag(value) OVER w AS previous FROM {decision_log} WINDOW w AS (PARTITION BY key ORDER BY ts, id)")
def decision_history(t):
    return master.history(t.decision_log).select("key", "id", "action", "value", "revision", "previous")


@query("fingerprints", "SELECT rfq_id, sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint, count(*) AS n_rows FROM (SELECT rfq_id, sha256(concat_ws('|', quote_id, line_index::VARCHAR, rfq_line_id, match_status)) AS h FROM {matches}) GROUP BY rfq_id")
def fingerprints(t):
    return master.fingerprints(t.matches)


@query("lifecycle_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE action = 'ACCEPT') AS accepted, count(*) FILTER (WHERE action = 'REJECT') AS rejected, count(*) FILTER (WHERE action = 'REOPEN') AS reopened FROM (SELECT arg_max(action, (ts, id)) AS action FROM {decision_log} GROUP BY key)")
def lifecycle_counts(t):
    return master.latest_decisions(t.decision_log).agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("ACCEPT", "accepted"), ("REJECT", "rejected"), ("REOPEN", "reopened"))])


@query("analytics", "SELECT (SELECT count(*) FROM {rfqs}) AS n_rfqs, (SELECT count(*) FROM {quotes}) AS n_quotes, (SELECT count(DISTINCT currency) FROM {quotes}) AS n_currencies, (SELECT sum(value)::DECIMAL(18,2) FROM {o_states} JOIN {o_gate} USING (rfq_id) WHERE gate = 'FINALIZED') AS finalised_value")
def analytics(t):
    final = award.allocation_states(checked(t), t.rfq_lines).join(gates(t).where("gate = 'FINALIZED'").select("rfq_id"), "rfq_id").agg(F.sum("value").cast("decimal(18,2)").alias("finalised_value"))
    head = t.rfqs.agg(F.count("*").alias("n_rfqs")).join(t.quotes.agg(F.count("*").alias("n_quotes"), F.countDistinct("currency").alias("n_currencies")))
    return head.join(final)
