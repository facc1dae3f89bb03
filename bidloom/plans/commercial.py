"""Queries from units to ranking, and their DuckDB SQL."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import text
from bidloom.operators import candidates, commercial, finance, matching, ranking, uom
from bidloom.sources.domain import VIEWS, sql, table, uses
from bidloom.sources.stage import dealt, stored

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = f, sql(oracle)
        return f

    return keep


def hdiv(a: str, b: str, digits: int) -> str:
    """DuckDB: a / b for decimals that are not negative, rounded half up."""
    n, d = f"cast(({a})::DECIMAL(30, 8) * 100000000 AS HUGEINT)", f"cast(nullif({b}, 0)::DECIMAL(30, 8) * 100000000 AS HUGEINT)"
    return f"cast(cast((2 * {n} * {10**digits} + {d}) // (2 * {d}) AS DECIMAL(30, 0)) * {10**-digits:.{digits}f}::DECIMAL({digits + 1}, {digits}) AS DECIMAL(18, {digits}))"


NET = "cast(round({p} * (100 - discount_pct) * 0.01::DECIMAL(3,2), {d}) AS DECIMAL(18,{d}))"
VIEWS |= {
    "o_amounts": """
        SELECT *, cast(taxable + tax AS DECIMAL(18,2)) AS landed FROM (SELECT *, cast(round(taxable * tax_rate_pct * 0.01::DECIMAL(3,2), 2) AS DECIMAL(18,2)) AS tax
        FROM (SELECT *, cast(gross - discount AS DECIMAL(18,2)) AS taxable FROM (SELECT *, cast(round(gross * discount_pct * 0.01::DECIMAL(3,2), 2) AS DECIMAL(18,2)) AS discount
        FROM (SELECT *, cast(round(quoted_qty * unit_price, 2) AS DECIMAL(18,2)) AS gross FROM {quote_lines}))))""",
    "o_charges": "SELECT *, cast(round(amount + amount * tax_rate_pct * 0.01::DECIMAL(3,2), 2) AS DECIMAL(18,2)) AS total_with_tax FROM {charges}",
    "o_totals": """
        SELECT l.quote_id, lines_total, coalesce(charges_total, 0)::DECIMAL(18,2) AS charges_total, (lines_total + coalesce(charges_total, 0))::DECIMAL(18,2) AS quote_total
        FROM (SELECT quote_id, sum(landed)::DECIMAL(18,2) AS lines_total FROM {o_amounts} GROUP BY quote_id) l
        LEFT JOIN (SELECT quote_id, sum(total_with_tax)::DECIMAL(18,2) AS charges_total FROM {o_charges} GROUP BY quote_id) c ON c.quote_id = l.quote_id""",
    "o_stated": "SELECT quote_id, CASE WHEN length(quote_id) % 3 = 0 THEN NULL WHEN credit_days % 5 = 0 THEN 2000.00 + credit_days ELSE quote_total + 0.25 END::DECIMAL(18,2) AS stated_total FROM {o_totals} JOIN {quotes} USING (quote_id)",
    "o_reconciled": """
        SELECT quote_id, lines_total, charges_total, quote_total, stated_total, (stated_total - quote_total)::DECIMAL(18,2) AS discrepancy,
               CASE WHEN stated_total IS NULL THEN 'CALCULATED_ONLY' WHEN abs(stated_total - quote_total) <= 1 THEN 'RECONCILED' ELSE 'DISCREPANCY' END AS status
        FROM {o_totals} LEFT JOIN {o_stated} USING (quote_id)""",
    "checked_quotes": "SELECT quote_id, CASE WHEN length(quote_id) % 4 = 0 THEN '' ELSE quote_id END AS quote_number, CASE WHEN credit_days % 9 = 0 THEN 'Unknown Supplier' ELSE supplier_name END AS supplier_name, CASE WHEN credit_days % 31 = 30 THEN 0 ELSE n_lines END AS n_lines FROM {quotes}",
    "checked_lines": "SELECT quote_id, line_index, CASE WHEN item_key % 53 = 0 THEN unit_price - unit_price ELSE unit_price END AS unit_price, quoted_qty, CASE WHEN item_key % 47 = 0 THEN 'COIL' ELSE ' ' || lower(quoted_uom) END AS quoted_uom, CASE WHEN item_key % 43 = 0 THEN ' x ' ELSE raw_description END AS raw_description FROM {quote_lines}",
    "o_issues": f"""
        SELECT quote_id, NULL::INT AS line_index, 'SUPPLIER_UNKNOWN' AS code, 'HIGH' AS severity FROM {{checked_quotes}} WHERE coalesce(supplier_name, 'Unknown Supplier') = 'Unknown Supplier'
        UNION ALL SELECT quote_id, NULL, 'QUOTE_NUMBER_MISSING', 'LOW' FROM {{checked_quotes}} WHERE coalesce(quote_number, '') = ''
        UNION ALL SELECT quote_id, NULL, 'NO_LINE_ITEMS', 'CRITICAL' FROM {{checked_quotes}} WHERE coalesce(n_lines, 0) = 0
        UNION ALL SELECT quote_id, line_index, 'UNIT_PRICE_INVALID', 'HIGH' FROM {{checked_lines}} WHERE unit_price <= 0
        UNION ALL SELECT quote_id, line_index, 'QUANTITY_INVALID', 'HIGH' FROM {{checked_lines}} WHERE quoted_qty <= 0
        UNION ALL SELECT quote_id, line_index, 'UOM_NON_STANDARD', 'MEDIUM' FROM {{checked_lines}} WHERE upper(trim(quoted_uom)) NOT IN ({", ".join(f"'{u}'" for u in text.STANDARD_UNITS)})
        UNION ALL SELECT quote_id, line_index, 'SHORT_DESCRIPTION', 'MEDIUM' FROM {{checked_lines}} WHERE length(trim(raw_description)) < 2""",
    "o_qty": f"""
        SELECT *, {hdiv("requested_quantity", "coalesce(uom_factor, 1)", 4)} AS qty_quoted FROM (
        SELECT m.*, CASE WHEN quoted_uom = requested_uom THEN 1 WHEN quoted_uom = 'BOX' AND box_factor IS NOT NULL THEN box_factor
               WHEN s.dimension = t.dimension AND s.rate IS NOT NULL AND t.rate > 0 THEN {hdiv("s.rate", "t.rate", 6)} END::DECIMAL(18,6) AS uom_factor,
               CASE WHEN quoted_uom = requested_uom THEN 'EXACT_UOM_MATCH' WHEN quoted_uom = 'BOX' AND box_factor IS NOT NULL THEN 'ITEM_MASTER_FACTOR'
               WHEN s.dimension = t.dimension AND s.rate IS NOT NULL AND t.rate > 0 THEN 'STANDARD_DIMENSION' ELSE 'INCOMPATIBLE' END AS uom_method
        FROM {{matches}} m LEFT JOIN {{uom_units}} s ON s.unit = quoted_uom LEFT JOIN {{uom_units}} t ON t.unit = requested_uom)""",
    "o_tier": """
        SELECT q.quote_id, q.line_index, min(t.tier_no) AS tier_no, arg_min(t.unit_price, t.tier_no) AS tier_price FROM {o_qty} q JOIN {price_tiers} t ON t.quote_id = q.quote_id AND t.line_index = q.line_index
        AND t.min_qty <= q.qty_quoted AND (t.max_qty IS NULL OR q.qty_quoted <= t.max_qty) GROUP BY q.quote_id, q.line_index""",
    "o_value": "SELECT quote_id, line_index, rfq_id, requested_quantity, cast(round(unit_price * requested_quantity, 2) AS DECIMAL(18,2)) AS value FROM {matches}",
    "o_alloc": f"""
        SELECT quote_id, line_index, coalesce({hdiv("value::DECIMAL(19,2) * charges_total", "whole", 2)}, 0)::DECIMAL(18,2) AS allocated
        FROM (SELECT *, (sum(value) OVER (PARTITION BY quote_id))::DECIMAL(18,2) AS whole FROM {{o_value}}) LEFT JOIN (SELECT quote_id, charges_total FROM {{o_totals}}) USING (quote_id)""",
    "o_alloc_qty": f"""
        SELECT quote_id, line_index, CASE WHEN charges_total > 0 THEN coalesce({hdiv("requested_quantity::DECIMAL(19,4) * charges_total", "whole", 2)}, 0) ELSE 0 END::DECIMAL(18,2) AS allocated
        FROM {{o_value}} JOIN (SELECT rfq_id, sum(requested_quantity)::DECIMAL(18,4) AS whole FROM {{rfq_lines}} GROUP BY rfq_id) USING (rfq_id) LEFT JOIN (SELECT quote_id, charges_total FROM {{o_totals}}) USING (quote_id)""",
}
for suffix, alloc in (("", "0"), ("_value", "coalesce(a.allocated, 0)")):
    join = "LEFT JOIN {o_alloc} a ON a.quote_id = q.quote_id AND a.line_index = q.line_index" if suffix else ""
    VIEWS["o_prices" + suffix] = f"""
        SELECT *, CASE WHEN match_status <> 'REVIEW_REQUIRED' AND len(issues) = 0 THEN true ELSE false END AS is_comparable, match_status = 'REVIEW_REQUIRED' AS is_provisional,
               cast(round(unit_landed::DECIMAL(20,4) * exchange_rate, 4) AS DECIMAL(18,4)) AS unit_landed_base, cast(round(landed::DECIMAL(20,2) * exchange_rate, 2) AS DECIMAL(18,2)) AS line_total_base
        FROM (SELECT *, CASE WHEN asked THEN {hdiv("landed", "requested_quantity", 4)} ELSE 0 END::DECIMAL(18,4) AS unit_landed,
               list_filter([CASE WHEN uom_factor IS NULL THEN 'UOM_INCOMPATIBLE' END, CASE WHEN NOT asked THEN 'QUANTITY_MISMATCH' END,
                 CASE WHEN item_key % 4 = 0 AND asked AND tier_no IS NULL THEN 'TIER_NOT_APPLICABLE' END, CASE WHEN exchange_rate IS NULL THEN 'MISSING_EXCHANGE_RATE' END], lambda x: x IS NOT NULL) AS issues
        FROM (SELECT *, CASE WHEN asked THEN taxable + line_tax + allocated ELSE 0 END::DECIMAL(18,2) AS landed
        FROM (SELECT *, CASE WHEN asked THEN round(taxable * tax_rate_pct * 0.01::DECIMAL(3,2), 2) ELSE 0 END::DECIMAL(18,2) AS line_tax
        FROM (SELECT *, CASE WHEN asked THEN round(net_unit_price * qty_quoted, 2) ELSE 0 END::DECIMAL(18,2) AS taxable
        FROM (SELECT q.*, coalesce(q.requested_quantity > 0, false) AS asked, t.tier_no, coalesce(t.tier_price, q.unit_price) AS unit_price_quoted,
               {NET.format(p="coalesce(t.tier_price, q.unit_price)", d=2)} AS net_unit_price, {alloc}::DECIMAL(18,2) AS allocated, h.currency, f.rate AS exchange_rate,
               coalesce(nullif(q.lead_time_days, 0), h.lead_time_days_default) AS lead_time
        FROM {{o_qty}} q LEFT JOIN {{o_tier}} t ON t.quote_id = q.quote_id AND t.line_index = q.line_index {join}
        JOIN {{quotes}} h ON h.quote_id = q.quote_id LEFT JOIN {{fx_rates}} f ON f.from_cur = h.currency)))))"""
VIEWS |= {
    "o_charge_sums": """
        SELECT c.quote_id, sum(cast(round(amount::DECIMAL(20,2) * rate, 2) AS DECIMAL(18,2)))::DECIMAL(18,2) AS charges_net_base, sum(cast(round((total_with_tax - amount)::DECIMAL(20,2) * rate, 2) AS DECIMAL(18,2)))::DECIMAL(18,2) AS charges_tax_base,
               sum(total_with_tax)::DECIMAL(18,2) AS charges_quoted
        FROM {o_charges} c JOIN {quotes} q ON q.quote_id = c.quote_id LEFT JOIN {fx_rates} f ON f.from_cur = q.currency GROUP BY c.quote_id""",
    "o_supplier": f"""
        SELECT *, CASE WHEN fully_comparable THEN net_base + tax_base + charges_net_base + charges_tax_base END::DECIMAL(18,2) AS total_base, matched_items < rfq_items AS is_incomplete
        FROM (SELECT s.rfq_id, s.supplier_id, s.quote_id, matched_items, comparable_items, q.supplier_name, q.currency, q.credit_days, q.advance_pct, q.lead_time_days_default, f.rate AS exchange_rate, r.n_lines AS rfq_items,
               CASE WHEN f.rate IS NOT NULL THEN coalesce(net_base, 0) END::DECIMAL(18,2) AS net_base, CASE WHEN f.rate IS NOT NULL THEN coalesce(tax_base, 0) END::DECIMAL(18,2) AS tax_base,
               coalesce(charges_net_base, CASE WHEN f.rate IS NOT NULL THEN 0 END)::DECIMAL(18,2) AS charges_net_base, coalesce(charges_tax_base, CASE WHEN f.rate IS NOT NULL THEN 0 END)::DECIMAL(18,2) AS charges_tax_base, charges_quoted,
               f.rate IS NOT NULL AND comparable_items = r.n_lines AS fully_comparable
        FROM (SELECT rfq_id, supplier_id, quote_id, count(*) AS matched_items, count(*) FILTER (WHERE is_comparable) AS comparable_items,
                sum(CASE WHEN is_comparable THEN cast(round(cast({hdiv("net_unit_price::DECIMAL(19,2) * requested_quantity", "coalesce(uom_factor, 1)", 8)} AS DECIMAL(28,8)) * exchange_rate::DECIMAL(10,4), 2) AS DECIMAL(18,2)) END) AS net_base,
                sum(CASE WHEN is_comparable THEN cast(round(line_tax::DECIMAL(20,2) * exchange_rate, 2) AS DECIMAL(18,2)) END) AS tax_base FROM {{o_prices}} GROUP BY rfq_id, supplier_id, quote_id) s
        JOIN {{quotes}} q ON q.quote_id = s.quote_id LEFT JOIN {{fx_rates}} f ON f.from_cur = q.currency JOIN {{rfqs}} r ON r.rfq_id = s.rfq_id LEFT JOIN {{o_charge_sums}} c ON c.quote_id = s.quote_id)""",
    "o_ranked": f"""
        SELECT *, CASE WHEN rank < 999 THEN total_base - l1 END::DECIMAL(18,2) AS delta_to_l1, CASE WHEN rank < 999 THEN coalesce({hdiv("(total_base - l1) * 100", "l1", 2)}, 0) END::DECIMAL(18,2) AS delta_pct_to_l1
        FROM (SELECT *, CASE WHEN scope = 'ELIGIBLE' THEN row_number() OVER (PARTITION BY rfq_id, scope ORDER BY total_base, supplier_id) ELSE 999 END AS rank, min(CASE WHEN scope = 'ELIGIBLE' THEN total_base END) OVER (PARTITION BY rfq_id) AS l1
        FROM (SELECT *, CASE WHEN NOT fully_comparable AND comparable_items > 0 THEN 'PARTIAL' WHEN comparable_items = 0 OR total_base IS NULL OR exchange_rate IS NULL THEN 'INELIGIBLE' ELSE 'ELIGIBLE' END AS scope,
                CASE WHEN NOT fully_comparable AND comparable_items > 0 THEN 'PARTIAL_SCOPE' ELSE concat_ws(',', CASE WHEN comparable_items = 0 THEN 'ZERO_COMPARABLE' END, CASE WHEN total_base IS NULL THEN 'NO_TOTAL' END, CASE WHEN exchange_rate IS NULL THEN 'NO_EXCHANGE_RATE' END) END AS reasons
        FROM {{o_supplier}}))""",
    "o_splits": f"""
        SELECT *, {hdiv("gap * 100", "l2_unit", 2)} AS gap_pct, l1_supplier IS NOT NULL AS is_valid FROM (SELECT *, cast(round(l2_unit - l1_unit, 2) AS DECIMAL(18,2)) AS gap FROM (
        SELECT r.rfq_id, r.rfq_line_id, max(supplier_id) FILTER (WHERE k = 1) AS l1_supplier, max(unit_landed_base) FILTER (WHERE k = 1) AS l1_unit, max(line_total_base) FILTER (WHERE k = 1) AS l1_total,
               max(supplier_id) FILTER (WHERE k = 2) AS l2_supplier, max(unit_landed_base) FILTER (WHERE k = 2) AS l2_unit, max(line_total_base) FILTER (WHERE k = 2) AS l2_total
        FROM {{rfq_lines}} r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY rfq_line_id ORDER BY unit_landed_base, supplier_id) AS k FROM {{o_prices}} WHERE is_comparable AND unit_landed_base IS NOT NULL) p ON p.rfq_line_id = r.rfq_line_id
        GROUP BY r.rfq_id, r.rfq_line_id))""",
}


#: What readers of stored line prices use.
PRICED = [
    "rfq_id", "rfq_line_id", "quote_id", "line_index", "supplier_id", "quoted_qty", "quoted_uom", "requested_quantity", "uom_factor", "net_unit_price", "line_tax",
    "exchange_rate", "unit_landed_base", "line_total_base", "issues", "is_comparable", "is_provisional",
]


class Tables:
    """The domain tables of one run, built on demand. What takes a shuffle of the fact table (``WRITTEN``) is written once
    where a run needs it, dealt by RFQ, and the other views read it there."""

    WRITTEN = ("quote_lines", "quotes")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.given, self.built = spark, sf_dir, {}, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.built:
            for view in self.WRITTEN:
                if view not in self.given and uses(name, view):
                    rows = dealt(table(self.spark, self.sf_dir, view, self.given), view, "rfq_id")
                    self.given[view] = f"{view}_{uuid.uuid4().hex}"
                    rows.createOrReplaceTempView(self.given[view])
            self.built[name] = self.spark.table(self.given[name]) if name in self.given else table(self.spark, self.sf_dir, name, self.given)
        return self.built[name]

    def totals(self) -> DataFrame:
        return finance.quote_totals(self.quote_lines, self.charges)

    def stated(self) -> DataFrame:
        """Totals as a document might state them: none, a wrong one, or one within the tolerance."""
        rows = self.totals().join(self.quotes.select("quote_id", "credit_days"), "quote_id")
        wrong = (2000 + F.col("credit_days")).cast("decimal(18,2)")
        total = F.when(F.length("quote_id") % 3 == 0, None).when(F.col("credit_days") % 5 == 0, wrong).otherwise((F.col("quote_total") + F.lit("0.25").cast("decimal(3,2)")).cast("decimal(18,2)"))
        return rows.select("quote_id", total.alias("stated_total"))

    def reconciled(self) -> DataFrame:
        return finance.reconcile(self.totals(), self.stated())

    def issues(self) -> DataFrame:
        return finance.quote_issues(self.checked_quotes, self.checked_lines, text.STANDARD_UNITS)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What make gives, written when it is first asked for and read from then on."""
        if name not in self.built:
            self.built[name] = stored(make(), name)
        return self.built[name]

    def fresh_prices(self, method: str = "NONE") -> DataFrame:
        allocated = None if method == "NONE" else commercial.allocate_charges(self.matches, self.rfq_lines, self.charges, method)
        return commercial.line_prices(self.matches, self.price_tiers, self.quotes, self.fx_rates, self.uom_units, allocated)

    def prices(self, method: str = "NONE") -> DataFrame:
        """Line prices for readers that go on from them, more than one as a rule: what they read of them."""
        name = f"prices_{method}"
        if name not in self.built:
            self.built[name] = dealt(self.fresh_prices(method).select(*PRICED), name, "rfq_id")
        return self.built[name]

    def exact(self) -> DataFrame:
        return matching.exact_match(self.quote_lines, self.item_master)

    def candidates(self) -> DataFrame:
        return candidates.line_candidates(self.exact(), self.item_master)

    def supplier_totals(self) -> DataFrame:
        return commercial.supplier_totals(self.prices(), self.quotes, self.rfqs, self.charges, self.fx_rates)

    def ranked(self) -> DataFrame:
        return ranking.rank_suppliers(self.supplier_totals())

    def splits(self) -> DataFrame:
        return ranking.split_recs(self.prices(), self.rfq_lines)


@query("line_amounts", "SELECT quote_id, line_index, gross, discount, taxable, tax, landed FROM {o_amounts}")
def line_amounts(spark, sf_dir):
    return finance.line_amounts(Tables(spark, sf_dir).quote_lines).select("quote_id", "line_index", "gross", "discount", "taxable", "tax", "landed")


@query("net_unit_price", f"SELECT quote_id, line_index, {NET.format(p='unit_price', d=4)} AS net_unit_price FROM {{quote_lines}}")
def net_unit_price(spark, sf_dir):
    return finance.net_unit_price(Tables(spark, sf_dir).quote_lines).select("quote_id", "line_index", "net_unit_price")


@query("line_landed_4dp", """
SELECT quote_id, line_index, gross4, net4, tax4, cast(round(net4 + tax4, 2) AS DECIMAL(18,2)) AS landed2 FROM (SELECT *, cast(round(net4 * tax_rate_pct * 0.01::DECIMAL(3,2), 4) AS DECIMAL(18,4)) AS tax4
FROM (SELECT *, cast(round(gross4 * (100 - discount_pct) * 0.01::DECIMAL(3,2), 4) AS DECIMAL(18,4)) AS net4 FROM (SELECT *, cast(round(quoted_qty * unit_price, 4) AS DECIMAL(18,4)) AS gross4 FROM {quote_lines})))""")
def line_landed_4dp(spark, sf_dir):
    return finance.line_landed_4dp(Tables(spark, sf_dir).quote_lines).select("quote_id", "line_index", "gross4", "net4", "tax4", "landed2")


@query("charge_totals", "SELECT quote_id, charge_no, total_with_tax FROM {o_charges}")
def charge_totals(spark, sf_dir):
    return finance.charge_totals(Tables(spark, sf_dir).charges).select("quote_id", "charge_no", "total_with_tax")


@query("quote_totals", "SELECT * FROM {o_totals}")
def quote_totals(spark, sf_dir):
    return Tables(spark, sf_dir).totals()


@query("effective_price", f"""
SELECT q.quote_id, q.line_index, coalesce({NET.format(p='p', d=4)}, {NET.format(p='unit_price', d=4)}) AS effective_price FROM {{quote_lines}} q LEFT JOIN
(SELECT q.quote_id, q.line_index, arg_max(t.unit_price, t.min_qty) AS p FROM {{quote_lines}} q JOIN {{price_tiers}} t ON t.quote_id = q.quote_id AND t.line_index = q.line_index AND t.min_qty <= quoted_qty AND (t.max_qty IS NULL OR quoted_qty <= t.max_qty) GROUP BY 1, 2) t
ON t.quote_id = q.quote_id AND t.line_index = q.line_index""")
def effective_price(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return finance.effective_price(t.quote_lines, t.price_tiers).select("quote_id", "line_index", "effective_price")


@query("first_tier", "SELECT q.quote_id, q.line_index, q.qty_quoted, t.tier_no, t.tier_price, q.item_key % 4 = 0 AS has_tiers FROM {o_qty} q LEFT JOIN {o_tier} t ON t.quote_id = q.quote_id AND t.line_index = q.line_index")
def first_tier(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return finance.first_tier(commercial.quoted_quantity(t.matches, t.uom_units), t.price_tiers, "qty_quoted").select("quote_id", "line_index", "qty_quoted", "tier_no", "tier_price", "has_tiers")


@query("reconcile", "SELECT * FROM {o_reconciled}")
def reconcile(spark, sf_dir):
    return Tables(spark, sf_dir).reconciled()


@query("quote_issues", "SELECT * FROM {o_issues}")
def quote_issues(spark, sf_dir):
    return Tables(spark, sf_dir).issues()


@query("confidence", """
SELECT quote_id, critical, high, medium, low, round(greatest(CASE WHEN critical > 0 THEN least(raw, 0.30) WHEN off THEN least(raw, 0.55) WHEN high > 0 THEN least(raw, 0.65) ELSE raw END, 0.10)::DOUBLE, 2) AS confidence,
  greatest(round(1 - 0.25 * n_header, 2), 0.10)::DOUBLE AS metadata_confidence, greatest(round(1 - 0.15 * n_items, 2), 0.10)::DOUBLE AS line_item_confidence, (CASE WHEN off THEN 0.6 ELSE 1 END)::DOUBLE AS financial_confidence,
  CASE WHEN critical > 0 THEN 'INSUFFICIENT_DATA' WHEN off THEN 'DISCREPANCY' WHEN high > 0 OR medium > 0 THEN 'REVIEW_REQUIRED' ELSE status END AS document_status, critical = 0 AND high = 0 AND NOT off AS is_valid
FROM (SELECT *, 1 - 0.50 * critical - 0.25 * high - 0.10 * medium - 0.05 * low - CASE WHEN off THEN 0.25 ELSE 0 END AS raw FROM (SELECT q.quote_id, r.status, coalesce(r.status, '') = 'DISCREPANCY' AS off, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
  count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) FILTER (WHERE code IN ('SUPPLIER_UNKNOWN', 'QUOTE_NUMBER_MISSING')) AS n_header, count(*) FILTER (WHERE code NOT IN ('SUPPLIER_UNKNOWN', 'QUOTE_NUMBER_MISSING')) AS n_items
FROM {quotes} q LEFT JOIN {o_issues} i ON i.quote_id = q.quote_id LEFT JOIN {o_reconciled} r ON r.quote_id = q.quote_id GROUP BY q.quote_id, r.status))""")
def confidence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return finance.confidence(t.issues(), t.quotes, t.reconciled())


@query("uom_resolution", "SELECT quote_id, line_index, uom_factor, uom_method, qty_quoted FROM {o_qty}")
def uom_resolution(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return commercial.quoted_quantity(t.matches, t.uom_units).select("quote_id", "line_index", "uom_factor", "uom_method", "qty_quoted")


@query("uom_usage", "SELECT u.dimension, q.n_lines, u.n_rates FROM (SELECT dimension, count(rate) AS n_rates FROM {uom_units} GROUP BY dimension) u LEFT JOIN (SELECT dimension, count(*) AS n_lines FROM {quote_lines} JOIN {uom_units} ON unit = quoted_uom GROUP BY dimension) q ON q.dimension = u.dimension")
def uom_usage(spark, sf_dir):
    t = Tables(spark, sf_dir)
    used = t.quote_lines.groupBy(F.col("quoted_uom").alias("unit")).count().join(t.uom_units, "unit").groupBy("dimension").agg(F.sum("count").alias("n_lines"))
    return uom.dimension(t.uom_units).select("dimension", "n_rates").join(used, "dimension", "left").select("dimension", "n_lines", "n_rates")


PRICE = "quote_id, line_index, rfq_line_id, supplier_id, unit_price_quoted, net_unit_price, taxable, line_tax, allocated, landed, unit_landed, exchange_rate, unit_landed_base, line_total_base, is_comparable, is_provisional, lead_time"


@query("line_prices", f"SELECT {PRICE}, array_to_string(issues, ',') AS issues FROM {{o_prices}}")
def line_prices(spark, sf_dir):
    return Tables(spark, sf_dir).fresh_prices().select(*PRICE.split(", "), F.array_join("issues", ",").alias("issues"))


@query("line_prices_allocated", f"SELECT {PRICE} FROM {{o_prices_value}}")
def line_prices_allocated(spark, sf_dir):
    return Tables(spark, sf_dir).fresh_prices("PROPORTIONAL_LINE_VALUE").select(*PRICE.split(", "))


@query("allocate_by_quantity", "SELECT * FROM {o_alloc_qty}")
def allocate_by_quantity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return commercial.allocate_charges(t.matches, t.rfq_lines, t.charges, "PROPORTIONAL_QUANTITY")


@query("allocate_by_value", "SELECT * FROM {o_alloc}")
def allocate_by_value(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return commercial.allocate_charges(t.matches, t.rfq_lines, t.charges, "PROPORTIONAL_LINE_VALUE")


@query("allocate_none", "SELECT quote_id, line_index, 0::DECIMAL(18,2) AS allocated FROM {matches}")
def allocate_none(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return commercial.allocate_charges(t.matches, t.rfq_lines, t.charges, "NONE")


@query("price_issues", "SELECT rfq_id, rfq_line_id, supplier_id, code, CASE WHEN code = 'REVIEW_REQUIRED_ITEM' THEN 'WARNING' ELSE 'BLOCKING' END AS severity FROM (SELECT rfq_id, rfq_line_id, supplier_id, unnest(list_concat(issues, CASE WHEN is_provisional THEN ['REVIEW_REQUIRED_ITEM'] ELSE [] END)) AS code FROM {o_prices})")
def price_issues(spark, sf_dir):
    return commercial.price_issues(Tables(spark, sf_dir).fresh_prices())


VIEWS["o_matrix"] = """
SELECT r.rfq_id, r.rfq_line_id, q.supplier_id, p.unit_landed_base, p.line_total_base, CASE WHEN p.is_comparable IS NULL THEN 'INCOMPLETE_QUOTE' WHEN p.is_comparable THEN 'COMPARABLE' WHEN p.is_provisional THEN 'PROVISIONAL' ELSE 'BLOCKED' END AS cell
FROM {rfq_lines} r JOIN (SELECT DISTINCT rfq_id, supplier_id FROM {quotes}) q ON q.rfq_id = r.rfq_id LEFT JOIN {o_prices} p ON p.rfq_line_id = r.rfq_line_id AND p.supplier_id = q.supplier_id"""


@query("comparison_matrix", "SELECT * FROM {o_matrix}")
def comparison_matrix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return commercial.comparison_matrix(t.rfq_lines, t.quotes, t.fresh_prices())


@query("line_summary", "SELECT rfq_id, rfq_line_id, coalesce(string_agg(supplier_id, ',' ORDER BY supplier_id) FILTER (WHERE cell = 'COMPARABLE'), '') AS comparable, coalesce(string_agg(supplier_id, ',' ORDER BY supplier_id) FILTER (WHERE cell = 'PROVISIONAL'), '') AS provisional, count(*) FILTER (WHERE cell = 'INCOMPLETE_QUOTE') AS n_gaps FROM {o_matrix} GROUP BY rfq_id, rfq_line_id")
def line_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return commercial.line_summary(commercial.comparison_matrix(t.rfq_lines, t.quotes, t.fresh_prices()))


TOTALS = "rfq_id, supplier_id, quote_id, matched_items, comparable_items, rfq_items, net_base, tax_base, charges_net_base, charges_tax_base, charges_quoted, fully_comparable, is_incomplete, total_base"


@query("supplier_totals", f"SELECT {TOTALS} FROM {{o_supplier}}")
def supplier_totals(spark, sf_dir):
    return Tables(spark, sf_dir).supplier_totals().select(*TOTALS.split(", "))


@query("commercial_terms", "SELECT quote_id, string_agg(charge_type || '=' || amount, ',' ORDER BY charge_type) AS by_type, any_value(charges_total) AS charges_total FROM (SELECT quote_id, charge_type, arg_max(total_with_tax, charge_no) AS amount FROM {o_charges} GROUP BY 1, 2) JOIN (SELECT quote_id, sum(total_with_tax)::DECIMAL(18,2) AS charges_total FROM {o_charges} GROUP BY 1) USING (quote_id) GROUP BY quote_id")
def commercial_terms(spark, sf_dir):
    terms = commercial.commercial_terms(Tables(spark, sf_dir).charges)
    listed = F.transform(F.array_sort(F.map_entries("charges_by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return terms.select("quote_id", F.array_join(listed, ",").alias("by_type"), "charges_total")


@query("scope_pct", "SELECT rfq_id, supplier_id, round(100.0 * comparable_items / rfq_items)::INT AS scope_pct FROM {o_supplier}")
def scope_pct(spark, sf_dir):
    return commercial.scope_pct(Tables(spark, sf_dir).supplier_totals())


@query("participants", "SELECT quote_id, rfq_id, supplier_id FROM (SELECT *, bool_or(supplier_status = 'ACTIVE') OVER (PARTITION BY rfq_id) AS any_active FROM {quotes}) WHERE supplier_status = 'ACTIVE' OR NOT any_active")
def participants(spark, sf_dir):
    return commercial.participants(Tables(spark, sf_dir).quotes).select("quote_id", "rfq_id", "supplier_id")


@query("matrix_pivot", "SELECT rfq_line_id, max(line_total_base) FILTER (WHERE supplier_id = 'S-0') AS s0, max(line_total_base) FILTER (WHERE supplier_id = 'S-1') AS s1, max(line_total_base) FILTER (WHERE supplier_id = 'S-2') AS s2 FROM {o_matrix} GROUP BY rfq_line_id")
def matrix_pivot(spark, sf_dir):
    t = Tables(spark, sf_dir)
    wide = commercial.comparison_matrix(t.rfq_lines, t.quotes, t.fresh_prices()).groupBy("rfq_line_id").pivot("supplier_id", ["S-0", "S-1", "S-2"]).agg(F.max("line_total_base"))
    return wide.select("rfq_line_id", *[F.col(f"`S-{i}`").alias(f"s{i}") for i in range(3)])


@query("eligibility", "SELECT rfq_id, supplier_id, scope, reasons FROM {o_ranked}")
def eligibility(spark, sf_dir):
    return ranking.eligibility(Tables(spark, sf_dir).supplier_totals()).select("rfq_id", "supplier_id", "scope", F.array_join("reasons", ",").alias("reasons"))


@query("rank_suppliers", "SELECT rfq_id, supplier_id, total_base, rank, delta_to_l1, delta_pct_to_l1 FROM {o_ranked}")
def rank_suppliers(spark, sf_dir):
    return Tables(spark, sf_dir).ranked().select("rfq_id", "supplier_id", "total_base", "rank", "delta_to_l1", "delta_pct_to_l1")


@query("ranking_remarks", """
SELECT rfq_id, supplier_id, rank, concat_ws(',', CASE WHEN rank = 1 THEN 'LOWEST_COST' END, CASE WHEN credit_days >= 30 THEN 'CREDIT_TERMS' END, CASE WHEN lead_time_days_default <= 7 THEN 'FAST_DELIVERY' END) AS advantages,
concat_ws(',', CASE WHEN rank > 1 THEN 'HIGHER_COST' END, CASE WHEN coalesce(credit_days, 0) < 30 AND advance_pct > 0 THEN 'ADVANCE_PAYMENT' END, CASE WHEN lead_time_days_default > 30 THEN 'LONG_LEAD_TIME' END) AS disadvantages FROM {o_ranked} WHERE rank < 999""")
def ranking_remarks(spark, sf_dir):
    return ranking.remarks(Tables(spark, sf_dir).ranked())


@query("ranking_headline", "SELECT rfq_id, " + ", ".join(f"max({c}) FILTER (WHERE rank = {k}) AS l{k}_{n}" for k in (1, 2, 3) for c, n in (("supplier_id", "supplier"), ("total_base", "total"))) + " FROM {o_ranked} WHERE rank <= 3 GROUP BY rfq_id")
def ranking_headline(spark, sf_dir):
    return ranking.headline(Tables(spark, sf_dir).ranked())


@query("split_recs", "SELECT * FROM {o_splits}")
def split_recs(spark, sf_dir):
    return Tables(spark, sf_dir).splits()


@query("split_savings", """
SELECT s.rfq_id, CASE WHEN all_valid THEN total END AS split_total, l1_total, CASE WHEN all_valid THEN coalesce(greatest(l1_total - total, 0), 0) ELSE 0 END::DECIMAL(18,2) AS savings
FROM (SELECT rfq_id, bool_and(is_valid) AS all_valid, sum(l1_total)::DECIMAL(18,2) AS total FROM {o_splits} GROUP BY rfq_id) s LEFT JOIN (SELECT rfq_id, total_base AS l1_total FROM {o_ranked} WHERE rank = 1) r ON r.rfq_id = s.rfq_id""")
def split_savings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ranking.split_savings(t.splits(), t.ranked())
