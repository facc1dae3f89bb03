"""Golden figures for the commercial chain, on a few rows each."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from bidloom.functions import text
from bidloom.operators import award, commercial, finance, master, matching, ranking, uom
from bidloom.sources.domain import UNITS

LINE = "quote_id string, line_index int, quoted_qty decimal(18,4), unit_price decimal(18,4), discount_pct decimal(9,4), tax_rate_pct decimal(9,4)"


def line(spark, *rows):
    return spark.createDataFrame([(q, i, *(D(str(x)) for x in rest)) for q, i, *rest in rows], LINE)


def test_line_amounts(spark):
    got = finance.net_unit_price(finance.line_amounts(line(spark, ("a", 0, 10, 100, 10, 18)))).first()
    assert (got.net_unit_price, got.landed) == (D("90.0000"), D("1062.00"))
    rows = finance.line_landed_4dp(line(spark, ("a", 0, 20, 450, 5, 18), ("a", 1, 50, 38, 10, 18))).orderBy("line_index").collect()
    assert [(r.net4, r.tax4, r.landed2) for r in rows] == [(D("8550.0000"), D("1539.0000"), D("10089.00")), (D("1710.0000"), D("307.8000"), D("2017.80"))]


def test_quote_total_and_reconciliation(spark):
    lines = line(spark, ("a", 0, 100, 5, 0, 18), ("a", 1, 100, 2, 0, 18))
    charges = spark.createDataFrame([("a", 1, "FREIGHT", D(100), D(18))], "quote_id string, charge_no int, charge_type string, amount decimal(18,2), tax_rate_pct decimal(9,4)")
    totals = finance.quote_totals(lines, charges)
    assert totals.first().quote_total == D("944.00")
    stated = spark.createDataFrame([("a", D("2000.00"))], "quote_id string, stated_total decimal(18,2)")
    assert finance.reconcile(totals, stated).first().status == "DISCREPANCY"


@pytest.mark.parametrize(("qty", "price"), [(10, 150), (100, 120), (500, 95)])
def test_tiers(spark, qty, price):
    tiers = spark.createDataFrame([("a", 0, n, D(lo), hi and D(hi), D(p)) for n, lo, hi, p in ((1, 1, 50, 150), (2, 51, 200, 120), (3, 201, None, 95))], "quote_id string, line_index int, tier_no int, min_qty decimal(18,4), max_qty decimal(18,4), unit_price decimal(18,4)")
    lines = line(spark, ("a", 0, qty, 999, 0, 18))
    assert finance.effective_price(lines, tiers).first().effective_price == D(price)
    assert finance.first_tier(lines, tiers, "quoted_qty").first().tier_price == D(price)


def test_units(spark):
    units = spark.createDataFrame([(unit, kind, D(rate) if rate else None) for kind, some in UNITS.items() for unit, rate in some.items()], "unit string, dimension string, rate decimal(18,6)")
    asked = [("MTR", "FT"), ("FT", "MTR"), ("KG", "PCS"), ("PAIR", "DOZ"), ("PAIR", "PCS"), ("pcs ", "PCS"), ("BOX", "PCS"), (None, "PCS")]
    rows = spark.createDataFrame([(s, t, {"BOX": D(100)}) for s, t in asked], "s string, t string, f map<string,decimal(18,6)>")
    got = {(r.s, r.t): (r.uom_factor, r.uom_method) for r in uom.with_factor(rows, units, "s", "t", "f").collect()}
    assert got["MTR", "FT"] == (D("3.280840"), "STANDARD_DIMENSION") and got["FT", "MTR"][0] == D("0.304800")
    assert got["KG", "PCS"] == (None, "INCOMPATIBLE") and got["PAIR", "DOZ"][0] == D("0.166667") and got["PAIR", "PCS"][0] is None
    assert got["pcs ", "PCS"][1] == "EXACT_UOM_MATCH" and got["BOX", "PCS"] == (D("100.000000"), "ITEM_MASTER_FACTOR") and got[None, "PCS"][1] == "MISSING_UOM"


def test_ranks_and_splits(spark):
    totals = spark.createDataFrame([("r", s, True, 2, D(t), D(1)) for s, t in (("B", "161660"), ("A", "166380"), ("C", "156940"), ("D", "156940"))], "rfq_id string, supplier_id string, fully_comparable boolean, comparable_items int, total_base decimal(18,2), exchange_rate decimal(18,8)")
    ranked = ranking.rank_suppliers(totals)
    assert [r.supplier_id for r in ranked.orderBy("rank").collect()] == ["C", "D", "B", "A"]
    prices = spark.createDataFrame([("r", ln, s, D(u), D(u) * q, True) for ln, q, u1, u2 in (("1", 100, 80, 150), ("2", 300, 300, 180)) for s, u in (("A", u1), ("B", u2))], "rfq_id string, rfq_line_id string, supplier_id string, unit_landed_base decimal(18,4), line_total_base decimal(18,2), is_comparable boolean")
    lines = spark.createDataFrame([("r", "1"), ("r", "2"), ("r", "3")], "rfq_id string, rfq_line_id string")
    splits = {r.rfq_line_id: r for r in ranking.split_recs(prices, lines).collect()}
    assert splits["1"].l1_supplier == "A" and splits["2"].l1_supplier == "B" and splits["1"].gap == D("70.00") and splits["1"].gap_pct == D("46.67") and not splits["3"].is_valid


def test_charges_by_value(spark):
    matches = spark.createDataFrame([("a", 0, "r", D(100), D(120)), ("a", 1, "r", D(500), D("208"))], "quote_id string, line_index int, rfq_id string, requested_quantity decimal(18,4), unit_price decimal(18,4)")
    charges = spark.createDataFrame([("a", 1, D(5000), D(18)), ("a", 2, D(1000), D(18))], "quote_id string, charge_no int, amount decimal(18,2), tax_rate_pct decimal(9,4)")
    got = commercial.allocate_charges(matches, None, charges, "PROPORTIONAL_LINE_VALUE").collect()
    assert sum(r.allocated for r in got) == D("7080.00")


def test_string_metric():
    assert matching.lcs("kitten", "sitting") == 4 and matching.lcs("", "abc") == 0 and matching.lcs("abcbdab", "bdcaba") == 4


def test_exact_match_prefers_master_order(spark):
    items = spark.createDataFrame([("I2", 2, "X-1", "M1", "S1", "ACTIVE"), ("I1", 1, "Q", "x1", "S2", "ACTIVE"), ("I0", 0, "X1", "M0", "S0", "INACTIVE")], "internal_item_id string, master_pos long, internal_sku string, manufacturer_part_number string, supplier_part_number string, status string")
    lines = spark.createDataFrame([("X 1",), ("--",), (None,)], "part_number string")
    got = {r.part_number: (r.matched_item, r.match_method) for r in matching.exact_match(lines, items).collect()}
    assert got == {"X 1": ("I1", "MANUFACTURER_PN_EXACT"), "--": (None, "NO_MATCH"), None: (None, "NO_MATCH")}


def test_texts(spark):
    row = spark.createDataFrame([("Freight\t750\t0", "pairs", "125 @ 18%", "GST 12.5% extra")], "a string, u string, c string, g string")
    got = row.select(text.norm_decimal(F.col("a")).alias("n"), text.norm_uom(F.col("u")).alias("u"), text.tax_rate(F.col("g")).alias("t"), text.a1_ref(F.lit(3), F.lit(703)).alias("ref")).first()
    assert (got.n, got.u, got.t, got.ref) == (D(750), "PAIR", D("12.5"), "AAA3")


def test_award_rules(spark):
    lines = spark.createDataFrame([("r", "1", D(10)), ("r", "2", D(10)), ("r", "3", D(10))], "rfq_id string, rfq_line_id string, requested_quantity decimal(18,4)")
    offered = spark.createDataFrame([("r", n, "A", D("2.5")) for n in "12"], "rfq_id string, rfq_line_id string, supplier_id string, unit_cost decimal(18,4)")
    suppliers = spark.createDataFrame([("A", "ACTIVE")], "supplier_id string, status string")
    sent = [("r", "1", "A", "4", None), ("r", "1", "A", "6", "2.505"), ("r", "2", "A", "-1", None), ("r", "2", "A", "x", None), ("r", "2", "A", "1", "9"), ("r", "9", "A", "1", None), ("r", "3", "A", "1", None)]
    checked = award.validate(spark.createDataFrame(sent, "rfq_id string, rfq_line_id string, supplier_id string, allocated_qty string, unit_cost string"), lines, offered, suppliers)
    assert sorted(r.error or "" for r in checked.collect()) == ["", "", "MALFORMED_QUANTITY", "NEGATIVE_QUANTITY", "NO_ELIGIBLE_BID", "PRICE_DIFFERS", "UNKNOWN_LINE"]
    states = {r.rfq_line_id: (r.state, r.value) for r in award.allocation_states(checked, lines).collect()}
    assert states == {"1": ("FULLY_ALLOCATED", D("25.00")), "2": ("UNALLOCATED", D(0)), "3": ("UNALLOCATED", D(0))}


def test_decisions(spark):
    log = spark.createDataFrame([(1, 1, 10, "ACCEPT", 1.0), (1, 2, 11, "REOPEN", 2.0), (2, 3, 5, "ACCEPT", 3.0), (2, 4, 5, "REJECT", 4.0)], "key int, id int, ts int, action string, value double")
    got = {r.key: (r.action, r.is_locked) for r in master.latest_decisions(log).collect()}
    assert got == {1: ("REOPEN", False), 2: ("REJECT", True)}
