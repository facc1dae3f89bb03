from decimal import Decimal

from bidloom.operators import allocations, award, catalog, lifecycle, master, ranking


def bids(spark):
    return spark.createDataFrame([("R", "L1", "S1", "Q1", Decimal("10.00")), ("R", "L1", "S2", "Q2", Decimal("12.00")), ("R", "L2", "S3", "Q3", Decimal("5.00"))], "rfq_id string, rfq_line_id string, supplier_id string, quote_id string, unit_cost decimal(18,4)")


def suppliers(spark):
    return spark.createDataFrame([("S1", "One", "ACTIVE"), ("S2", "Two", "ACTIVE"), ("S3", "Three", "INACTIVE")], "supplier_id string, supplier_name string, status string")


def lines(spark):
    return spark.createDataFrame([("R", "L1", Decimal(10)), ("R", "L2", Decimal(4)), ("R", "L3", None)], "rfq_id string, rfq_line_id string, requested_quantity decimal(18,4)")


SPLIT = "rfq_id string, alloc_no int, rfq_line_id string, split_no int, supplier_id string, quote_id string, allocated_qty string, unit_cost string"


def checked(spark, rows):
    return allocations.check_splits(spark.createDataFrame(rows, SPLIT), lines(spark), bids(spark), suppliers(spark))


def test_a_split_names_its_bid_by_supplier_or_quote_and_both_must_agree(spark):
    names = [("S1", None), ("S1", "Q1"), ("S1", "S1"), ("S1", "Q2"), (None, "Q2"), ("", "Q2"), ("Two", "Q2"), ("Q2", "Q2"), ("One", "Q2"), ("Two", None), (None, None), ("Q1", None)]
    rows = checked(spark, [("R", 1, "L1", i, s, q, "1", None) for i, (s, q) in enumerate(names)]).collect()
    found = {r.split_no: r.supplier_id for r in rows}
    assert found == {0: "S1", 1: "S1", 2: "S1", 3: None, 4: "S2", 5: "S2", 6: "S2", 7: "S2", 8: None, 9: None, 10: None, 11: "S1"}
    assert {r.error for r in rows if r.supplier_id is None} == {"NO_ELIGIBLE_BID"}


def test_repeated_allocations_are_one_error_and_count_nothing(spark):
    rows = checked(spark, [("R", 1, "L1", 1, "S1", None, "6", "10.005"), ("R", 1, "L1", 2, "S2", None, "4", None), ("R", 2, "L1", 1, "S1", None, "6", None), ("R", 2, "L1", 2, "S1", None, "x", None), ("R", 3, "L9", 1, "S1", None, "1", None), ("R", 3, None, 2, "S1", None, "1", None)])
    states = {r.rfq_line_id: (r.state, r.value) for r in award.allocation_states(rows, lines(spark)).collect()}
    assert states == {"L1": ("FULLY_ALLOCATED", Decimal("108.00")), "L2": ("UNALLOCATED", Decimal(0)), "L3": ("UNALLOCATED", Decimal(0))}
    errors = allocations.errors(rows)
    assert sorted((r.alloc_no, r.rfq_line_id or "", r.split_no, r.error) for r in errors.collect()) == [(2, "L1", None, "DUPLICATE_LINE"), (3, "", None, "UNKNOWN_LINE"), (3, "L9", None, "UNKNOWN_LINE")]
    gate = award.finalise_gate(award.allocation_states(rows, lines(spark)), errors).first()
    assert (gate.n_errors, gate.gate) == (3, "REJECTED")


def test_rules_of_a_split_in_order(spark):
    given = [("-1", None), ("ten", None), (None, None), ("0", "cheap"), ("1", "cheap"), ("1", "9.98"), ("1", "10.01")]
    rows = checked(spark, [("R", 1, "L1", i, "S1", None, q, p) for i, (q, p) in enumerate(given)] + [("R", 2, "L2", 9, "S3", None, "1", "5")]).collect()
    assert {r.split_no: r.error for r in rows} == {0: "NEGATIVE_QUANTITY", 1: "MALFORMED_QUANTITY", 2: "MALFORMED_QUANTITY", 3: None, 4: "MALFORMED_PRICE", 5: "PRICE_DIFFERS", 6: None, 9: "INACTIVE_SUPPLIER"}
    assert {r.split_no: r.qty for r in rows if r.qty is not None} == {6: Decimal(1)}


def test_proposal_warnings(spark):
    rows = spark.createDataFrame([("R", "FULLY_ALLOCATED", Decimal(5)), ("R", "NOT_QUOTED", Decimal(0)), ("S", "FULLY_ALLOCATED", Decimal(7))], "rfq_id string, allocation_state string, line_value decimal(18,2)")
    found = {r.rfq_id: (r.n_required, r.n_full, r.n_not_quoted, r.warning) for r in allocations.proposal_warnings(rows).collect()}
    assert found == {"R": (2, 1, 1, "UNALLOCATED_QUANTITIES"), "S": (1, 1, 0, None)}


def test_blocking_issues_make_a_supplier_ineligible_unless_its_scope_is_partial(spark):
    totals = spark.createDataFrame([("R", "S1", True, 2, Decimal(9), Decimal(1)), ("R", "S2", False, 1, Decimal(9), Decimal(1)), ("R", "S3", True, 2, Decimal(9), Decimal(1))], "rfq_id string, supplier_id string, fully_comparable boolean, comparable_items int, total_base decimal(18,2), exchange_rate decimal(18,8)")
    issues = spark.createDataFrame([("R", "S1", "B", "BLOCKING"), ("R", "S1", "A", "CRITICAL"), ("R", "S1", "A", "BLOCKING"), ("R", "S2", "A", "BLOCKING"), ("R", "S3", "A", "WARNING")], "rfq_id string, supplier_id string, code string, severity string")
    found = {r.supplier_id: (r.scope, r.reasons) for r in ranking.eligibility(totals, issues).collect()}
    assert found == {"S1": ("INELIGIBLE", ["BLOCKING_ISSUE:A", "BLOCKING_ISSUE:B"]), "S2": ("PARTIAL", ["PARTIAL_SCOPE"]), "S3": ("ELIGIBLE", [])}


MASTER = "internal_item_id string, internal_sku string, manufacturer_part_number string, stocking_uom string, canonical_description string, master_pos bigint, import_batch_id string, status string"


def items(spark):
    return spark.createDataFrame([("ITEM-007", "A", "m", "PCS", "old", 7, "B1", "ACTIVE"), ("ITEM-008", "B", None, "KG", "bolt", 8, "B1", "ACTIVE"), ("ITEM-009", "C", None, "KG", "nut", 9, None, "ACTIVE")], MASTER)


def test_append_keeps_descriptions_and_replace_starts_anew(spark):
    new = spark.createDataFrame([(" a ", "m2", "", "other", 1), ("n", "", "kg", "first", 2), ("N", "m3", None, "second", 3), ("", "m", "kg", "no code", 4), ("z", "m", "kg", " ", 5)], "sku string, mpn string, uom string, description string, pos int")
    got = {r.internal_item_id: r[1:] for r in master.upsert_catalog(items(spark), new).collect()}
    assert got == {"ITEM-007": ("A", "m2", "PCS", "old"), "ITEM-008": ("B", None, "KG", "bolt"), "ITEM-009": ("C", None, "KG", "nut"), "ITEM-010": ("N", "m3", "KG", "first")}
    got = {r.internal_item_id: r[1:] for r in master.upsert_catalog(items(spark), new, "replace").collect()}
    assert got == {"ITEM-001": ("A", "m2", "PCS", "other"), "ITEM-002": ("N", None, "KG", "first"), "ITEM-003": ("N", "m3", "PCS", "second")}
    empty = items(spark).limit(0)
    assert {r.internal_item_id for r in master.upsert_catalog(empty, new).collect()} == {"ITEM-001", "ITEM-002"}


def test_used_items_are_neither_deleted_nor_lost_by_an_undo(spark):
    uses = spark.createDataFrame([("RFQ", "R", None, " a "), ("RFQ", "R", "ITEM-007", "A"), ("AWARD", "R", "ITEM-007", None), ("QUOTE", "Q", "ITEM-x", "")], "kind string, owner string, internal_item_id string, sku string")
    used = catalog.dependencies(items(spark), uses)
    assert {r.internal_item_id: (r.n_rfq, r.n_award, r.n_references) for r in used.collect()} == {"ITEM-007": (1, 1, 2), "ITEM-008": (0, 0, 0), "ITEM-009": (0, 0, 0)}
    preview = catalog.preview_undo(items(spark), used)
    assert catalog.undo_counts(preview).collect() == [("B1", 2, 1, 1)]
    left = catalog.undone(items(spark), preview, items(spark))
    assert {(r.internal_item_id, r.status) for r in left.collect()} == {("ITEM-007", "INACTIVE"), ("ITEM-009", "ACTIVE")}
    asked = spark.createDataFrame([("item-007",), ("b",), ("B",), ("none",), (None,)], "key string")
    assert {(r.key, r.internal_item_id, r.outcome) for r in catalog.guarded_delete(items(spark), used, asked).collect()} == {("item-007", "ITEM-007", "BLOCKED"), ("b", "ITEM-008", "DELETED"), ("B", "ITEM-008", "DELETED"), ("none", None, "NOT_FOUND"), (None, None, "NOT_FOUND")}


def test_reopenings_are_numbered_and_know_the_version_before(spark):
    rows = [("R", 1, "FINALIZED", "C1", Decimal(5), 1), ("R", 2, "REOPENED", "C1", Decimal(6), 2), ("R", 3, "FINALIZED", "C2", Decimal(7), 3), ("R", 4, "REOPENED", "C2", Decimal(8), 4), ("S", 1, "REOPENED", None, None, 9), ("T", 1, "DRAFT", "C", Decimal(1), 1)]
    versions = spark.createDataFrame(rows, "rfq_id string, version int, status string, comparison_id string, total decimal(18,2), awarded_at int")
    got = sorted(tuple(r) for r in lifecycle.award_revisions(versions).collect())
    assert got == [("R", 1, 2, "FINALIZED", "C1", Decimal(5)), ("R", 2, 4, "FINALIZED", "C2", Decimal(7)), ("S", 1, 9, None, None, None)]
