"""Award proposals, validation of submitted allocations, and export rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions.money import money2, share

KEY = ["rfq_id", "rfq_line_id"]


def bids(prices: DataFrame) -> DataFrame:
    """Comparable bids with a landed price, and whether each is its line's lowest (ties: the smaller supplier_id)."""
    order = Window.partitionBy(*KEY).orderBy("unit_landed_base", "supplier_id")
    on = prices.where("is_comparable AND unit_landed_base > 0")
    return on.select(*KEY, "supplier_id", "quote_id", F.col("unit_landed_base").alias("unit_cost"), "quoted_qty", "quoted_uom", (F.row_number().over(order) == 1).alias("is_l1_for_line"))


def propose(rfq_lines: DataFrame, offered: DataFrame, ranked: DataFrame, scenario: str) -> DataFrame:
    """One supplier for each line: the RFQ's first rank (SINGLE_SUPPLIER_L1) or the line's lowest (LINE_ITEM_OPTIMAL),
    else the first bid by supplier_id; without bids the line is NOT_QUOTED."""
    first = ranked.where("rank = 1").select("rfq_id", F.col("supplier_id").alias("l1"))
    rows = offered.join(first, "rfq_id", "left")
    wanted = F.col("supplier_id") == F.col("l1") if scenario == "SINGLE_SUPPLIER_L1" else F.col("is_l1_for_line")
    choice = rows.groupBy(*KEY).agg(F.min_by(F.struct("supplier_id", "quote_id", "unit_cost", "is_l1_for_line"), F.struct(F.when(wanted, 0).otherwise(1), "supplier_id")).alias("b"))
    out = rfq_lines.select(*KEY, "requested_quantity").join(choice, KEY, "left").select(*KEY, "requested_quantity", "b.*")
    asked = F.col("requested_quantity").isNotNull()
    state = F.when(F.col("supplier_id").isNull(), "NOT_QUOTED").when(asked, "FULLY_ALLOCATED").otherwise("UNALLOCATED")
    value = F.when(asked, money2(F.col("requested_quantity") * F.col("unit_cost")))
    return out.withColumn("allocation_state", state).withColumn("line_value", F.coalesce(value, F.lit(0).cast("decimal(18,2)")))


def proposal_totals(proposal: DataFrame) -> DataFrame:
    return proposal.groupBy("rfq_id").agg(
        F.sum("line_value").cast("decimal(18,2)").alias("total_value"), F.count_if(F.col("allocation_state") == "FULLY_ALLOCATED").alias("n_full"),
        F.count_if(F.col("allocation_state") != "FULLY_ALLOCATED").alias("n_open"), F.countDistinct("supplier_id").alias("n_suppliers"),
    )


def validate(submitted: DataFrame, rfq_lines: DataFrame, offered: DataFrame, suppliers: DataFrame) -> DataFrame:
    """submitted (rfq_id, rfq_line_id, supplier_id, allocated_qty, unit_cost as strings) with the first rule each row
    breaks (``error``, null for none), its quantity and its value at the authoritative price."""
    known = rfq_lines.select(*KEY, F.lit(True).alias("_line"))
    rows = submitted.join(known, KEY, "left").join(offered.select(*KEY, "supplier_id", F.col("unit_cost").alias("_price")), [*KEY, "supplier_id"], "left")
    rows = rows.join(suppliers.select("supplier_id", F.col("status").alias("_status")), "supplier_id", "left")
    qty, price = F.col("allocated_qty").try_cast("decimal(18,4)"), F.col("unit_cost").try_cast("decimal(18,4)")
    error = (
        F.when(F.col("_line").isNull(), "UNKNOWN_LINE").when(qty.isNull(), "MALFORMED_QUANTITY").when(qty < 0, "NEGATIVE_QUANTITY")
        .when(qty == 0, "ZERO_QUANTITY").when(F.col("_price").isNull(), "NO_ELIGIBLE_BID").when(F.col("_status") == "INACTIVE", "INACTIVE_SUPPLIER")
        .when(F.col("unit_cost").isNotNull() & price.isNull(), "MALFORMED_PRICE").when(F.abs(price - F.col("_price")) > 0.01, "PRICE_DIFFERS")
    )
    value = F.when(error.isNull(), money2(qty * F.col("_price")))
    return rows.select(*KEY, "supplier_id", error.alias("error"), F.when(error.isNull(), qty).alias("qty"), value.alias("split_value"))


def allocation_states(checked: DataFrame, rfq_lines: DataFrame) -> DataFrame:
    """Every RFQ line with what the accepted rows allocate to it; lines that nobody submitted are UNALLOCATED."""
    zero4, zero2 = F.lit(0).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,2)")
    sums = checked.groupBy(*KEY).agg(F.sum("qty").cast("decimal(18,4)").alias("allocated"), F.sum("split_value").cast("decimal(18,2)").alias("value"))
    out = rfq_lines.select(*KEY, F.coalesce("requested_quantity", zero4).alias("required")).join(sums, KEY, "left")
    out = out.withColumns({"allocated": F.coalesce("allocated", zero4), "value": F.coalesce("value", zero2)})
    state = F.when(F.col("allocated") > F.col("required"), "OVER_ALLOCATED").when((F.col("allocated") == F.col("required")) & (F.col("required") > 0), "FULLY_ALLOCATED")
    out = out.withColumn("state", state.when(F.col("allocated") > 0, "PARTIALLY_ALLOCATED").otherwise("UNALLOCATED"))
    return out.withColumn("unallocated", F.greatest((F.col("required") - F.col("allocated")).cast("decimal(18,4)"), zero4))


def finalise_gate(states: DataFrame, errors: DataFrame) -> DataFrame:
    """Per RFQ: REJECTED with errors or over-allocation, NEEDS_ACKNOWLEDGEMENT with open quantities, else FINALIZED."""
    bad = errors.where("error IS NOT NULL AND error <> 'ZERO_QUANTITY'").groupBy("rfq_id").agg(F.count("*").alias("n_errors"))
    out = states.groupBy("rfq_id").agg(F.count_if(F.col("state") == "OVER_ALLOCATED").alias("n_over"), F.count_if(F.col("unallocated") > 0).alias("n_open")).join(bad, "rfq_id", "left").fillna(0, ["n_errors"])
    return out.withColumn("gate", F.when((F.col("n_errors") > 0) | (F.col("n_over") > 0), "REJECTED").when(F.col("n_open") > 0, "NEEDS_ACKNOWLEDGEMENT").otherwise("FINALIZED"))


def erp_flat(proposal: DataFrame, rfq_lines: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Flat export rows; commas in texts become semicolons, a line without supplier is a sentinel row."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), ",", ";")
    none = F.col("supplier_id").isNull()
    out = proposal.join(rfq_lines.select(*KEY, "sku", "description", "requested_uom"), KEY).join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
    text = lambda c, sentinel: F.when(none, sentinel).otherwise(F.col(c).cast("string"))
    return out.select(
        *KEY, plain(F.col("sku")).alias("item_sku"), plain(F.col("description")).alias("item_description"), F.coalesce(F.col("requested_uom"), F.lit("PCS")).alias("required_uom"),
        F.when(none, "UNALLOCATED").otherwise(plain(F.coalesce("supplier_name", "supplier_id"))).alias("supplier_name"), text("supplier_id", "N/A").alias("supplier_id"),
        text("quote_id", "N/A").alias("quote_id"), text("unit_cost", "0.00").alias("unit_landed_cost"), F.when(none, "0.00").otherwise(F.col("line_value").cast("string")).alias("line_total_value"),
    )


def supplier_summary(proposal: DataFrame) -> DataFrame:
    """Per RFQ and supplier: lines, quantity, value, and share of the RFQ's value in percent."""
    sums = proposal.where("supplier_id IS NOT NULL").groupBy("rfq_id", "supplier_id").agg(F.count("*").alias("n_lines"), F.sum("requested_quantity").cast("decimal(18,4)").alias("qty"), F.sum("line_value").cast("decimal(18,2)").alias("value"))
    whole = F.sum("value").over(Window.partitionBy("rfq_id"))
    return sums.withColumn("share_pct", share(F.col("value"), whole))
