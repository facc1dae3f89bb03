"""What a buyer submits as an award, split by split, against the bids of the comparison; what a proposal leaves open."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.money import money2
from bidloom.operators.award import KEY

#: Errors of a whole allocation: its splits are not looked at.
WHOLE = ("UNKNOWN_LINE", "DUPLICATE_LINE")


def named_bids(offered: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(rfq_id, rfq_line_id, name, bid) of each bid by its supplier's id and by its quote's. Of bids that share a name on a
    line the cheapest counts."""
    rows = offered.select(*KEY, "supplier_id", "quote_id", "unit_cost").join(suppliers.select("supplier_id", "supplier_name", "status"), "supplier_id", "left")
    rows = rows.select(*KEY, F.explode(F.array_distinct(F.array("supplier_id", "quote_id"))).alias("name"), F.struct("unit_cost", "supplier_id", "quote_id", "supplier_name", "status").alias("bid"))
    return rows.where("name IS NOT NULL").groupBy(*KEY, "name").agg(F.min("bid").alias("bid"))


def check_splits(splits: DataFrame, rfq_lines: DataFrame, offered: DataFrame, suppliers: DataFrame) -> DataFrame:
    """splits (rfq_id, alloc_no, rfq_line_id, split_no, supplier_id, quote_id, allocated_qty, unit_cost; the last two texts)
    with the first rule that each breaks (``error``), and the bid's supplier and quote, quantity and value of those that hold.

    An allocation is of a line of the RFQ that no earlier one has. A split names its bid by supplier, by quote or by both,
    which must agree; the price is the bid's, and one that is submitted may differ by 0.01. A quantity of zero is no error
    and allocates nothing; one that is null is malformed."""
    first = splits.groupBy(*KEY).agg(F.min("alloc_no").alias("_first"))
    known = rfq_lines.select(*KEY, F.lit(True).alias("_line")).join(first, KEY)
    bids = named_bids(offered, suppliers)
    rows = splits.withColumns({"supplier_id": F.nullif("supplier_id", F.lit("")), "quote_id": F.nullif("quote_id", F.lit(""))}).join(known, KEY, "left")
    for column, bid in (("supplier_id", "_s"), ("quote_id", "_q")):
        rows = rows.join(bids.select(*KEY, F.col("name").alias(column), F.col("bid").alias(bid)), [*KEY, column], "left")
    agree = F.col("quote_id").isNull() | F.col("quote_id").isin(F.col("_s.quote_id"), F.col("_s.supplier_id"))
    other = F.col("supplier_id").isNull() | F.coalesce(F.col("supplier_id").isin(F.col("_q.supplier_id"), F.col("_q.quote_id"), F.col("_q.supplier_name")), F.lit(False))
    rows = rows.withColumn("_bid", F.when(F.col("_s").isNotNull(), F.when(agree, F.col("_s"))).when(other, F.col("_q")))
    qty, price, asked = F.col("allocated_qty").try_cast("decimal(18,4)"), F.col("_bid.unit_cost"), F.col("unit_cost").try_cast("decimal(18,4)")
    error = (
        F.when(F.col("_line").isNull(), "UNKNOWN_LINE").when(F.col("alloc_no") > F.col("_first"), "DUPLICATE_LINE").when(qty.isNull(), "MALFORMED_QUANTITY")
        .when(qty < 0, "NEGATIVE_QUANTITY").when(qty == 0, None).when(F.col("_bid").isNull(), "NO_ELIGIBLE_BID").when(F.col("_bid.status") == "INACTIVE", "INACTIVE_SUPPLIER")
        .when(F.col("unit_cost").isNotNull() & asked.isNull(), "MALFORMED_PRICE").when(F.abs(asked - price) > 0.01, "PRICE_DIFFERS")
    )
    holds = F.col("error").isNull() & (qty > 0)
    keep = lambda c: F.when(holds, c)
    return rows.withColumn("error", error).select(*KEY, "alloc_no", "split_no", "error", keep(F.col("_bid.supplier_id")).alias("supplier_id"), keep(F.col("_bid.quote_id")).alias("quote_id"), keep(qty).alias("qty"), keep(money2(qty * price)).alias("split_value"))


def errors(checked: DataFrame) -> DataFrame:
    """One row an error: of a whole allocation once (split_no null), of a split by itself."""
    split = F.when(~F.col("error").isin(*WHOLE), F.col("split_no"))
    return checked.where("error IS NOT NULL").select(*KEY, "alloc_no", split.alias("split_no"), "error").distinct()


def proposal_warnings(proposal: DataFrame) -> DataFrame:
    """Per RFQ: its lines by state, the value, whether quantities are left open, and the warning that says so."""
    is_ = lambda *states: F.count_if(F.col("allocation_state").isin(*states))
    out = proposal.groupBy("rfq_id").agg(
        F.sum("line_value").cast("decimal(18,2)").alias("total_value"), F.count("*").alias("n_required"), is_("FULLY_ALLOCATED").alias("n_full"),
        is_("NOT_QUOTED").alias("n_not_quoted"), is_("NOT_QUOTED", "UNALLOCATED").alias("n_unallocated"),
    )
    is_open = F.col("n_unallocated") > 0
    return out.withColumns({"has_unallocated": is_open, "warning": F.when(is_open, "UNALLOCATED_QUANTITIES")})
