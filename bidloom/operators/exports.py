"""What leaves an award and its RFQ: the allocation sheet, the summary, a supplier's requisition, listings, and the reasons
behind a document's confidence."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.operators.award import KEY

#: Labels and order of the summary's rows: fixed values.
SUMMARY = (
    "RFQ Reference Number", "RFQ Project Title", "Award Status", "Award Baseline Date", "Awarded By", "Base Sourcing Currency", "Total Award Commitment", "Total RFQ Scope Items",
    "Fully Allocated Lines", "Partially Allocated Lines", "Unallocated Scope Lines", "Selected Sourcing Strategy", "Commercial Evaluation ID",
)


def accepted(checked: DataFrame, offered: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The splits of checked (as ``check_splits`` gives it) that allocate something, with their bid's price and capacity, whether
    it is the line's lowest, and the supplier's name (without one, its id)."""
    bid = offered.select(*KEY, "supplier_id", "quote_id", F.col("unit_cost").alias("unit_landed_cost"), "quoted_qty", "is_l1_for_line")
    rows = checked.where("qty > 0").select(*KEY, "alloc_no", "split_no", "supplier_id", "quote_id", "qty", "split_value").join(bid, [*KEY, "supplier_id", "quote_id"], "left")
    return rows.join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left").withColumn("supplier_name", F.coalesce("supplier_name", "supplier_id"))


def award_sheet(splits: DataFrame, states: DataFrame, rfq_lines: DataFrame, rfqs: DataFrame) -> DataFrame:
    """The allocation sheet: a row for each split (as ``accepted`` gives them), and one for each line without any, which says
    UNALLOCATED, N/A and zeros."""
    zero = lambda c, d: F.coalesce(c, F.lit(0).cast(f"decimal(18,{d})"))
    rows = states.select(*KEY, "required", "state").join(rfq_lines.select(*KEY, "sku", "description", "requested_uom"), KEY)
    rows = rows.join(splits, KEY, "left").join(rfqs.select("rfq_id", "base_currency"), "rfq_id", "left")
    none = F.col("supplier_id").isNull()
    return rows.select(
        *KEY, F.coalesce("sku", F.lit("")).alias("item_sku"), F.coalesce("description", F.lit("")).alias("item_description"), F.col("required").alias("required_qty"), F.coalesce("requested_uom", F.lit("PCS")).alias("uom"),
        F.when(none, "UNALLOCATED").otherwise(F.col("supplier_name")).alias("supplier_name"), F.when(none, "N/A").otherwise(F.coalesce("quote_id", F.lit(""))).alias("quote_id"),
        zero("qty", 4).alias("awarded_qty"), zero("unit_landed_cost", 4).alias("unit_landed_cost"), zero("split_value", 2).alias("line_award_value"), F.coalesce("base_currency", F.lit("INR")).alias("currency"),
        F.col("state").alias("allocation_state"), F.when(F.coalesce("is_l1_for_line", F.lit(False)), "YES").otherwise("NO").alias("l1_line_optimal"),
    )


def award_summary(rfqs: DataFrame, states: DataFrame, awards: DataFrame) -> DataFrame:
    """SUMMARY's thirteen rows (rfq_id, row_no, label, value) for each RFQ of rfqs (rfq_id, title, base_currency); awards:
    (rfq_id, status, awarded_at, awarded_by, scenario, comparison_id), of which any may be missing."""
    n = lambda s: F.count_if(F.col("state") == s)
    sums = states.groupBy("rfq_id").agg(
        F.count("*").alias("n_lines"), F.sum("value").cast("decimal(18,2)").alias("total"), n("FULLY_ALLOCATED").alias("n_full"),
        n("PARTIALLY_ALLOCATED").alias("n_partial"), n("UNALLOCATED").alias("n_open"),
    )
    rows = rfqs.select("rfq_id", "title", "base_currency").join(sums, "rfq_id", "left").join(awards.select("rfq_id", "status", "awarded_at", "awarded_by", "scenario", "comparison_id"), "rfq_id", "left")
    or_ = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    currency = or_("base_currency", "INR")
    values = [
        F.col("rfq_id"), or_("title", "Procurement Project"), or_("status", "DRAFT"), F.coalesce(F.when(F.col("status") == "FINALIZED", F.col("awarded_at").cast("string")), F.lit("Pending Finalization")),
        or_("awarded_by", "Procurement Specialist"), currency, F.concat(currency, F.lit(" "), F.format_number(F.coalesce("total", F.lit(0).cast("decimal(18,2)")), 2)),
        number("n_lines"), number("n_full"), number("n_partial"), number("n_open"), or_("scenario", "MANUAL_ALLOCATION"), or_("comparison_id", "N/A"),
    ]
    cells = [F.struct(F.lit(i).alias("row_no"), F.lit(label).alias("label"), value.alias("value")) for i, (label, value) in enumerate(zip(SUMMARY, values, strict=True), 1)]
    return rows.select("rfq_id", F.inline(F.array(*cells)))


def requisition(splits: DataFrame, asked: DataFrame, rfq_lines: DataFrame) -> DataFrame:
    """What each key of asked (rfq_id, key) is to deliver: the splits whose supplier, quote or supplier's name the key is, with
    their sum. A split that a key names twice counts once; keys that name nothing have no row."""
    names = F.explode(F.array_distinct(F.array("supplier_id", "quote_id", "supplier_name"))).alias("key")
    rows = splits.select("*", names).join(asked.select("rfq_id", "key").distinct(), ["rfq_id", "key"])
    sums = rows.groupBy("rfq_id", "key").agg(F.sum("split_value").cast("decimal(18,2)").alias("total_value"))
    rows = rows.join(sums, ["rfq_id", "key"]).join(rfq_lines.select(*KEY, "sku", "description", "requested_uom"), KEY, "left")
    return rows.select(
        "rfq_id", "key", "supplier_id", "supplier_name", "quote_id", "rfq_line_id", "alloc_no", "split_no", F.col("sku").alias("item_sku"), F.col("description").alias("item_description"),
        F.col("qty").alias("allocated_qty"), F.coalesce("requested_uom", F.lit("PCS")).alias("uom"), "unit_landed_cost", F.col("split_value").alias("line_value"), F.col("quoted_qty").alias("quoted_capacity"), "total_value",
    )


def write_requisitions(splits: DataFrame, path: str) -> None:
    """The splits in a folder for each supplier. Small suppliers share tasks and large ones are split, so a supplier with
    most of the rows has several files."""
    splits.hint("rebalance", "supplier_id").write.partitionBy("supplier_id").parquet(path)


def comparison_listing(comparisons: DataFrame, ranked: DataFrame, rfqs: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Comparisons (comparison_id, rfq_id, title, created_at), newest first, with the suppliers compared and the first of them;
    without a first rank it is "Split Optimal" and the cost "—"."""
    first = F.col("rank") == 1
    sums = ranked.groupBy("rfq_id").agg(F.countDistinct("supplier_id").alias("supplier_count"), F.min(F.when(first, F.struct("supplier_id", "total_base"))).alias("l1"))
    rows = comparisons.join(sums, "rfq_id", "left").join(rfqs.select("rfq_id", "base_currency"), "rfq_id", "left").withColumn("supplier_id", F.col("l1.supplier_id"))
    rows = rows.join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
    return rows.select(
        "comparison_id", "rfq_id", F.coalesce("title", F.concat(F.lit("Comparison for "), "rfq_id")).alias("title"), "created_at", F.coalesce("supplier_count", F.lit(0)).alias("supplier_count"),
        F.coalesce("supplier_name", F.lit("Split Optimal")).alias("l1_supplier"), F.coalesce(F.col("l1.total_base").cast("string"), F.lit("—")).alias("l1_landed_cost"), F.coalesce("base_currency", F.lit("INR")).alias("base_currency"),
    ).orderBy(F.desc("created_at"), F.desc("comparison_id"))


def most_recent(kinds: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(what, place, id, as_of) of the latest rows of each kind's table (id, as_of), as many as its number says; ties by the greater
    id, rows without a time last."""

    def latest(what: str, rows: DataFrame, n: int) -> DataFrame:
        top = rows.select("id", "as_of").orderBy(F.desc_nulls_last("as_of"), F.desc("id")).limit(n)
        place = F.row_number().over(Window.partitionBy("what").orderBy(F.desc_nulls_last("as_of"), F.desc("id")))
        return top.withColumn("what", F.lit(what)).select("what", place.alias("place"), "id", F.col("as_of").cast("string").alias("as_of"))

    return reduce(DataFrame.unionByName, [latest(what, rows, n) for what, (rows, n) in kinds.items()])


#: What each code of an issue is about: the field (of a line where it begins with a point) and what is wrong.
ABOUT = {
    "SUPPLIER_UNKNOWN": ("supplier_name", "no supplier was found"),
    "QUOTE_NUMBER_MISSING": ("quote_number", "no number was found"),
    "NO_LINE_ITEMS": ("items", "no line was found"),
    "UNIT_PRICE_INVALID": (".unit_price", "the price is not positive"),
    "QUANTITY_INVALID": (".quoted_qty", "the quantity is not positive"),
    "UOM_NON_STANDARD": (".quoted_uom", "the unit is not a standard one"),
    "SHORT_DESCRIPTION": (".raw_description", "the description is too short"),
}
#: What a reconciliation says of the total.
RECONCILIATION = {
    "DISCREPANCY": "the calculated total differs from the stated one",
    "RECONCILED": "the calculated total is the stated one",
    "CALCULATED_ONLY": "no total is stated; the sums were checked against each other",
}
CAPS = {0.30: "a critical issue", 0.55: "a total that differs", 0.65: "an issue of high severity"}


def confidence_reasons(issues: DataFrame, reconciled: DataFrame, scored: DataFrame) -> DataFrame:
    """Why a document has its confidence, a row for each reason: (quote_id, line_index, kind, penalty, reason). kind: ISSUE,
    RECONCILIATION or CAP. scored: as ``finance.confidence`` gives it. A document's reasons never come together in one row."""
    penalty = {"CRITICAL": 0.50, "HIGH": 0.25, "MEDIUM": 0.10, "LOW": 0.05}

    def chosen(key: Column, values: dict) -> Column:
        return reduce(lambda w, kv: w.when(key == kv[0], kv[1]), list(values.items())[1:], F.when(key == next(iter(values)), next(iter(values.values()))))

    code, none = F.col("code"), F.lit(None).cast("int")
    where, what = (chosen(code, {k: v[i] for k, v in ABOUT.items()}) for i in (0, 1))
    field = F.when(F.col("line_index").isNull(), where).otherwise(F.concat(F.lit("items["), F.col("line_index").cast("string"), F.lit("]"), where))
    rows = issues.select("quote_id", "line_index", F.lit("ISSUE").alias("kind"), chosen(F.col("severity"), penalty).alias("penalty"), F.concat(F.col("severity"), F.lit(": "), F.coalesce(field, code), F.lit(": "), F.coalesce(what, code)).alias("reason"))
    off = F.col("status") == "DISCREPANCY"
    sums = reconciled.where(F.col("status").isin(*RECONCILIATION)).select("quote_id", none.alias("line_index"), F.lit("RECONCILIATION").alias("kind"), F.when(off, 0.25).otherwise(0.0).alias("penalty"), F.concat("status", F.lit(": "), chosen(F.col("status"), RECONCILIATION)).alias("reason"))
    cap = F.when(F.col("critical") > 0, 0.30).when(F.col("financial_confidence") < 1, 0.55).when(F.col("high") > 0, 0.65)
    caps = scored.withColumn("cap", cap).where("cap IS NOT NULL").select("quote_id", none.alias("line_index"), F.lit("CAP").alias("kind"), F.lit(0.0).alias("penalty"), F.concat(F.lit("at most "), F.format_number("cap", 2), F.lit(" because of "), chosen(F.col("cap"), CAPS)).alias("reason"))
    return rows.unionByName(sums).unionByName(caps)
