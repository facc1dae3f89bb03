"""Whole-RFQ ranking and per-line split sourcing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions.money import money2


def eligibility(totals: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """totals with scope (ELIGIBLE, PARTIAL, INELIGIBLE) and the reasons against a whole-RFQ award. issues (rfq_id,
    supplier_id, code, severity): each code that is critical or blocking is a reason."""
    partial = ~F.col("fully_comparable") & (F.col("comparable_items") > 0)
    reasons = F.array_compact(F.array(
        F.when(F.col("comparable_items") == 0, "ZERO_COMPARABLE"),
        F.when(F.col("total_base").isNull(), "NO_TOTAL"),
        F.when(F.col("exchange_rate").isNull(), "NO_EXCHANGE_RATE"),
    ))
    if issues is not None:
        codes = issues.where("severity IN ('CRITICAL', 'BLOCKING')").groupBy("rfq_id", "supplier_id").agg(F.sort_array(F.collect_set("code")).alias("_codes"))
        totals = totals.join(codes, ["rfq_id", "supplier_id"], "left")
        reasons = F.concat(reasons, F.transform(F.coalesce("_codes", F.array().cast("array<string>")), lambda c: F.concat(F.lit("BLOCKING_ISSUE:"), c)))
    reasons = F.when(partial, F.array(F.lit("PARTIAL_SCOPE"))).otherwise(reasons)
    out = totals.withColumn("reasons", reasons).drop("_codes")
    return out.withColumn("scope", F.when(partial, "PARTIAL").when(F.size("reasons") > 0, "INELIGIBLE").otherwise("ELIGIBLE"))


def rank_suppliers(totals: DataFrame) -> DataFrame:
    """Ranks 1, 2, ... by total and supplier among the eligible (999 for others), with the distance from the first."""
    scoped = eligibility(totals)
    order = Window.partitionBy("rfq_id").orderBy("total_base", "supplier_id")
    ranked = scoped.where("scope = 'ELIGIBLE'").withColumn("rank", F.row_number().over(order)).withColumn("l1_total", F.first("total_base").over(order))
    ranked = ranked.withColumn("delta_to_l1", (F.col("total_base") - F.col("l1_total")).cast("decimal(18,2)"))
    pct = F.round(F.col("delta_to_l1") * 100 / F.nullif(F.col("l1_total"), F.lit(0).cast("decimal(18,2)")), 2).cast("decimal(18,2)")
    ranked = ranked.withColumn("delta_pct_to_l1", F.coalesce(pct, F.lit(0).cast("decimal(18,2)"))).drop("l1_total")
    rest = scoped.where("scope <> 'ELIGIBLE'").withColumn("rank", F.lit(999))
    return ranked.unionByName(rest, allowMissingColumns=True)


def remarks(ranked: DataFrame) -> DataFrame:
    """Advantages and disadvantages of each ranked supplier, as codes."""
    credit, advance, lead = (F.col(c) for c in ("credit_days", "advance_pct", "lead_time_days_default"))
    good = F.array_compact(F.array(F.when(F.col("rank") == 1, "LOWEST_COST"), F.when(credit >= 30, "CREDIT_TERMS"), F.when(lead <= 7, "FAST_DELIVERY")))
    bad = F.array_compact(F.array(F.when(F.col("rank") > 1, "HIGHER_COST"), F.when((F.coalesce(credit, F.lit(0)) < 30) & (advance > 0), "ADVANCE_PAYMENT"), F.when(lead > 30, "LONG_LEAD_TIME")))
    return ranked.where("scope = 'ELIGIBLE'").select("rfq_id", "supplier_id", "rank", F.array_join(good, ",").alias("advantages"), F.array_join(bad, ",").alias("disadvantages"))


def headline(ranked: DataFrame) -> DataFrame:
    """One row for each RFQ: its first three suppliers and totals."""
    eligible = ranked.where("rank <= 3")
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return eligible.groupBy("rfq_id").agg(*[at(k, c).alias(f"l{k}_{n}") for k in (1, 2, 3) for c, n in (("supplier_id", "supplier"), ("total_base", "total"))])


def split_recs(prices: DataFrame, rfq_lines: DataFrame) -> DataFrame:
    """The best and second supplier of each RFQ line by landed unit price, and the gap between them (percent of the second)."""
    order = Window.partitionBy("rfq_id", "rfq_line_id").orderBy("unit_landed_base", "supplier_id")
    best = prices.where("is_comparable AND unit_landed_base IS NOT NULL").withColumn("place", F.row_number().over(order)).where("place <= 2")
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    best = best.groupBy("rfq_id", "rfq_line_id").agg(*[at(k, c).alias(f"l{k}_{n}") for k in (1, 2) for c, n in (("supplier_id", "supplier"), ("unit_landed_base", "unit"), ("line_total_base", "total"))])
    out = rfq_lines.select("rfq_id", "rfq_line_id").join(best, ["rfq_id", "rfq_line_id"], "left")
    out = out.withColumn("gap", money2(F.col("l2_unit") - F.col("l1_unit")))
    pct = F.when(F.col("l2_unit") > 0, money2(F.col("gap") * 100 / F.col("l2_unit")))
    return out.withColumn("gap_pct", pct).withColumn("is_valid", F.col("l1_supplier").isNotNull())


def split_savings(splits: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per RFQ, the cost of taking each line from its best supplier and what that saves against the first rank."""
    sums = splits.groupBy("rfq_id").agg(F.bool_and("is_valid").alias("all_valid"), F.sum("l1_total").cast("decimal(18,2)").alias("total"))
    first = ranked.where("rank = 1").select("rfq_id", F.col("total_base").alias("l1_total"))
    out = sums.join(first, "rfq_id", "left").withColumn("split_total", F.when(F.col("all_valid"), F.col("total")))
    zero = F.lit(0).cast("decimal(18,2)")
    saved = F.when(F.col("all_valid"), F.greatest((F.col("l1_total") - F.col("total")).cast("decimal(18,2)"), zero))
    return out.select("rfq_id", "split_total", "l1_total", F.coalesce(saved, zero).alias("savings"))
