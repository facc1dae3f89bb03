"""Quoted lines brought to one unit and currency, charges allocated, suppliers summed up."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions.money import money2, percent, price4
from bidloom.operators import finance, uom

ZERO2 = "decimal(18,2)"


def quoted_quantity(matches: DataFrame, units: DataFrame) -> DataFrame:
    """matches with uom_factor, uom_method and qty_quoted: the requested quantity in the quoted unit, to 0.0001."""
    factors = F.when(F.col("box_factor").isNotNull(), F.create_map(F.lit("BOX"), F.col("box_factor")))
    out = uom.with_factor(matches.withColumn("_factors", factors), units, "quoted_uom", "requested_uom", "_factors").drop("_factors")
    one = F.lit(1).cast("decimal(18,6)")
    return out.withColumn("qty_quoted", price4(F.col("requested_quantity") / F.coalesce("uom_factor", one)))


def allocate_charges(matches: DataFrame, rfq_lines: DataFrame, charges: DataFrame, method: str) -> DataFrame:
    """(quote_id, line_index, allocated): each matched line's part of its quote's charges, to 0.01.

    NONE gives nothing; PROPORTIONAL_QUANTITY shares by requested quantity over all lines of the RFQ;
    PROPORTIONAL_LINE_VALUE by list price times requested quantity over the quote's matched lines.
    """
    if method == "NONE":
        return matches.select("quote_id", "line_index", F.lit(0).cast(ZERO2).alias("allocated"))
    totals = finance.charge_totals(charges).groupBy("quote_id").agg(F.sum("total_with_tax").cast(ZERO2).alias("charges_total"))
    if method == "PROPORTIONAL_QUANTITY":
        part = rfq_lines.groupBy("rfq_id").agg(F.sum("requested_quantity").cast("decimal(18,4)").alias("whole"))
        lines = matches.join(part, "rfq_id").withColumn("part", F.col("requested_quantity"))
    else:
        value = money2(F.col("unit_price") * F.col("requested_quantity"))
        lines = matches.withColumn("part", value).withColumn("whole", F.sum("part").over(Window.partitionBy("quote_id")).cast(ZERO2))
    # Types that leave the quotient ten digits, so that it is rounded once.
    product = (F.col("part") * F.col("charges_total")).cast("decimal(28,4)")
    share = money2(product / F.nullif(F.col("whole").cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")))
    return lines.join(totals, "quote_id", "left").select("quote_id", "line_index", F.coalesce(share, F.lit(0).cast(ZERO2)).alias("allocated"))


def line_prices(matches: DataFrame, tiers: DataFrame, quotes: DataFrame, fx: DataFrame, units: DataFrame, allocated: DataFrame | None = None) -> DataFrame:
    """One row for each RFQ line and supplier that quotes it: price chain, base-currency amounts, issues, comparability."""
    lines = finance.first_tier(quoted_quantity(matches, units), tiers, "qty_quoted")
    lines = lines.withColumn("unit_price_quoted", F.coalesce("tier_price", "unit_price"))
    keep = (100 - F.col("discount_pct")).cast("decimal(9,4)")
    lines = lines.withColumn("net_unit_price", money2(F.col("unit_price_quoted") * keep * percent()))
    if allocated is not None:
        lines = lines.join(allocated, ["quote_id", "line_index"], "left")
    else:
        lines = lines.withColumn("allocated", F.lit(0).cast(ZERO2))
    asked = F.col("requested_quantity") > 0
    zero = F.lit(0).cast(ZERO2)
    lines = lines.withColumn("taxable", F.when(asked, money2(F.col("net_unit_price") * F.col("qty_quoted"))).otherwise(zero))
    lines = lines.withColumn("line_tax", F.when(asked, money2(F.col("taxable") * F.col("tax_rate_pct") * percent())).otherwise(zero))
    lines = lines.withColumn("landed", F.when(asked, (F.col("taxable") + F.col("line_tax") + F.col("allocated")).cast(ZERO2)).otherwise(zero))
    lines = lines.withColumn("unit_landed", F.when(asked, price4(F.col("landed") / F.col("requested_quantity"))).otherwise(F.lit(0).cast("decimal(18,4)")))
    keys = finance.shared(["rfq_id", "quote_id"], lines, quotes)
    head = quotes.select(*keys, "currency", "lead_time_days_default")
    rates = F.broadcast(fx.where("to_cur = 'INR'").select(F.col("from_cur").alias("currency"), F.col("rate").alias("exchange_rate")))
    lines = lines.join(head, keys).join(rates, "currency", "left")
    lines = lines.withColumn("unit_landed_base", price4(F.col("unit_landed") * F.col("exchange_rate")))
    lines = lines.withColumn("line_total_base", money2(F.col("landed") * F.col("exchange_rate")))
    tests = [
        (F.col("uom_factor").isNull(), "UOM_INCOMPATIBLE"),
        (~F.coalesce(asked, F.lit(False)), "QUANTITY_MISMATCH"),
        (F.col("has_tiers") & asked & F.col("tier_no").isNull(), "TIER_NOT_APPLICABLE"),
        (F.col("exchange_rate").isNull(), "MISSING_EXCHANGE_RATE"),
        (~F.col("match_status").isin("EXACT_MATCH", "HIGH_CONFIDENCE_MATCH", "REVIEW_REQUIRED"), "UNMATCHED_ITEM"),
    ]
    blocking = F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in tests]))
    lines = lines.withColumn("issues", blocking)
    review = F.col("match_status") == "REVIEW_REQUIRED"
    lines = lines.withColumn("is_comparable", ~review & (F.size("issues") == 0)).withColumn("is_provisional", review)
    lead = F.coalesce(F.nullif("lead_time_days", F.lit(0)), F.col("lead_time_days_default"))
    return lines.withColumn("lead_time", lead)


def price_issues(prices: DataFrame) -> DataFrame:
    """Long table of the lines' issues with severity."""
    warn = F.when(F.col("is_provisional"), F.array(F.lit("REVIEW_REQUIRED_ITEM"))).otherwise(F.array().cast("array<string>"))
    rows = prices.select("rfq_id", "rfq_line_id", "supplier_id", F.explode(F.concat("issues", warn)).alias("code"))
    return rows.withColumn("severity", F.when(F.col("code") == "REVIEW_REQUIRED_ITEM", "WARNING").otherwise("BLOCKING"))


def comparison_matrix(rfq_lines: DataFrame, quotes: DataFrame, prices: DataFrame) -> DataFrame:
    """Each RFQ line against each supplier that takes part in its RFQ: priced, or a gap (INCOMPLETE_QUOTE)."""
    taking = quotes.select("rfq_id", "supplier_id").distinct()
    grid = rfq_lines.select("rfq_id", "rfq_line_id").join(taking, "rfq_id")
    cells = prices.select("rfq_id", "rfq_line_id", "supplier_id", "unit_landed_base", "line_total_base", "is_comparable", "is_provisional")
    out = grid.join(cells, ["rfq_id", "rfq_line_id", "supplier_id"], "left")
    cell = F.when(F.col("is_comparable").isNull(), "INCOMPLETE_QUOTE").when(F.col("is_comparable"), "COMPARABLE").when(F.col("is_provisional"), "PROVISIONAL").otherwise("BLOCKED")
    return out.withColumn("cell", cell).drop("is_comparable", "is_provisional")


def line_summary(matrix: DataFrame) -> DataFrame:
    """Per RFQ line, the suppliers that are comparable and provisional, and how many left a gap."""
    ids = lambda state: F.array_join(F.sort_array(F.collect_list(F.when(F.col("cell") == state, F.col("supplier_id")))), ",")
    return matrix.groupBy("rfq_id", "rfq_line_id").agg(ids("COMPARABLE").alias("comparable"), ids("PROVISIONAL").alias("provisional"), F.count_if(F.col("cell") == "INCOMPLETE_QUOTE").alias("n_gaps"))


def charge_sums(charges: DataFrame, quotes: DataFrame, fx: DataFrame) -> DataFrame:
    """Each quote's charges, net and tax, in base currency."""
    rates = F.broadcast(fx.where("to_cur = 'INR'").select(F.col("from_cur").alias("currency"), "rate"))
    keys = finance.shared(["rfq_id", "quote_id"], charges, quotes)
    rows = finance.charge_totals(charges).join(quotes.select(*keys, "currency"), keys).join(rates, "currency", "left")
    net, tax = money2(F.col("amount") * F.col("rate")), money2((F.col("total_with_tax") - F.col("amount")) * F.col("rate"))
    return rows.groupBy(*keys).agg(F.sum(net).cast(ZERO2).alias("charges_net_base"), F.sum(tax).cast(ZERO2).alias("charges_tax_base"), F.sum("total_with_tax").cast(ZERO2).alias("charges_quoted"))


def supplier_totals(prices: DataFrame, quotes: DataFrame, rfqs: DataFrame, charges: DataFrame, fx: DataFrame) -> DataFrame:
    """Each supplier's quote for an RFQ: counts, base amounts of the comparable lines, and a total where all lines are."""
    # The quantity is not rounded here: the product is divided, to 8 digits.
    product = (F.col("net_unit_price") * F.col("requested_quantity")).cast("decimal(24,6)")
    exact = F.round(product / F.coalesce("uom_factor", F.lit(1).cast("decimal(18,6)")), 8).cast("decimal(28,8)")
    net = money2(exact * F.col("exchange_rate").cast("decimal(10,4)"))
    tax = money2(F.col("line_tax") * F.col("exchange_rate"))
    on = F.col("is_comparable")
    sums = prices.groupBy("rfq_id", "supplier_id", "quote_id").agg(
        F.count("*").alias("matched_items"), F.count_if(on).alias("comparable_items"),
        F.sum(F.when(on, net)).cast(ZERO2).alias("net_base"), F.sum(F.when(on, tax)).cast(ZERO2).alias("tax_base"),
    )
    rates = F.broadcast(fx.where("to_cur = 'INR'").select(F.col("from_cur").alias("currency"), F.col("rate").alias("exchange_rate")))
    keys = finance.shared(["rfq_id", "quote_id"], quotes)
    extra = charge_sums(charges, quotes, fx)
    head = quotes.select(*keys, "supplier_name", "currency", "credit_days", "advance_pct", "lead_time_days_default").join(rates, "currency", "left")
    out = sums.join(head, keys).join(rfqs.select("rfq_id", F.col("n_lines").alias("rfq_items")), "rfq_id").join(extra, finance.shared(keys, extra), "left")
    zero = F.when(F.col("exchange_rate").isNotNull(), F.lit(0).cast(ZERO2))
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("net_base", "tax_base", "charges_net_base", "charges_tax_base")})
    out = out.withColumn("fully_comparable", F.col("exchange_rate").isNotNull() & (F.col("comparable_items") == F.col("rfq_items")))
    total = (F.col("net_base") + F.col("tax_base") + F.col("charges_net_base") + F.col("charges_tax_base")).cast(ZERO2)
    return out.withColumn("total_base", F.when(F.col("fully_comparable"), total)).withColumn("is_incomplete", F.col("matched_items") < F.col("rfq_items"))


def commercial_terms(charges: DataFrame) -> DataFrame:
    """Each quote's charges by type as a map (the last charge of a type counts) and their sum (all count)."""
    rows = finance.charge_totals(charges)
    last = rows.groupBy("quote_id", "charge_type").agg(F.max_by("total_with_tax", "charge_no").alias("amount"))
    listed = last.groupBy("quote_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("charge_type", "amount")))).alias("charges_by_type"))
    return listed.join(rows.groupBy("quote_id").agg(F.sum("total_with_tax").cast(ZERO2).alias("charges_total")), "quote_id")


def scope_pct(totals: DataFrame) -> DataFrame:
    """Comparable lines of an RFQ's lines, in whole percent."""
    return totals.select("rfq_id", "supplier_id", F.round(100.0 * F.col("comparable_items") / F.col("rfq_items")).cast("int").alias("scope_pct"))


def participants(quotes: DataFrame) -> DataFrame:
    """The quotes that take part in a comparison: the eligible ones, or all where none is."""
    eligible = F.col("supplier_status") == "ACTIVE"
    any_one = F.max(eligible).over(Window.partitionBy("rfq_id"))
    return quotes.withColumn("_any", any_one).where(eligible | ~F.col("_any")).drop("_any")
