"""Line amounts, tiers, charges and quote totals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.money import money2, percent, price4

LINE = ["quote_id", "line_index"]


def shared(keys: list[str], *tables: DataFrame) -> list[str]:
    """Those of keys that all tables have: a quote's RFQ may stand beside it in a key, so that tables dealt by RFQ meet as
    they are."""
    return [k for k in keys if all(k in t.columns for t in tables)]


def line_amounts(lines: DataFrame) -> DataFrame:
    """Gross, discount, taxable, tax and landed amount; each is rounded to 0.01 before the next."""
    out = lines.withColumn("gross", money2(F.col("quoted_qty") * F.col("unit_price")))
    out = out.withColumn("discount", money2(F.col("gross") * F.col("discount_pct") * percent()))
    out = out.withColumn("taxable", (F.col("gross") - F.col("discount")).cast("decimal(18,2)"))
    out = out.withColumn("tax", money2(F.col("taxable") * F.col("tax_rate_pct") * percent()))
    return out.withColumn("landed", (F.col("taxable") + F.col("tax")).cast("decimal(18,2)"))


def net_unit_price(lines: DataFrame) -> DataFrame:
    """The price after discount to 0.0001, where none is given."""
    keep = (100 - F.col("discount_pct")).cast("decimal(9,4)")
    net = price4(F.col("unit_price") * keep * percent())
    given = F.col("net_unit_price") if "net_unit_price" in lines.columns else F.lit(None).cast("decimal(18,4)")
    return lines.withColumn("net_unit_price", F.coalesce(given, net))


def line_landed_4dp(lines: DataFrame) -> DataFrame:
    """The engine's variant: gross, net and tax to 0.0001, landed to 0.01."""
    out = lines.withColumn("gross4", price4(F.col("quoted_qty") * F.col("unit_price")))
    keep = (100 - F.col("discount_pct")).cast("decimal(9,4)")
    out = out.withColumn("net4", price4(F.col("gross4") * keep * percent()))
    out = out.withColumn("tax4", price4(F.col("net4") * F.col("tax_rate_pct") * percent()))
    return out.withColumn("landed2", money2(F.col("net4") + F.col("tax4")))


def charge_totals(charges: DataFrame) -> DataFrame:
    """Each charge's total with tax."""
    total = money2(F.col("amount") + F.col("amount") * F.col("tax_rate_pct") * percent())
    return charges.withColumn("total_with_tax", total)


def quote_totals(lines: DataFrame, charges: DataFrame) -> DataFrame:
    """Landed lines and charges of each quote. Both sides are summed before they meet, so neither multiplies the other."""
    sums = line_amounts(lines).groupBy("quote_id").agg(F.sum("landed").cast("decimal(18,2)").alias("lines_total"))
    extra = charge_totals(charges).groupBy("quote_id").agg(F.sum("total_with_tax").cast("decimal(18,2)").alias("charges_total"))
    zero = F.lit(0).cast("decimal(18,2)")
    out = sums.join(extra, "quote_id", "left").withColumn("charges_total", F.coalesce("charges_total", zero))
    return out.withColumn("quote_total", (F.col("lines_total") + F.col("charges_total")).cast("decimal(18,2)"))


def _with_tiers(lines: DataFrame, tiers: DataFrame) -> DataFrame:
    """lines with their tiers as an array; a line has a few."""
    keys = shared(["rfq_id", *LINE], lines, tiers)
    own = tiers.groupBy(*keys).agg(F.collect_list(F.struct("tier_no", "min_qty", "max_qty", F.col("unit_price").alias("tier_price"))).alias("tiers"))
    return lines.join(own, keys, "left")


def _fits(qty: str):
    return lambda x: (x["min_qty"] <= F.col(qty)) & (x["max_qty"].isNull() | (F.col(qty) <= x["max_qty"]))


def effective_price(lines: DataFrame, tiers: DataFrame, qty: str = "quoted_qty") -> DataFrame:
    """The price that holds at qty: of the tiers that cover it the one from the greatest quantity on, discounted; else the net price."""
    out = _with_tiers(net_unit_price(lines), tiers)
    best = F.array_max(F.transform(F.filter("tiers", _fits(qty)), lambda x: F.struct(x["min_qty"], x["tier_price"])))["tier_price"]
    keep = (100 - F.col("discount_pct")).cast("decimal(9,4)")
    return out.withColumn("effective_price", F.coalesce(price4(best * keep * percent()), F.col("net_unit_price"))).drop("tiers")


def first_tier(lines: DataFrame, tiers: DataFrame, qty: str) -> DataFrame:
    """lines with the first tier in list order that covers qty (tier_no, tier_price) and whether the line has tiers at all."""
    out = _with_tiers(lines, tiers).withColumn("first", F.array_min(F.filter("tiers", _fits(qty))))
    return out.withColumns({"has_tiers": F.col("tiers").isNotNull(), "tier_no": F.col("first.tier_no"), "tier_price": F.col("first.tier_price")}).drop("tiers", "first")


def reconcile(totals: DataFrame, stated: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Calculated against stated totals (quote_id, stated_total): RECONCILED, DISCREPANCY or CALCULATED_ONLY."""
    out = totals.join(stated, "quote_id", "left")
    gap = (F.col("stated_total") - F.col("quote_total")).cast("decimal(18,2)")
    status = F.when(F.col("stated_total").isNull(), "CALCULATED_ONLY").when(F.abs(gap) <= tolerance, "RECONCILED").otherwise("DISCREPANCY")
    return out.withColumn("discrepancy", gap).withColumn("status", status)


#: What validation finds in a document's header rather than in its lines.
HEADER_ISSUES = ("SUPPLIER_UNKNOWN", "QUOTE_NUMBER_MISSING")


def quote_issues(quotes: DataFrame, lines: DataFrame, units: list[str]) -> DataFrame:
    """Long table (quote_id, line_index, code, severity): what validation finds in headers and lines."""
    none = F.lit(None).cast("int")

    def rows(df: DataFrame, index, tests: list[tuple]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for t, c, s in tests]))
        return df.select("quote_id", index.alias("line_index"), F.inline(found))

    head = rows(quotes, none, [
        (F.coalesce(F.col("supplier_name"), F.lit("Unknown Supplier")) == "Unknown Supplier", "SUPPLIER_UNKNOWN", "HIGH"),
        (F.coalesce(F.col("quote_number"), F.lit("")) == "", "QUOTE_NUMBER_MISSING", "LOW"),
        (F.coalesce(F.col("n_lines"), F.lit(0)) == 0, "NO_LINE_ITEMS", "CRITICAL"),
    ])
    body = rows(lines, F.col("line_index"), [
        (F.col("unit_price") <= 0, "UNIT_PRICE_INVALID", "HIGH"),
        (F.col("quoted_qty") <= 0, "QUANTITY_INVALID", "HIGH"),
        (~F.upper(F.trim("quoted_uom")).isin(units), "UOM_NON_STANDARD", "MEDIUM"),
        (F.length(F.trim("raw_description")) < 2, "SHORT_DESCRIPTION", "MEDIUM"),
    ])
    return head.unionByName(body)


def confidence(issues: DataFrame, quotes: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Confidence from penalties by severity, capped by the worst of them; that of the header, the lines and the sums by
    themselves; and the document's status."""
    penalty = {"CRITICAL": 0.50, "HIGH": 0.25, "MEDIUM": 0.10, "LOW": 0.05}
    header = F.col("code").isin(*HEADER_ISSUES)
    sums = issues.groupBy("quote_id").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in penalty], F.count_if(header).alias("n_header"), F.count_if(~header).alias("n_items"))
    out = quotes.select("quote_id").join(sums, "quote_id", "left").join(reconciled.select("quote_id", "status"), "quote_id", "left").fillna(0)
    off = F.coalesce(F.col("status") == "DISCREPANCY", F.lit(False)).cast("int")
    raw = 1.0 - sum((F.col(s.lower()) * p for s, p in penalty.items()), 0.25 * off)
    capped = F.when(F.col("critical") > 0, F.least(raw, F.lit(0.30))).when(off == 1, F.least(raw, F.lit(0.55))).when(F.col("high") > 0, F.least(raw, F.lit(0.65))).otherwise(raw)
    part = lambda loss: F.greatest(F.round(1.0 - loss, 2), F.lit(0.10))
    out = out.withColumns({
        "confidence": F.round(F.greatest(capped, F.lit(0.10)), 2), "metadata_confidence": part(0.25 * F.col("n_header")), "line_item_confidence": part(0.15 * F.col("n_items")), "financial_confidence": part(0.40 * off),
    })
    state = (
        F.when(F.col("critical") > 0, "INSUFFICIENT_DATA").when(F.col("status") == "DISCREPANCY", "DISCREPANCY").when((F.col("high") > 0) | (F.col("medium") > 0), "REVIEW_REQUIRED").otherwise(F.col("status"))
    )
    valid = (F.col("critical") == 0) & (F.col("high") == 0) & (off == 0)
    return out.select("quote_id", "critical", "high", "medium", "low", "confidence", "metadata_confidence", "line_item_confidence", "financial_confidence", state.alias("document_status"), valid.alias("is_valid"))
