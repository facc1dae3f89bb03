"""What a reviewer is shown, and extraction accuracy against a truth."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_issues(prices: DataFrame, matched: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Long table (quote_id, line_index, code, severity) of lines and quotes that need a person."""

    def rows(df: DataFrame, index, code: str, severity: str) -> DataFrame:
        return df.select("quote_id", index.cast("int").alias("line_index"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))

    line = F.col("line_index")
    return reduce(DataFrame.unionByName, [
        rows(prices.where("is_provisional"), line, "MATCH_REVIEW_REQUIRED", "MEDIUM"),
        rows(prices.where("uom_factor IS NULL"), line, "UOM_INCOMPATIBLE", "HIGH"),
        rows(matched.where("matched_item IS NULL"), line, "UNMATCHED_ITEM", "HIGH"),
        rows(reconciled.where("status = 'DISCREPANCY'"), F.lit(None), "FINANCIAL_DISCREPANCY", "HIGH"),
    ])


def quote_listing(quotes: DataFrame, totals: DataFrame, coverage: DataFrame) -> DataFrame:
    """Each quote with its total and coverage, and defaults where it has none."""
    out = quotes.select("quote_id", "rfq_id", "supplier_name", "currency", "n_lines").join(totals.select("quote_id", "quote_total"), "quote_id", "left").join(coverage.select("quote_id", "coverage_pct", "state"), "quote_id", "left")
    return out.withColumns({"quote_total": F.coalesce("quote_total", F.lit(0).cast("decimal(18,2)")), "coverage_pct": F.coalesce("coverage_pct", F.lit(0.0)), "state": F.coalesce("state", F.lit("PENDING"))})


def field_accuracy(actual: DataFrame, truth: DataFrame) -> DataFrame:
    """Per quote, the percentage of true lines whose quantity, unit, price (exact) and landed amount (within 1) are right; lines meet by position."""
    fields = ["quoted_qty", "quoted_uom", "unit_price", "landed"]
    pick = lambda df, p: df.select("quote_id", "line_index", *[F.col(c).alias(f"{p}{c}") for c in fields])
    both = pick(truth, "t_").join(pick(actual, "a_"), ["quote_id", "line_index"], "left")
    right = {c: F.col(f"t_{c}").eqNullSafe(F.col(f"a_{c}")) for c in fields[:3]} | {"landed": F.coalesce(F.abs(F.col("t_landed") - F.col("a_landed")) <= 1, F.lit(False))}
    return both.groupBy("quote_id").agg(F.count("*").alias("n_lines"), *[F.round(100 * F.avg(ok.cast("int")), 2).alias(f"{c}_pct") for c, ok in right.items()])
