"""Units of measure: dimensions and conversion factors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.money import factor6


def with_factor(lines: DataFrame, units: DataFrame, source: str, target: str, factors: str | None = None, overrides: str | None = None) -> DataFrame:
    """lines with ``uom_factor`` (target units per source unit) and ``uom_method``; both units and rates as in units (unit, dimension, rate).

    Equal units convert by 1, then an approved factor (maps by source unit: overrides, as of an RFQ line, before factors, as
    of an item) counts, then the rates of one dimension; else the factor is null and the method INCOMPATIBLE (MISSING_UOM where a unit is not given).
    """
    code = lambda c: F.upper(F.trim(F.col(c)))
    src = F.broadcast(units.select(F.col("unit").alias("_su"), F.col("dimension").alias("_sd"), F.col("rate").alias("_sr")))
    tgt = F.broadcast(units.select(F.col("unit").alias("_tu"), F.col("dimension").alias("_td"), F.col("rate").alias("_tr")))
    joined = lines.join(src, code(source) == F.col("_su"), "left").join(tgt, code(target) == F.col("_tu"), "left")
    maps = [F.try_element_at(c, code(source)) for c in (overrides, factors) if c]
    approved = F.coalesce(*maps) if maps else F.lit(None).cast("decimal(18,6)")
    same = (F.col("_sd") == F.col("_td")) & F.col("_sr").isNotNull() & (F.col("_tr") > 0)
    one = F.lit(1).cast("decimal(18,6)")
    missing = F.col(source).isNull() | F.col(target).isNull()
    rate = factor6(F.col("_sr") / F.col("_tr"))
    factor = F.when(missing, None).when(code(source) == code(target), one).when(approved.isNotNull(), approved).when(same, rate)
    method = F.when(missing, "MISSING_UOM").when(code(source) == code(target), "EXACT_UOM_MATCH").when(approved.isNotNull(), "ITEM_MASTER_FACTOR").when(same, "STANDARD_DIMENSION").otherwise("INCOMPATIBLE")
    return joined.withColumns({"uom_factor": factor.cast("decimal(18,6)"), "uom_method": method}).drop("_su", "_sd", "_sr", "_tu", "_td", "_tr")


def dimension(units: DataFrame) -> DataFrame:
    """Units by dimension, with how many of them have a rate."""
    return units.groupBy("dimension").agg(F.count("*").alias("n_units"), F.count("rate").alias("n_rates"), F.array_join(F.sort_array(F.collect_list("unit")), ",").alias("units"))
