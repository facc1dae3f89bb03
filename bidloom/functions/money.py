"""Decimal arithmetic that rounds half up after every step."""

from pyspark.sql import Column
from pyspark.sql import functions as F



def percent() -> Column:
    return F.lit("0.01").cast("decimal(3,2)")


def money2(x: Column) -> Column:
    return F.round(x, 2).cast("decimal(18,2)")


def price4(x: Column) -> Column:
    return F.round(x, 4).cast("decimal(18,4)")


def factor6(x: Column) -> Column:
    return F.round(x, 6).cast("decimal(18,6)")


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, null for a whole of 0."""
    return F.round(part.cast("decimal(20,2)") * 100 / F.nullif(whole.cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")), digits).cast("decimal(9,2)")
