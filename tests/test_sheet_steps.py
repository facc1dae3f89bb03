"""What follows the slices reads them as they are dealt, and finds its rules once."""

import pytest
from pyspark.sql import functions as F

from bidloom.functions import text
from bidloom.functions import vocabulary as v
from bidloom.operators import sheets
from bidloom.plans import registry  # noqa: F401  all views
from bidloom.plans.fields import Fields

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return Fields(spark, DATA)


def test_items_take_no_shuffle_after_the_slices(found):
    for rows in (sheets.main_tables(found.kinds), found.roles, found.kinded, found.items, found.docs):
        assert "Exchange hashpartitioning(" not in rows._jdf.queryExecution().executedPlan().toString()


def test_row_rules_are_not_written_out_in_filters(found):
    plan = found.kinded.where("row_kind = 'ITEM' AND row_no > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("thank you") == 1


def test_long_methods_are_not_left_uncompiled(spark, found):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


TEXTS = ["grand total 5", "grandtotal", "sub total inr", "total inr", "note: x", "quote no: 1", "min qty", "qty from 3", "qty", "reinsurance", "insurance", "freight-free", "special discount", "part no", "item code / mfg pn", "our part no.", "um", "aluminium", "tax %", "net amount", "", "min  qty"]


def test_words_sought_first_find_what_the_patterns_find(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    x = F.col("x")
    pairs = [(v.worded(x, p), x.rlike(p)) for p in (*v.ROWS.values(), v.HELPERS, v.DECOY, v.TERMS_ANYWHERE, v.CHARGE_ROWS)]
    pairs += [(v.strictly(x, r), x.rlike(v.strict(r))) for r in v.HEADERS] + [(v.says(x, r), x.rlike(v.lenient(r))) for r in v.HEADERS]
    assert rows.select(*(F.count_if(a != b) for a, b in pairs)).first() == (0,) * len(pairs)
    with pytest.raises(ValueError):
        v.worded(x, "a|b+")


def test_numbers_and_codes_are_told_in_one_pattern(spark):
    rows = spark.createDataFrame([(x,) for x in ["1", "₹ 1,250.5", "-3.", ".5", "5 %", "+1 2", "1.2.3", "- 4", "%", "", "x1", "A-", "-1", "ab", "12", "AB 12", "#", "₹,", "1-2"]], "x string")
    x = text.strip(F.col("x"))
    number = F.regexp_replace(x, r"[₹$€,\s%]", "").rlike(r"^[-+]?\d*\.?\d+$")
    kinds = sum((x.rlike(p).cast("int") for p in ("[0-9]", r"\p{L}", "[-_./#]")), F.lit(0))
    code = F.length(x).between(2, 40) & (kinds >= 2)
    assert rows.select(F.count_if(text.is_numeric(F.col("x")) != number), F.count_if(text.looks_like_identifier(F.col("x")) != code)).first() == (0, 0)
