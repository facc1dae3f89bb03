"""Quote lines, quotes and line prices are dealt by RFQ once; what follows reads them as they are."""

from pyspark.sql import functions as F

from bidloom.operators import award, master
from bidloom.plans import registry  # noqa: F401  all views
from bidloom.plans.commercial import Tables
from bidloom.sources.domain import DEALT, VIEWS, table

DATA = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_dealt_views_give_the_rows_of_the_views(spark, monkeypatch):
    made = {name: table(spark, DATA, name) for name in DEALT}
    monkeypatch.setattr("bidloom.sources.domain.DEALT", {})
    for name, rows in made.items():
        plain = table(spark, DATA, name)
        rows = rows.select(*plain.columns)
        assert plain.count() > 0
        assert plain.exceptAll(rows).isEmpty() and rows.exceptAll(plain).isEmpty(), name


def test_every_dealt_word_is_in_its_view():
    for name, pairs in DEALT.items():
        for words, _ in pairs:
            assert VIEWS[name].count(words) == 1, (name, words)


def test_bids_and_coverage_take_no_shuffle_of_the_lines(spark):
    tables = Tables(spark, DATA)
    assert shuffles(award.bids(tables.prices())) == 0
    lines = tables.matches.select("rfq_id", "quote_id", "rfq_line_id", "match_status")
    assert "raw_description" not in tables.prices().columns
    assert "Expand" not in master.rfq_coverage(tables.rfqs, lines)._jdf.queryExecution().executedPlan().toString()


def test_owners_without_a_name_are_not_counted(spark):
    lines = spark.createDataFrame([("I-1", None), ("I-1", "R-1"), ("I-1", "R-1"), ("I-2", None)], "internal_item_id string, rfq_id string")
    none = spark.createDataFrame([], "item_key bigint, quote_id string"), spark.createDataFrame([], "rfq_line_id string, supplier_id string, rfq_id string")
    found = {r.internal_item_id: (r.n_rfq, r.n_quote, r.n_award) for r in master.item_references(lines, *none).collect()}
    assert found == {"I-1": (1, 0, 0), "I-2": (0, 0, 0)}


def test_quotes_of_lines_are_counted_once(spark):
    rows = [("R", "Q", "L1", "EXACT_MATCH"), ("R", "Q", "L1", "EXACT_MATCH"), ("R", "Q", "L1", "REVIEW_REQUIRED"), ("R", "Q", None, "REVIEW_REQUIRED"), ("R", "Q", "L2", None)]
    matches = spark.createDataFrame(rows, "rfq_id string, quote_id string, rfq_line_id string, match_status string")
    rfqs = spark.createDataFrame([("R", 2)], "rfq_id string, n_lines int")
    got = master.rfq_coverage(rfqs, matches).select("n_matched", "n_review", F.col("state")).collect()
    assert [tuple(r) for r in got] == [(1, 1, "REVIEW")]
