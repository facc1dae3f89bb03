"""Item and supplier master data, review counts, and state kept from logs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.sources.stage import stored


def lookup_items(items: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key) with the item whose id or SKU equals the key in any case: two equi-joins, ids first."""
    key = F.upper(F.col("key"))
    by_id = asked.join(items.select(F.upper("internal_item_id").alias("_k"), "internal_item_id", F.lit(0).alias("by")), key == F.col("_k"))
    by_sku = asked.join(items.select(F.upper("internal_sku").alias("_k"), "internal_item_id", F.lit(1).alias("by")), key == F.col("_k"))
    return by_id.union(by_sku).groupBy("key").agg(F.min_by("internal_item_id", F.struct("by", "internal_item_id")).alias("internal_item_id"))


def _numbered(rows: DataFrame, order: list[str], top: DataFrame | None) -> DataFrame:
    """rows with the next item ids after top (one row), in that order. They are numbered by ranges of the order, each from
    where those before it end: no task sees all of them."""
    rows = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "fresh")
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(before, F.lit(0)))
    starts = starts.withColumn("top", F.lit(0)) if top is None else starts.crossJoin(F.broadcast(top))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("start") + F.coalesce("top", F.lit(0))
    return rows.join(F.broadcast(starts.drop("n")), "part").withColumn("internal_item_id", F.format_string("ITEM-%03d", nth.cast("bigint")))


def upsert_catalog(items: DataFrame, new: DataFrame, mode: str = "append") -> DataFrame:
    """The catalogue after an import of new (sku, mpn, uom, description, pos); rows without SKU or description are skipped.

    append: a known SKU changes MPN and unit only, where they are given; an unknown one gets the next number, with the
    description of its first row and the last MPN and unit that are given. replace: the old items go, and every row is one of
    its own, numbered by pos."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    new = new.select(F.upper(given("sku")).alias("sku"), given("mpn").alias("mpn"), F.upper(given("uom")).alias("uom"), given("description").alias("description"), "pos").where("sku IS NOT NULL AND description IS NOT NULL")
    out, unit = ["internal_item_id", "sku", "mpn", "uom", "description"], F.coalesce("uom", F.lit("PCS")).alias("uom")
    if mode == "replace":
        return _numbered(new.select("sku", "mpn", unit, "description", "pos"), ["pos", "sku", "description", "mpn"], None).select(*out)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("pos", c))).alias(c)
    new = new.groupBy("sku").agg(last("mpn"), last("uom"), F.min(F.struct("pos", "description")).alias("first")).select("sku", "mpn", "uom", "first.*")
    known = items.select(F.col("internal_sku").alias("sku"), "internal_item_id", "manufacturer_part_number", "stocking_uom", "canonical_description")
    both = known.join(new, "sku", "full")
    old = both.where("internal_item_id IS NOT NULL").select("internal_item_id", "sku", F.coalesce("mpn", "manufacturer_part_number").alias("mpn"), F.coalesce("uom", "stocking_uom").alias("uom"), F.col("canonical_description").alias("description"))
    fresh = both.where("internal_item_id IS NULL").select("sku", "mpn", unit, "description", "pos")
    return old.unionByName(_numbered(fresh, ["pos", "sku"], items.agg(F.max("master_pos").alias("top"))).select(*out))


def import_batches(items: DataFrame) -> DataFrame:
    """Items of each import batch: all, active, inactive."""
    return items.where("import_batch_id IS NOT NULL").groupBy("import_batch_id").agg(F.count("*").alias("remaining"), F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_if(F.col("status") != "ACTIVE").alias("inactive"))


def item_references(rfq_lines: DataFrame, matches: DataFrame, awards: DataFrame) -> DataFrame:
    """Where each item is used, by kind of owner: a union of plain projections, each owner once."""
    uses = rfq_lines.select("internal_item_id", F.lit("RFQ").alias("kind"), F.col("rfq_id").alias("owner"))
    uses = uses.union(matches.select(F.concat(F.lit("ITEM-"), F.col("item_key").cast("string")), F.lit("QUOTE"), "quote_id"))
    uses = uses.union(awards.where("supplier_id IS NOT NULL").select(F.regexp_replace("rfq_line_id", "^L-", "ITEM-"), F.lit("AWARD"), "rfq_id"))
    # Each once, then counted: several counts of distinct values would write every row as often.
    return uses.distinct().groupBy("internal_item_id").agg(*[F.count_if((F.col("kind") == k) & F.col("owner").isNotNull()).alias(f"n_{k.lower()}") for k in ("RFQ", "QUOTE", "AWARD")])


def undo_import(items: DataFrame, references: DataFrame, batch: str) -> DataFrame:
    """What undoing a batch does to its items: INACTIVE where they are quoted or awarded, else DELETE."""
    used = references.where("n_quote > 0 OR n_award > 0").select("internal_item_id", F.lit(True).alias("used"))
    out = items.where(F.col("import_batch_id") == batch).join(used, "internal_item_id", "left")
    return out.select("internal_item_id", F.when(F.col("used"), "INACTIVE").otherwise("DELETE").alias("action"))


def catalog_facets(items: DataFrame) -> DataFrame:
    return items.agg(F.array_join(F.sort_array(F.collect_set("brand")), ",").alias("brands"), F.array_join(F.sort_array(F.collect_set("stocking_uom")), ",").alias("uoms"), F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_if(F.col("status") != "ACTIVE").alias("inactive"))


def rfq_coverage(rfqs: DataFrame, matches: DataFrame) -> DataFrame:
    """Per quote: distinct RFQ lines matched and in review, and the percentage of the RFQ's lines."""
    review = F.col("match_status") == "REVIEW_REQUIRED"
    # Each once, then counted: several counts of distinct values would write every row as often.
    once = matches.select("rfq_id", "quote_id", "rfq_line_id", review.alias("review")).distinct()
    known = F.col("rfq_line_id").isNotNull()
    out = once.groupBy("rfq_id", "quote_id").agg(F.count_if(~F.col("review") & known).alias("n_matched"), F.count_if(F.col("review") & known).alias("n_review"))
    out = out.join(rfqs.select("rfq_id", "n_lines"), "rfq_id")
    state = F.when(F.col("n_review") > 0, "REVIEW").when(F.col("n_matched") == F.col("n_lines"), "COMPLETE").otherwise("PARTIAL")
    return out.withColumn("coverage_pct", F.round(F.col("n_matched") * 100.0 / F.col("n_lines"), 1)).withColumn("state", state)


def rfq_stage(rfqs: DataFrame, quotes: DataFrame, coverage: DataFrame, ranked: DataFrame, gates: DataFrame) -> DataFrame:
    """The stage of each RFQ, from what it has: quotes, open reviews, a comparison, a finalised award."""
    n = quotes.groupBy("rfq_id").agg(F.count("*").alias("n_quotes"))
    review = coverage.groupBy("rfq_id").agg(F.sum("n_review").alias("n_review"))
    rank = ranked.groupBy("rfq_id").agg(F.count_if(F.col("rank") < 999).alias("n_ranked"))
    out = rfqs.select("rfq_id").join(n, "rfq_id", "left").join(review, "rfq_id", "left").join(rank, "rfq_id", "left").join(gates.select("rfq_id", "gate"), "rfq_id", "left").fillna(0, ["n_quotes", "n_review", "n_ranked"])
    stage = F.when(F.col("gate") == "FINALIZED", "AWARD_FINALIZED").when(F.col("n_quotes") == 0, "QUOTES_PENDING").when(F.col("n_review") > 0, "MATCHING_REVIEW").when(F.col("n_ranked") > 0, "EVALUATED").otherwise("READY_FOR_COMPARISON")
    return out.select("rfq_id", "n_quotes", "n_review", stage.alias("stage"))


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last decision of each key by (ts, id); a REOPEN releases the lock, so the key has none."""
    last = log.groupBy("key").agg(F.max_by("action", F.struct("ts", "id")).alias("action"), F.max("ts").alias("decided_at"), F.count("*").alias("n_decisions"))
    return last.withColumn("is_locked", F.col("action") != "REOPEN")


def fingerprints(matches: DataFrame) -> DataFrame:
    """A content hash of each RFQ's match rows that does not depend on their order. An RFQ's row hashes are gathered in one
    array: as many as its quotes have lines."""
    row = F.sha2(F.concat_ws("|", "quote_id", F.col("line_index").cast("string"), "rfq_line_id", "match_status"), 256)
    return matches.groupBy("rfq_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ","), 256).alias("fingerprint"), F.count("*").alias("n_rows"))


def history(log: DataFrame) -> DataFrame:
    """log (key, ts, id, action, value) with revision numbers and the value before."""
    w = Window.partitionBy("key").orderBy("ts", "id")
    return log.withColumns({"revision": F.row_number().over(w), "previous": F.lag("value").over(w)})
