"""RFQs, suppliers, awards and lines over time: current state from logs, what people decided, and what refers to what."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions import text

LINE = ["quote_id", "line_index"]


def rfq_states(rfqs: DataFrame, log: DataFrame) -> DataFrame:
    """Each RFQ's state after the last of its events (rfq_id, id, ts, action): ARCHIVE and DELETE archive it, CANCEL cancels
    it, RESTORE and no event leave it active."""
    last = log.groupBy("rfq_id").agg(F.max_by("action", F.struct("ts", "id")).alias("action"), F.count("*").alias("n_events"))
    state = F.when(F.col("action").isin("ARCHIVE", "DELETE"), "ARCHIVED").when(F.col("action") == "CANCEL", "CANCELLED").otherwise("ACTIVE")
    return rfqs.select("rfq_id").join(last, "rfq_id", "left").select("rfq_id", state.alias("state"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def rfq_counts(states: DataFrame, gates: DataFrame) -> DataFrame:
    """All RFQs, and the active, closed (active with a finalised award), cancelled and archived ones."""
    rows = states.join(gates.select("rfq_id", "gate"), "rfq_id", "left")
    n = lambda x: F.count_if(x)
    active, final = F.col("state") == "ACTIVE", F.coalesce(F.col("gate") == "FINALIZED", F.lit(False))
    return rows.agg(F.count("*").alias("total"), n(active & ~final).alias("active"), n(active & final).alias("closed"), n(F.col("state") == "CANCELLED").alias("cancelled"), n(F.col("state") == "ARCHIVED").alias("archived"))


def supplier_references(suppliers: DataFrame, quotes: DataFrame, compared: DataFrame, awards: DataFrame) -> DataFrame:
    """How many quotes, comparisons and awards refer to each supplier."""
    uses = quotes.select("supplier_id", F.lit("quote").alias("kind"), F.col("quote_id").alias("owner"))
    uses = uses.union(compared.select("supplier_id", F.lit("comparison"), "rfq_id")).union(awards.where("supplier_id IS NOT NULL").select("supplier_id", F.lit("award"), "rfq_id"))
    counts = uses.distinct().groupBy("supplier_id").agg(*[F.count_if((F.col("kind") == k) & F.col("owner").isNotNull()).alias(f"n_{k}s") for k in ("quote", "comparison", "award")])
    return suppliers.select("supplier_id").join(counts, "supplier_id", "left").fillna(0)


def set_status(items: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """items with the status of those in ids set, and whether that changed anything."""
    out = items.join(ids.select("internal_item_id").distinct().withColumn("_set", F.lit(True)), "internal_item_id", "left")
    changed = F.coalesce(F.col("_set"), F.lit(False)) & (F.col("status") != status)
    return out.select("internal_item_id", F.when(F.col("_set"), status).otherwise(F.col("status")).alias("status"), changed.alias("changed"))


def name_history(suppliers: DataFrame, renames: DataFrame) -> DataFrame:
    """Every change of a supplier's name (supplier_id, renamed_at, old_name, new_name), from the name that the master has to
    the last; renames to the same name are none."""
    order = Window.partitionBy("supplier_id").orderBy("renamed_at", "id")
    rows = renames.join(suppliers.select("supplier_id", "supplier_name"), "supplier_id")
    rows = rows.withColumns({"old_name": F.coalesce(F.lag("new_name").over(order), F.col("supplier_name")), "is_current": F.lead("id").over(order).isNull()})
    return rows.where("old_name <> new_name").select("supplier_id", "renamed_at", "old_name", "new_name", "is_current")


def effective_master(items: DataFrame, rfq_lines: DataFrame) -> DataFrame:
    """Active items, and for each RFQ a record of its own (``rfq_id``) for every line whose SKU or item the master doesn't
    have: a line counts if its SKU is unknown and the first of its kind in the RFQ, or its item is. A line without SKU or item
    goes by its own id; a SKU without letters and digits is no SKU."""
    active = items.where("status = 'ACTIVE'")
    named = F.coalesce(F.nullif("sku", F.lit("")), "rfq_line_id")
    rfq_lines = rfq_lines.withColumns({"sku": named, "internal_item_id": F.coalesce("internal_item_id", "rfq_line_id")})
    code = text.norm_code(F.col("sku"))
    known = active.select(text.norm_code(F.col("internal_sku")).alias("code")).distinct().withColumn("has_code", F.lit(True))
    ids = active.select("internal_item_id").distinct().withColumn("has_id", F.lit(True))
    rows = rfq_lines.withColumn("code", code).join(known, "code", "left").join(ids, "internal_item_id", "left")
    first = lambda c: F.row_number().over(Window.partitionBy("rfq_id", c).orderBy("line_pos", "rfq_line_id")) == 1
    new = ((F.col("code") != "") & F.col("has_code").isNull() & first("code")) | (F.col("has_id").isNull() & first("internal_item_id"))
    own = rows.withColumn("new", new).where("new").select("rfq_id", "internal_item_id", F.col("sku").alias("internal_sku"), F.col("description").alias("canonical_description"))
    return active.select(F.lit(None).cast("string").alias("rfq_id"), "internal_item_id", "internal_sku", "canonical_description").unionByName(own)


def line_for_rfq(matches: DataFrame, rfq_lines: DataFrame) -> DataFrame:
    """For each RFQ line and quote the first quoted line that matched it by its RFQ line, else its item, else its SKU, as
    they are written."""
    asked = rfq_lines.select("rfq_id", "rfq_line_id", "internal_item_id", "sku")
    keys = matches.select("rfq_id", *LINE, F.col("rfq_line_id").alias("by_line"), F.col("matched_item").alias("by_item"), F.col("part_number").alias("by_sku"))
    found = None
    for rank, (own, theirs) in enumerate((("by_line", "rfq_line_id"), ("by_item", "internal_item_id"), ("by_sku", "sku"))):
        hit = keys.withColumnRenamed("rfq_id", "_r").join(asked, (F.col("_r") == F.col("rfq_id")) & (F.col(own) == F.col(theirs)))
        hit = hit.select("rfq_id", "rfq_line_id", *LINE, F.lit(rank).alias("rank"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("rfq_id", "rfq_line_id", "quote_id").agg(F.min(F.struct("rank", "line_index")).alias("m")).select("rfq_id", "rfq_line_id", "quote_id", "m.line_index", F.col("m.rank").alias("matched_by"))


def resolve_rates(pairs: DataFrame, offers: DataFrame, ttl: int = 3600) -> DataFrame:
    """The rate of each pair (from_cur, to_cur): 1 for equal ones, else of the offers (provider, provider_rank, rate, age) the
    first by rank that is positive and, if it is cached, no older than ttl seconds; MISSING where there is none."""
    good = offers.where((F.col("rate") > 0) & ((F.col("provider") != "CACHE") | (F.col("age") <= ttl)))
    best = good.groupBy("from_cur", "to_cur").agg(F.min_by(F.struct("provider", "rate"), F.struct("provider_rank", "age")).alias("b"))
    same = F.col("from_cur") == F.col("to_cur")
    out = pairs.join(best, ["from_cur", "to_cur"], "left")
    return out.select("from_cur", "to_cur", F.when(same, F.lit(1)).otherwise(F.col("b.rate")).cast("decimal(18,8)").alias("rate"), F.when(same, "IDENTITY").otherwise(F.coalesce("b.provider", F.lit("MISSING"))).alias("provider"))


def latest_comparisons(log: DataFrame) -> DataFrame:
    """The last comparison of each RFQ by (created_at, comparison_id)."""
    return log.groupBy("rfq_id").agg(F.max_by("comparison_id", F.struct("created_at", "comparison_id")).alias("comparison_id"), F.max("created_at").alias("created_at"))


def current_awards(versions: DataFrame) -> DataFrame:
    """The last version of each RFQ's award, as it was stored."""
    best = versions.groupBy("rfq_id").agg(F.max_by(F.struct("version", "status", "comparison_id", "total", "awarded_at"), "version").alias("v"), F.count("*").alias("n_versions"))
    return best.select("rfq_id", "v.*", "n_versions")


def outdated_awards(awards: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Whether a finalised award rests on a comparison that is not its RFQ's last."""
    last = comparisons.select("rfq_id", F.col("comparison_id").alias("last_comparison"))
    newer = (F.col("status") == "FINALIZED") & F.coalesce(F.col("comparison_id") != F.col("last_comparison"), F.lit(False))
    return awards.join(last, "rfq_id", "left").select("rfq_id", "version", "status", newer.alias("has_newer_comparison"))


def apply_corrections(lines: DataFrame, corrections: DataFrame, fixed: tuple[str, ...] = ("rfq_id", "supplier_id", "item_key")) -> DataFrame:
    """lines with each field's last correction (quote_id, line_index, field_name, corrected_value, corrected_at, id) in place
    of what was extracted, and how many fields that were.

    Every column but the line's key and those in fixed is a field. A correction to null empties it; values that are none of
    the field's type, fields that lines don't have and corrections of lines that are gone are dropped.
    """
    fields = [c for c in lines.columns if c not in (*LINE, *fixed)]
    last = corrections.where(F.col("field_name").isin(*fields)).groupBy(*LINE, "field_name").agg(F.max_by(F.struct("corrected_value"), F.struct("corrected_at", "id")).alias("v"))
    by_line = last.groupBy(*LINE).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "v.corrected_value"))).alias("_new"))
    out = lines.join(by_line, LINE, "left")
    counts, columns = [], {}
    for f in fields:
        kind, raw = lines.schema[f].dataType.simpleString(), F.try_element_at("_new", F.lit(f))
        value = raw.try_cast(kind)
        taken = F.coalesce(F.map_contains_key("_new", F.lit(f)), F.lit(False)) & (raw.isNull() | value.isNotNull())
        columns[f] = F.when(taken, value).otherwise(F.col(f)).cast(kind)
        counts.append(taken.cast("int"))
    return out.withColumns(columns | {"n_corrected": sum(counts[1:], counts[0])}).drop("_new")


def workspace(rfqs: DataFrame, stages: DataFrame, coverage: DataFrame) -> DataFrame:
    """Each RFQ's counts of lines and quotes, its stage and what to do next."""
    counts = coverage.groupBy("rfq_id").agg(F.count_if(F.col("state") == "COMPLETE").alias("n_complete"), F.count_if(F.col("state") == "REVIEW").alias("n_in_review"))
    todo = {"QUOTES_PENDING": "COLLECT_QUOTES", "MATCHING_REVIEW": "REVIEW_MATCHES", "READY_FOR_COMPARISON": "RUN_COMPARISON", "EVALUATED": "PREPARE_AWARD", "AWARD_FINALIZED": "EXPORT_AWARD"}
    step = F.lit(None).cast("string")
    for stage, then in todo.items():
        step = F.when(F.col("stage") == stage, then).otherwise(step)
    out = rfqs.select("rfq_id", "n_lines").join(stages.select("rfq_id", "stage", "n_quotes"), "rfq_id").join(counts, "rfq_id", "left").fillna(0, ["n_complete", "n_in_review"])
    return out.withColumn("next_action", step)


def dashboard(rfqs: DataFrame, quotes: DataFrame, items: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Counts of what there is, one row for each."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in (("rfqs", rfqs), ("quotes", quotes), ("items", items), ("active_items", items.where("status = 'ACTIVE'")), ("active_suppliers", suppliers.where("status = 'ACTIVE'")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def allocation_view(proposal: DataFrame, rfq_lines: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The award's allocation sheet: each line with its supplier, price, value, state, and whether that is the line's lowest."""
    out = proposal.join(rfq_lines.select("rfq_id", "rfq_line_id", "sku", "description", "requested_uom"), ["rfq_id", "rfq_line_id"]).join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
    return out.select(
        "rfq_id", "rfq_line_id", "sku", "description", F.col("requested_quantity").alias("required_qty"), "requested_uom", F.coalesce("supplier_name", F.lit("UNALLOCATED")).alias("supplier_name"),
        "quote_id", "unit_cost", "line_value", "allocation_state", F.when(F.coalesce("is_l1_for_line", F.lit(False)), "YES").otherwise("NO").alias("l1_line_optimal"),
    )


def award_summary(totals: DataFrame) -> DataFrame:
    """An award's totals as (rfq_id, label, value)."""
    rows = {"Total value": F.col("total_value").cast("string"), "Lines allocated": F.col("n_full").cast("string"), "Lines open": F.col("n_open").cast("string"), "Suppliers": F.col("n_suppliers").cast("string")}
    return totals.select("rfq_id", F.inline(F.array(*[F.struct(F.lit(k).alias("label"), x.alias("value")) for k, x in rows.items()])))


def requisitions(proposal: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The lines that each supplier is to deliver, and each RFQ's total for that supplier."""
    total = F.sum("line_value").over(Window.partitionBy("rfq_id", "supplier_id")).cast("decimal(18,2)")
    rows = proposal.where("supplier_id IS NOT NULL").withColumn("supplier_total", total).join(suppliers.select("supplier_id", "supplier_name"), "supplier_id")
    return rows.select("rfq_id", "supplier_id", "supplier_name", "quote_id", "rfq_line_id", "requested_quantity", "unit_cost", "line_value", "supplier_total")


def erp_export(proposal: DataFrame, rfq_lines: DataFrame, suppliers: DataFrame, rfqs: DataFrame, awards: DataFrame) -> DataFrame:
    """The flat export's 16 columns, in order, as texts: commas in names become semicolons, a line without supplier is a
    sentinel row, and what is not known yet (an award not finalised has no date) is empty."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), ",", ";")
    none = F.col("supplier_id").isNull()
    text = lambda c, sentinel: F.when(none, sentinel).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("0")))
    rows = proposal.join(rfq_lines.select("rfq_id", "rfq_line_id", "sku", "description", "requested_uom"), ["rfq_id", "rfq_line_id"]).join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
    rows = rows.join(rfqs.select("rfq_id", "base_currency"), "rfq_id", "left").join(awards.select("rfq_id", "version", "status", "comparison_id", "awarded_at"), "rfq_id", "left")
    number = F.concat(F.lit("AWD-"), F.col("rfq_id"), F.when(F.col("version").isNotNull(), F.concat(F.lit("-"), F.col("version").cast("string"))).otherwise(""))
    return rows.select(
        "rfq_id", "rfq_line_id", plain(F.col("sku")).alias("item_sku"), plain(F.col("description")).alias("item_description"), F.coalesce(F.col("requested_quantity").cast("string"), F.lit("0")).alias("required_qty"),
        F.coalesce("requested_uom", F.lit("PCS")).alias("required_uom"), F.when(none, "UNALLOCATED").otherwise(plain(F.coalesce("supplier_name", "supplier_id"))).alias("supplier_name"), text("supplier_id", "N/A").alias("supplier_id"), text("quote_id", "N/A").alias("quote_id"),
        text("requested_quantity", "0").alias("awarded_qty"), text("unit_cost", "0.00").alias("unit_landed_cost"), text("line_value", "0.00").alias("line_total_value"), F.coalesce("base_currency", F.lit("INR")).alias("base_currency"),
        F.coalesce("comparison_id", F.lit("")).alias("comparison_id"), number.alias("award_id"), F.when(F.col("status") == "FINALIZED", F.date_format("awarded_at", "yyyy-MM-dd")).otherwise("").alias("awarded_at"),
    )


def finalise(gates: DataFrame, awards: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """What a request to finalise comes to: an award that is finalised already is left alone, errors reject it, open
    quantities do unless they are acknowledged (rfq_id)."""
    rows = gates.select("rfq_id", "gate").join(awards.select("rfq_id", "status"), "rfq_id", "left").join(acknowledged.select("rfq_id", F.lit(True).alias("_known")), "rfq_id", "left")
    out = F.when(F.col("status") == "FINALIZED", "REJECTED_ALREADY_FINALIZED").when(F.col("gate") == "REJECTED", "REJECTED_WITH_ERRORS")
    return rows.select("rfq_id", out.when((F.col("gate") == "NEEDS_ACKNOWLEDGEMENT") & F.col("_known").isNull(), "REJECTED_UNALLOCATED").otherwise("FINALIZED").alias("outcome"))


def repeated_allocations(submitted: DataFrame) -> DataFrame:
    """Of allocations (rfq_id, rfq_line_id, alloc_no, …) those of a line that an earlier one has: each is an error, where
    several splits within one allocation are none."""
    first = F.min("alloc_no").over(Window.partitionBy("rfq_id", "rfq_line_id"))
    return submitted.withColumn("first", first).where(F.col("alloc_no") > F.col("first")).select("rfq_id", "rfq_line_id", "alloc_no", F.lit("DUPLICATE_LINE").alias("error"))


def final_status(matched: DataFrame, units: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """A line's match state: UOM_INCOMPATIBLE where its item's unit can't be reached, else EXACT_MATCH by a code, else its
    best candidate's state (quote_id, line_index, status), else UNMATCHED. units: (quote_id, line_index, uom_factor)."""
    rows = matched.join(units.select(*LINE, F.lit(True).alias("_unit"), "uom_factor"), LINE, "left")
    rows = rows.join(candidates.select(*LINE, F.col("status").alias("_best")), LINE, "left") if candidates is not None else rows.withColumn("_best", F.lit(None).cast("string"))
    known = F.col("match_method") != "NO_MATCH"
    bad = (known | (F.coalesce("_best", F.lit("UNMATCHED")) != "UNMATCHED")) & F.col("_unit") & F.col("uom_factor").isNull()
    state = F.when(F.coalesce(bad, F.lit(False)), "UOM_INCOMPATIBLE").when(known, "EXACT_MATCH").otherwise(F.coalesce("_best", F.lit("UNMATCHED")))
    return rows.select(*LINE, state.alias("match_state"))


def award_revisions(versions: DataFrame) -> DataFrame:
    """The reopenings of each RFQ's award (rfq_id, version, status, comparison_id, total, awarded_at), numbered in order, with
    the status, comparison and total of the version before; an award that begins reopened has none before."""
    order = Window.partitionBy("rfq_id").orderBy("version")
    before = {f"previous_{c}": F.lag(c).over(order) for c in ("status", "comparison_id", "total")}
    rows = versions.withColumns({"reopened": F.col("status") == "REOPENED", **before})
    rows = rows.withColumn("revision", F.count_if("reopened").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("reopened").select("rfq_id", "revision", F.col("awarded_at").alias("reopened_at"), *before)
