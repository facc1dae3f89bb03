"""Quotation sheets: from cells to rows, tables, their kinds, their columns' roles and their rows' kinds.

Rows are (doc_id, sheet, sheet_name, row_no, is_hidden, cells array<string>). Everything is partitioned by document, so one
shuffle by doc_id serves a whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions import text as t
from bidloom.functions import vocabulary as v

SHEET = ["doc_id", "sheet"]
TABLE = ["doc_id", "sheet", "table_no"]
#: Between cells that one pattern is sought in: no pattern of the vocabulary reaches over it.
APART = "\x01"


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: c != "")


def low(c: Column) -> Column:
    return F.lower(t.strip(c))


def cells_of(rows: DataFrame) -> DataFrame:
    """Rows as (doc_id, sheet, row_no, col_no, value), blank cells too."""
    return rows.select("doc_id", "sheet", "row_no", F.posexplode("cells").alias("col_no", "value"))


def fill_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Blank cells of a merged range (doc_id, sheet, min_row, max_row, min_col, max_col) with its top left value. A cell in
    several ranges takes the first by min_row, then min_col. A sheet's ranges come together in one array."""
    top = cells.select("doc_id", "sheet", F.col("row_no").alias("min_row"), F.col("col_no").alias("min_col"), F.col("value").alias("top"))
    ranges = merges.join(top, [*SHEET, "min_row", "min_col"]).groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("min_row", "min_col", "max_row", "max_col", "top"))).alias("ranges"))
    covers = lambda m: F.col("row_no").between(m["min_row"], m["max_row"]) & F.col("col_no").between(m["min_col"], m["max_col"])
    out = cells.join(ranges, SHEET, "left").withColumn("m", F.when(F.col("value") == "", F.get(F.filter("ranges", covers), F.lit(0))))
    return out.select(*SHEET, "row_no", "col_no", F.coalesce("m.top", "value").alias("value"), F.col("m").isNotNull().alias("is_merged"))


def fill_merged_rows(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """``fill_merges`` of whole rows, as cells. Ranges meet rows by document, and a document's top left values are gathered
    over its rows, so that cells are neither dealt nor sorted."""
    ranges = merges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sheet", "min_row", "min_col", "max_row", "max_col"))).alias("ranges"))
    rows = rows.join(ranges, "doc_id", "left")
    begin = F.filter("ranges", lambda m: (m["sheet"] == F.col("sheet")) & (m["min_row"] == F.col("row_no")) & (m["min_col"] < F.size("cells")))
    tops = F.transform(begin, lambda m: F.struct(m["sheet"].alias("sheet"), m["min_row"].alias("row_no"), m["min_col"].alias("col_no"), F.get("cells", m["min_col"]).alias("value")))
    rows = rows.withColumn("tops", F.flatten(F.collect_list(tops).over(Window.partitionBy("doc_id"))))
    top = lambda m: F.get(F.filter("tops", lambda x: (x["sheet"] == m["sheet"]) & (x["row_no"] == m["min_row"]) & (x["col_no"] == m["min_col"])), F.lit(0))
    here = F.filter("ranges", lambda m: (m["sheet"] == F.col("sheet")) & F.col("row_no").between(m["min_row"], m["max_row"]))
    with_top = F.transform(here, lambda m: F.struct(m["min_col"].alias("min_col"), m["max_col"].alias("max_col"), top(m).alias("top")))
    rows = rows.withColumn("here", F.filter(with_top, lambda m: m["top"].isNotNull()))
    first = lambda i: F.get(F.filter("here", lambda m: i.between(m["min_col"], m["max_col"])), F.lit(0))["top"]["value"]
    cells = F.transform("cells", lambda c, i: F.struct(i.alias("col_no"), c.alias("own"), F.when((c == "") & (F.size("here") > 0), first(i)).alias("top")))
    return rows.select(*SHEET, "row_no", F.inline(cells)).select(*SHEET, "row_no", "col_no", F.coalesce("top", "own").alias("value"), F.col("top").isNotNull().alias("is_merged"))


def visible_rows(rows: DataFrame, policy: str = "SMART_INCLUDE") -> DataFrame:
    """EXCLUDE_ALL leaves hidden rows out; SMART_INCLUDE and FLAG_REVIEW keep them flagged."""
    return rows.where("NOT is_hidden") if policy == "EXCLUDE_ALL" else rows


def assemble_rows(cells: DataFrame, **keep: Column) -> DataFrame:
    """Cells as rows, without blanks at the end; a row without any value is an empty array. keep: aggregates of a row's cells
    that become columns of it."""
    values = F.map_from_entries(F.collect_list(F.when(F.col("value") != "", F.struct("col_no", "value"))))
    last = F.max(F.when(F.col("value") != "", F.col("col_no")))
    rows = cells.groupBy("doc_id", "sheet", "row_no").agg(values.alias("values"), last.alias("last"), *(c.alias(name) for name, c in keep.items()))
    row = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("values", i), F.lit("")))
    return rows.select("doc_id", "sheet", "row_no", *keep, F.when(F.col("last").isNull(), F.array().cast("array<string>")).otherwise(row).alias("cells"))


def rows_of_cells(cells: DataFrame, policy: str = "SMART_INCLUDE") -> DataFrame:
    """Cells as ``read_cells`` gives them as rows. EXCLUDE_ALL leaves hidden rows out, and hidden columns' cells are blank, so
    that the others keep their places; under the other policies both are there, hidden rows flagged."""
    if policy == "EXCLUDE_ALL":
        cells = cells.where("NOT is_hidden_row").withColumn("value", F.when(F.col("is_hidden_col"), "").otherwise(F.col("value")))
    return assemble_rows(cells, sheet_name=F.max("sheet_name"), is_hidden=F.bool_or("is_hidden_row"))


def cell_profile(cells: DataFrame) -> DataFrame:
    """Per sheet: cells with a value, cells with a formula, hidden rows and hidden columns."""
    rows = cells.groupBy(*SHEET, "row_no").agg(F.count_if(F.col("value") != "").alias("n_cells"), F.count_if("has_formula").alias("n_formulas"), F.bool_or("is_hidden_row").alias("hidden"), F.collect_set(F.when(F.col("is_hidden_col"), F.col("col_no"))).alias("columns"))
    columns = F.size(F.array_distinct(F.flatten(F.collect_set("columns"))))
    return rows.groupBy(*SHEET).agg(F.sum("n_cells").alias("n_cells"), F.sum("n_formulas").alias("n_formulas"), F.count_if("hidden").alias("n_hidden_rows"), columns.cast("bigint").alias("n_hidden_cols"))


def sheet_profile(rows: DataFrame) -> DataFrame:
    """Size and density of each sheet; the densest one of a document, the first of equals, is primary."""
    n = F.sum(F.size(filled(F.col("cells"))))
    out = rows.groupBy("doc_id", "sheet").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_cols"), n.alias("n_filled"), F.count_if("is_hidden").alias("n_hidden"))
    out = out.withColumn("density", F.round(F.try_divide(F.col("n_filled"), F.col("n_rows") * F.col("n_cols")), 4))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("density"), "sheet"))
    return out.withColumn("is_primary", first == 1)


def regions(rows: DataFrame) -> DataFrame:
    """Runs of visible rows between blank ones, each as HEADER_METADATA, TABLE, POST_TABLE_METADATA or UNKNOWN.

    Whether a table came before is a running maximum of what makes a table by itself: the first table never depends on it.
    """
    order = Window.partitionBy(*SHEET).orderBy("row_no")
    has = filled(F.transform("cells", t.strip))
    rows = rows.where("NOT is_hidden").withColumns({"n": F.size(has), "numbers": F.size(F.filter(has, lambda c: F.regexp_replace(c, r"[^0-9.\-+]", "").rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)$")))})
    header = (F.col("n") >= 2) & (F.try_divide("numbers", "n") <= 0.5) & F.array_join(has, " ").rlike(v.HEADER_WORDS)
    begins = (F.col("n") > 0) & (F.coalesce(F.lag("n").over(order), F.lit(0)) == 0)
    rows = rows.withColumns({"header": F.coalesce(header, F.lit(False)), "region": F.sum(begins.cast("int")).over(order)}).where("n > 0")
    out = rows.groupBy(*SHEET, "region").agg(
        F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.max(F.size("cells")).alias("n_cols"), F.avg(F.col("n") / F.size("cells")).alias("density"),
        F.min_by("header", "row_no").alias("header"), F.max(F.array_join("cells", " ").rlike(v.TERMINAL)).alias("terminal"),
    )
    # The words that close a sheet only count after a table.
    dense = (F.col("n_cols") >= 2) & (F.col("density") >= 0.15)
    before = F.coalesce(F.max(dense & F.col("header")).over(Window.partitionBy(*SHEET).orderBy("region").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    kind = (
        F.when(F.col("terminal") & before, "POST_TABLE_METADATA").when(~dense, F.when(before, "POST_TABLE_METADATA").otherwise("HEADER_METADATA"))
        .when(F.col("header"), "TABLE").when(~before, "HEADER_METADATA").otherwise("POST_TABLE_METADATA")
    )
    return out.withColumn("kind", kind).select("doc_id", "sheet", "region", "first_row", "last_row", "n_cols", F.round("density", 4).alias("density"), "kind")


def said(cells: Column) -> Column:
    """A row's values in lower case, a space apart; empty for a blank row."""
    return F.lower(F.array_join(F.array_remove(cells, ""), " "))


def scored(rows: DataFrame) -> DataFrame:
    """rows with how much each looks like a table's header: ``score``, 0 where it doesn't."""
    before = rows.columns
    rows = rows.withColumn("_said", said(F.col("cells")))
    # Most rows hold one value, mostly plain numbers, or too few header words, which plain texts tell: only the others are read
    # cell by cell.
    rows = rows.withColumn("_filled", filled(F.col("cells")))
    plain = F.size(F.filter("_filled", lambda c: c.rlike(r"^[₹$€]?\d+(?:\.\d+)?$")))
    few = F.when(F.size("_filled") >= 2, F.try_divide(plain, F.size("_filled")) < 0.4).otherwise(False)
    rows = rows.withColumn("_few", few)
    rows = rows.withColumn("_signs", F.when(F.col("_few"), v.signs(F.col("_said"))))
    rows = rows.withColumn("_has", F.when(F.col("_signs").isNotNull() & v.may_head(F.col("_said"), F.col("_signs")), F.transform("_filled", low)))
    has = F.col("_has")
    rows = rows.withColumn("_number", F.transform(has, t.is_numeric))
    words = F.filter(has, lambda c, i: (c != "") & ~F.get("_number", i))
    rows = rows.withColumns({"_n": F.size(has), "_numbers": F.size(F.filter("_number", lambda x: x)), "_line": F.array_join(has, " "), "_words": F.array_join(words, APART)})
    # Two header words are beyond a row of one value, and a row of numbers is no header: the roles of others aren't looked for.
    may = has.isNotNull() & (F.col("_n") >= 2) & (F.try_divide("_numbers", "_n") < 0.4)
    says = lambda role: v.says(F.col("_words"), role)
    rows = rows.withColumns({"_may": may, "_named": may & (says("description") | says("part_number")), "_amount": may & (says("qty") | says("uom")), "_price": may & says("unit_price")})
    tier = (v.hits(F.col("_line"), v.TIER_WORDS) >= 2) | F.exists(has, lambda c: c.isin("min qty", "from qty", "tier"))
    named, amount, price = F.col("_named"), F.col("_amount"), F.col("_price")
    # All roles are counted where those three say nothing.
    several = sum((says(role).cast("int") for role in v.HEADERS), F.lit(0)) >= 3
    score = F.when(~F.col("_may"), 0.0).when(tier, 0.95).when(named & price, F.when(amount, 0.90).otherwise(0.75)).when(named & amount, 0.70).when(price & amount, 0.60).when(several, 0.65).otherwise(0.0)
    return rows.withColumn("score", score).select(*before, "score")


def _any(words: Column, pattern: str) -> Column:
    return F.array_join(words, APART).rlike(pattern)


def header_rows(rows: DataFrame) -> DataFrame:
    """Rows that may be a table's header, with their score."""
    # As a generator: a filter would be pushed down to the rows, with the whole score written out in it.
    return scored(rows).withColumnRenamed("score", "_s").select(*rows.columns, F.explode(F.filter(F.array("_s"), lambda x: x >= 0.5)).alias("score"))


def slices(rows: DataFrame) -> DataFrame:
    """Every row that says something, as a table's HEADER or ROW, as TEXT after or without a table, or META before the first.

    A table goes from its header to the next one, or to a footer, a divider or a second blank row in a row. Its rows are cut
    or filled up to the header's width; rows that are blank within it are left out.
    """
    # One order of rows serves all windows: a table's end and width are those since its header.
    order = Window.partitionBy(*SHEET).orderBy("row_no")
    rows = scored(rows.withColumn("line", said(F.col("cells"))))
    is_header, blank, line = F.col("score") >= 0.5, F.col("line") == "", F.col("line")
    ends = ~is_header & (v.any_of(line, v.DIVIDER.split("|")) | (v.any_of(line, ["total", "taxable value", "round off"]) & line.rlike(v.FOOTER)) | (blank & F.coalesce(F.lag(blank).over(order), F.lit(False))))
    width = F.when(is_header, F.array_max(F.transform(F.col("cells"), lambda c, i: F.when(c != "", i + 1))))
    rows = rows.withColumns({"ends": ends, "width": width}).withColumns({
        "table_no": F.sum(is_header.cast("int")).over(order), "began": F.max(F.when(is_header, F.col("row_no"))).over(order),
        "over": F.max(F.when(F.col("ends"), F.col("row_no"))).over(order), "width": F.last("width", ignorenulls=True).over(order),
    })
    ended = F.coalesce(F.col("over") >= F.col("began"), F.lit(False))
    kind = F.when(F.col("table_no") == 0, F.when(F.max("table_no").over(Window.partitionBy(*SHEET)) > 0, "META").otherwise("TEXT")).when(is_header, "HEADER").when(ended, "TEXT").otherwise("ROW")
    cut = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size("cells"), F.lit(0)))), 1, F.col("width"))
    rows = rows.withColumn("kind", kind).where("line <> ''").withColumn("cells", F.when(F.col("kind").isin("HEADER", "ROW"), cut).otherwise(filled(F.col("cells"))))
    rows = rows.where((F.col("kind") != "ROW") | (F.array_join("cells", "") != ""))
    return rows.select("doc_id", "sheet", "sheet_name", "table_no", "row_no", "kind", "is_hidden", "cells", F.array_join("cells", "\t").alias("text"), "score")


def _has(text: Column, words: str) -> Column:
    return text.rlike(words)


def table_kinds(sliced: DataFrame) -> DataFrame:
    """Each table's kind, how sure that is, and its score as the document's main table."""
    # Rows are counted by themselves: with the header's cells in it the aggregate would have to sort them.
    counts = sliced.where("kind = 'ROW'").groupBy(*TABLE).agg(F.count("*").alias("n_rows"), F.count_if(v.worded(F.lower("text"), v.CHARGE_ROWS)).alias("charge_rows"))
    tables = sliced.where("kind = 'HEADER'").select(*TABLE, "sheet_name", F.col("cells").alias("headers")).join(counts, TABLE, "left").fillna(0, ["n_rows", "charge_rows"])
    # Columns of their own: written out in each rule, they would be found again for each.
    tables = tables.withColumns({"_heads": F.transform(filled(F.col("headers")), low), "_sheet": F.lower("sheet_name")}).withColumns({"heads": F.array_join("_heads", " "), "_apart": F.array_join("_heads", APART)})
    heads, sheet, line = F.col("_heads"), F.col("_sheet"), F.col("heads")
    anywhere = lambda words: v.worded(line, words) | v.worded(sheet, words)
    has = {role: F.col(f"_{role}") for role in ("description", "unit_price", "qty", "part_number", "uom", "amount", "tax", "discount")}
    tables = tables.withColumns({f"_{role}": v.says(F.col("_apart"), role) for role in has})
    signals = sum((has[r].cast("int") for r in has if r != "discount"), F.lit(0))
    tier = (sum(((F.contains(line, F.lit(w)) | F.contains(sheet, F.lit(w))).cast("int") for w in v.TIER_WORDS), F.lit(0)) >= 2) | F.exists(heads, lambda h: h.isin("min qty", "from qty", "tier", "max qty"))
    main = has["description"] & (has["unit_price"] | has["qty"])
    rules = [
        (anywhere(v.HISTORICAL), "HISTORICAL_REFERENCE", 0.90), (tier, "VOLUME_PRICING", 0.95),
        (v.worded(line, "particulars|description") & (F.col("n_rows") > 0) & (F.try_divide("charge_rows", "n_rows") >= 0.5), "CHARGES", 0.85),
        (v.worded(line, v.DISCOUNTS), "DISCOUNT_TABLE", 0.85), (v.worded(line, v.TAXES), "TAX_TABLE", 0.85),
        (anywhere(v.TERMS_ANYWHERE) & (v.worded(line, v.TERMS) | F.contains(sheet, F.lit("terms_charges"))), "TERMS", 0.90), ((F.size(heads) <= 2) & v.worded(line, v.METADATA), "METADATA", 0.80),
        (v.hits(line, v.SUMMARY) >= 2, "SUMMARY_TOTALS", 0.90), (main & (signals >= 3), "MAIN_LINE_ITEMS", 0.95), (main, "MAIN_LINE_ITEMS", 0.75),
        ((signals >= 2) & (F.col("n_rows") >= 1), "MAIN_LINE_ITEMS", 0.65),
    ]
    found = lambda name, conf: F.struct(F.lit(name).alias("kind"), F.lit(conf).alias("sure"))
    first = F.when(rules[0][0], found(*rules[0][1:]))
    for rule, name, conf in rules[1:]:
        first = first.when(rule, found(name, conf))
    tables = tables.withColumn("_rule", first.otherwise(found("UNKNOWN", 0.30)))
    tables = tables.withColumns({"table_kind": F.col("_rule.kind"), "confidence": F.col("_rule.sure"), "known": sum((x.cast("int") for x in has.values()), F.lit(0)), "decoy": v.worded(sheet, v.DECOY)})
    score = 10 * F.col("confidence") + F.least(F.lit(20.0), 1.5 * F.col("n_rows")) + 2.0 * F.col("known") - F.when(F.col("decoy"), 5.0).otherwise(0.0)
    return tables.withColumn("main_score", F.round(F.when(F.col("table_kind") == "MAIN_LINE_ITEMS", score).otherwise(0.0), 4)).select(*TABLE, "sheet_name", "headers", "n_rows", "table_kind", "confidence", "heads", "main_score")


def routed(kinds: DataFrame) -> DataFrame:
    """What a table is read for: ITEMS, TIERS or nothing. Kinds that say neither are told by header words."""
    kind, heads = F.col("table_kind"), F.lower(F.array_join("headers", " "))
    use = (
        F.when(kind == "VOLUME_PRICING", "TIERS").when(kind == "MAIN_LINE_ITEMS", "ITEMS").when(kind.isin("HISTORICAL_REFERENCE", "SUMMARY_TOTALS", "TERMS"), None)
        .when(v.worded(heads, "min qty|from qty|tier"), "TIERS").when(v.worded(heads, "description|item|product|particulars"), "ITEMS")
    )
    return kinds.withColumn("route", use)


def main_tables(kinds: DataFrame) -> DataFrame:
    """The table of each document that holds its line items: the best score, the first of equals."""
    # Tables that aren't read for items come last: a filter before the window would be pushed down, with all rules written out in it.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.expr("route <=> 'ITEMS'").desc(), F.desc("main_score"), "sheet", "table_no"))
    return routed(kinds).withColumn("nth", first).where("nth = 1 AND route = 'ITEMS'").drop("nth", "route")


def column_stats(sliced: DataFrame) -> DataFrame:
    """Of each table's columns: the header, and how many values there are, numbers, units, codes and texts among them."""
    cells = sliced.where("kind = 'ROW'").select(*TABLE, F.posexplode("cells").alias("col_no", "value")).withColumn("value", t.strip(F.col("value")))
    value = F.col("value")
    cells = cells.withColumns({"_has": value != "", "_number": (value != "") & t.is_numeric(value)})
    count = lambda x: F.count_if(F.col("_has") & x)
    # Counted without the headers: with texts among its values the aggregate would have to sort the cells.
    counts = cells.groupBy(*TABLE, "col_no").agg(
        F.count_if("_has").alias("n_values"), F.count_if("_number").alias("n_numbers"), count(F.upper("value").isin(v.UNIT_CELLS)).alias("n_units"),
        count(t.looks_like_identifier(value)).alias("n_codes"), count(~F.col("_number") & (F.length("value") >= 3)).alias("n_texts"),
    )
    heads = sliced.where("kind = 'HEADER'").select(*TABLE, F.posexplode("cells").alias("col_no", "value")).select(*TABLE, "col_no", low(F.col("value")).alias("header"))
    numbers = ["n_values", "n_numbers", "n_units", "n_codes", "n_texts"]
    # A table's rows are as wide as its header.
    return heads.join(counts, [*TABLE, "col_no"], "left").fillna(0, numbers).select(*TABLE, "col_no", "header", *numbers)


def _value_score(role: str) -> Column:
    n = F.col("n_values")
    numbers, units, codes = (F.try_divide(F.col(c), n) for c in ("n_numbers", "n_units", "n_codes"))
    if role == "uom":
        score = F.when(numbers > 0.4, 0.0).when(units > 0.3, 1.0).otherwise(0.5)
    elif role in v.NUMBERS:
        score = F.when(numbers >= 0.4, 1.0).otherwise(0.2)
    elif role in v.CODES:
        score = F.when(codes >= 0.4, 1.0).otherwise(0.7)
    elif role == "supplier":
        score = F.when(codes > 0.6, 0.0).when(numbers > 0.7, 0.1).otherwise(1.0)
    elif role == "description":
        score = F.when(numbers > 0.7, 0.1).otherwise(1.0)
    else:
        score = F.lit(0.9)
    return F.when(n == 0, 0.5).otherwise(score)


def column_roles(stats: DataFrame) -> DataFrame:
    """Which column has which role in each table: (…, role, col_no, score). A column takes its best role, a role its best
    column; earlier roles and columns win ties. A table without a description takes its first free column of texts."""
    header = F.col("header")
    # Scores are columns of their own: written out where they are compared, they would be found again for each use.
    scores, best = {}, []
    for at, role in enumerate(v.HEADERS):
        matches = v.strictly(header, role)
        matches = matches & ~header.rlike(v.NEVER[role]) if role in v.NEVER else matches
        score = F.col(f"_{role}")
        scores[f"_{role}"] = F.round(F.when(matches, v.WEIGHTS.get(role, 1.0) * _value_score(role)), 6)
        best.append(F.when(score > 0.2, F.struct(score.alias("score"), F.lit(-at).alias("at"), F.lit(role).alias("role"))))
    found = stats.withColumns(scores).select(*TABLE, "col_no", "n_values", "n_texts", F.greatest(*best).alias("best"))
    nth = F.row_number().over(Window.partitionBy(*TABLE, "best.role").orderBy(F.desc("best.score"), "col_no"))
    found = found.withColumn("taken", F.col("best").isNotNull() & (nth == 1))
    named = F.max(F.col("taken") & (F.col("best.role") == "description")).over(Window.partitionBy(*TABLE))
    texts = ~F.col("taken") & (F.col("n_values") > 0) & (F.try_divide("n_texts", "n_values") >= 0.5)
    free = F.min(F.when(texts, F.col("col_no"))).over(Window.partitionBy(*TABLE))
    spare = ~named & (F.col("col_no") == free)
    out = found.withColumns({"spare": F.coalesce(spare, F.lit(False))}).where("taken OR spare")
    return out.select(*TABLE, F.when(F.col("taken"), F.col("best.role")).otherwise("description").alias("role"), "col_no", F.when(F.col("taken"), F.col("best.score")).otherwise(0.0).alias("score"))


def role_map(roles: DataFrame) -> DataFrame:
    """One row a table with a column c_<role> for each role."""
    return roles.groupBy(*TABLE).agg(*[F.max(F.when(F.col("role") == r, F.col("col_no"))).alias(f"c_{r}") for r in v.HEADERS])


def cell(role: str) -> Column:
    """A row's cell of that role, null where it is blank."""
    return F.nullif(t.strip(F.try_element_at("cells", F.col(f"c_{role}") + 1)), F.lit(""))


def row_kinds(sliced: DataFrame, roles: DataFrame) -> DataFrame:
    """The kind of each row of a table, with its table's roles: the first rule that holds counts."""
    rows = sliced.where("kind = 'ROW'").join(role_map(roles), TABLE, "left")
    zero = lambda role: F.coalesce(at[role], F.lit("")).isin("", "0", "0.0")
    before = rows.columns
    rows = rows.withColumns({"_line": low(F.col("text")), "_qty": cell("qty"), "_price": cell("unit_price")})
    line, at = F.col("_line"), {"qty": F.col("_qty"), "unit_price": F.col("_price")}
    helper = F.col("is_hidden") & (v.worded(line, v.HELPERS) | (F.col("c_qty").isNotNull() & F.col("c_unit_price").isNotNull() & zero("qty") & zero("unit_price")))
    kind = F.when(helper, "NOTE")
    for name, words in v.ROWS.items():
        kind = kind.when(v.worded(line, words), name)
    number = lambda role: F.coalesce(at[role].rlike(r"\d"), F.lit(False))
    kind = kind.when(~number("qty") & ~number("unit_price"), "CONTINUATION").otherwise("ITEM")
    # As a generator: a filter would be pushed down to the rows, with all rules written out in it.
    return rows.select(*before, F.explode(F.array(kind)).alias("row_kind"))


def csv_tables(rows: DataFrame) -> DataFrame:
    """Rows of a comma-separated file as HEADER, META before it, ROW after it (cut or filled to the header's width), or
    TEXT where no row has two header words."""
    line = F.array_join(F.transform("cells", low), " ")
    rows = rows.withColumn("is_header", v.hits(line, v.CSV_WORDS) >= 2)
    doc = Window.partitionBy("doc_id")
    rows = rows.withColumn("at", F.min(F.when(F.col("is_header"), F.col("row_no"))).over(doc))
    last = F.array_max(F.transform(F.col("cells"), lambda c, i: F.when(t.strip(c) != "", i + 1)))
    rows = rows.withColumn("width", F.max(F.when(F.col("row_no") == F.col("at"), last)).over(doc))
    kind = F.when(F.col("at").isNull(), "TEXT").when(F.col("row_no") < F.col("at"), "META").when(F.col("row_no") == F.col("at"), "HEADER").otherwise("ROW")
    trimmed = F.transform("cells", t.strip)
    cut = F.slice(F.concat(trimmed, F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size("cells"), F.lit(0)))), 1, F.col("width"))
    return rows.withColumn("kind", kind).select("doc_id", "row_no", "kind", F.when(F.col("kind").isin("HEADER", "ROW"), cut).when(F.col("kind") == "META", filled(trimmed)).otherwise(F.col("cells")).alias("cells"))


def split_line(line: Column) -> Column:
    parts = filled(F.transform(F.split(line, r"\s{2,}|\t"), t.strip))
    return F.when(F.size(parts) < 2, filled(F.split(line, r"\s+"))).otherwise(parts)


def line_tables(lines: DataFrame) -> DataFrame:
    """Printed lines (doc_id, line_no, text) as HEADER, ROW (with a digit) or TEXT. The header is the line with the most
    header words, two at least, the first of equals; without one, lines of three tokens and two numbers are rows."""
    found = v.hits(F.lower("text"), v.LINE_WORDS)
    doc = Window.partitionBy("doc_id")
    best = F.min_by(F.col("line_no"), F.struct(-F.col("found"), F.col("line_no"))).over(doc)
    rows = lines.withColumn("found", found).withColumn("at", F.when(F.max("found").over(doc) >= 2, best))
    rows = rows.withColumn("parts", split_line(F.col("text")))
    rows = rows.withColumn("width", F.max(F.when(F.col("line_no") == F.col("at"), F.size("parts"))).over(doc))
    cut = F.slice(F.concat("parts", F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size("parts"), F.lit(0)))), 1, F.col("width"))
    tokens = filled(F.split("text", r"\s+"))
    loose = (F.size(tokens) >= 3) & (F.size(F.filter(tokens, lambda x: x.rlike(r"\d"))) >= 2)
    digit = F.exists(cut, lambda c: c.rlike(r"\d"))
    kind = (
        F.when(F.col("at").isNull(), F.when(loose, "ROW").otherwise("TEXT")).when(F.col("line_no") < F.col("at"), "TEXT")
        .when(F.col("line_no") == F.col("at"), "HEADER").otherwise(F.when(digit, "ROW").otherwise("TEXT"))
    )
    cells = F.when(F.col("kind") == "TEXT", F.array("text")).when(F.col("at").isNull(), tokens).otherwise(cut)
    return rows.withColumn("kind", kind).select("doc_id", "line_no", "kind", cells.alias("cells"))


def header_lines(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """The lines of a document's first page that are no table's: the first eight are flagged as its header."""
    text = tables.where("kind = 'TEXT'").select("doc_id", "line_no")
    rest = lines.join(text, ["doc_id", "line_no"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_no"))
    return rest.select("doc_id", "page", "line_no", "text", ((F.col("page") == 1) & (nth <= 8)).alias("is_header_metadata"))
