"""What a quotation says: its header fields, surcharges and stated total, its line items and their price tiers.

Blocks are (doc_id, sheet, row_no, cells) of text outside tables; rows are those of ``sheets.row_kinds``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions import text as t
from bidloom.functions import vocabulary as v
from bidloom.operators import sheets

PLACE = ["source", "sheet", "row_no", "nth"]


def key_values(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (doc_id, source, sheet, row_no, nth, key, value): "Key: value" in a cell, "Key:" before a cell, and adjacent
    cells without colons, from left to right; of a table's rows (source 1, after the texts) only the first form."""
    parts = F.filter(F.transform("cells", t.strip), lambda c: c != "")
    key = lambda c: t.strip(F.split(c, ":", 2)[0])
    value = lambda c: t.strip(F.try_element_at(F.split(c, ":", 2), F.lit(2)))
    pair = lambda k, x: F.struct(k.alias("key"), x.alias("value"))
    empty = F.struct(F.lit(False).alias("skip"), F.array().cast("array<struct<key:string,value:string>>").alias("found"))

    def step(acc, i):
        here, after, more = F.try_element_at("parts", i), F.try_element_at("parts", i + 1), i < F.size("parts")
        colon = F.contains(here, F.lit(":"))
        both = colon & (key(here) != "") & (value(here) != "")
        two = more & F.when(colon, (key(here) != "") & (value(here) == "")).otherwise(~F.contains(after, F.lit(":")))
        add = F.when(both, F.array(pair(key(here), value(here)))).when(two, F.array(pair(F.when(colon, key(here)).otherwise(here), after))).otherwise(empty["found"])
        return F.struct((~acc["skip"] & F.coalesce(two & ~both, F.lit(False))).alias("skip"), F.when(acc["skip"], acc["found"]).otherwise(F.concat(acc["found"], add)).alias("found"))

    told = blocks.withColumn("parts", parts).where(F.size("parts") > 0)
    told = told.select("doc_id", F.lit(0).alias("source"), "sheet", "row_no", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.size("parts")), empty, step)["found"]).alias("nth", "kv"))
    cells = rows.select("doc_id", F.lit(1).alias("source"), "sheet", "row_no", F.posexplode("cells").alias("nth", "c")).where(F.contains("c", F.lit(":")))
    cells = cells.select("doc_id", "source", "sheet", "row_no", "nth", pair(key(F.col("c")), value(F.col("c"))).alias("kv")).where("kv.key <> '' AND kv.value <> ''")
    return told.unionByName(cells).select("doc_id", *PLACE, F.lower("kv.key").alias("key"), "kv.value")


def clean_value(value: Column) -> Column:
    """A value up to the next label in it. A label that it begins with doesn't end it."""

    def cut(words: list[str]) -> Column:
        return t.strip(F.regexp_replace(value, rf"(?is)^(.+?)\b(?:{'|'.join(words)})[\s#.:/-].*$", "$1"))

    out = None
    for word in v.CUT_AT:
        begins, rest = value.rlike(rf"(?i)^{word}[\s#.:/-]"), cut([w for w in v.CUT_AT if w != word])
        out = F.when(begins, rest) if out is None else out.when(begins, rest)
    return out.otherwise(cut(v.CUT_AT))


def _first(df: DataFrame, value: Column, order: list) -> DataFrame:
    """The first value of each document that is not null."""
    return df.withColumn("_v", value).where("_v IS NOT NULL").groupBy("doc_id").agg(F.min_by("_v", F.struct(*order)).alias("v"))


def _chosen(docs: DataFrame, options: list[DataFrame], name: str, other: Column) -> DataFrame:
    """For each document the first option that has a value."""
    both = None
    for i, option in enumerate(options):
        rows = option.select("doc_id", F.lit(i).alias("i"), "v")
        both = rows if both is None else both.unionByName(rows)
    best = both.groupBy("doc_id").agg(F.min_by("v", "i").alias(name))
    return docs.join(best, "doc_id", "left").withColumn(name, F.coalesce(name, other))


def _column(rows: DataFrame, role: str) -> DataFrame:
    """The first value in a column of the main table."""
    return _first(rows, sheets.cell(role), ["row_no"])


def supplier(docs: DataFrame, blocks: DataFrame, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The supplier's name: a column, a labelled value, one of the first four blocks of a sheet that looks like a firm, or
    "Unknown Supplier"."""
    column = _column(rows, "supplier").where(~F.lower("v").isin(v.NO_SUPPLIER))
    pairs = pairs.where(F.col("key").rlike(v.SUPPLIER_KEY)).withColumn("said", F.regexp_replace(clean_value(F.col("value")), r"^[:\s-]+", ""))
    said = F.col("said")
    good = (F.length(said) >= 3) & ~F.lower(said).isin(v.NO_SUPPLIER) & ~said.rlike(v.TITLE) & ~said.rlike(v.LABEL)
    labelled = _first(pairs, F.when(good, said), PLACE)
    nth = F.row_number().over(Window.partitionBy("doc_id", "sheet").orderBy("row_no"))
    head = t.strip(F.col("cells")[0])
    words = F.filter(F.split(head, r"\s+"), lambda w: w != "")
    titled = F.exists(words, lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) >= 4) & ~F.lower(w).isin(v.FIRM_WORDS))
    firm = F.exists(words, lambda w: F.lower(w).isin(v.FIRM_WORDS))
    good = (F.length(head) >= 4) & F.size(words).between(2, 10) & ~F.lower(head).isin(v.NO_SUPPLIER) & ~head.rlike(v.TITLE) & ~head.rlike(v.LABEL) & ~head.rlike(r"^[A-Za-z\s]{1,20}:\s*.+") & (titled | firm)
    seen = _first(blocks.withColumn("nth", nth).where("nth <= 4"), F.when(good, head), ["sheet", "row_no"])
    return _chosen(docs, [column, labelled, seen], "supplier", F.lit("Unknown Supplier"))


def quote_number(docs: DataFrame, blocks: DataFrame, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The quotation's number: a column, a labelled value, or one next to such a word in a text; null where there is none."""
    good = lambda x: F.when((F.length(x) >= 3) & ~F.lower(x).isin("no", "number", "ref", "dated", "date"), x)
    column = _column(rows, "quote_number").where(F.length("v") >= 3)
    pairs = pairs.where(F.col("key").rlike(v.NUMBER_KEY)).withColumn("said", F.regexp_extract(F.regexp_replace(clean_value(F.col("value")), r"^[:\s#-]+", ""), r"[A-Za-z0-9\-_/]+", 0))
    labelled = _first(pairs, good(F.col("said")), PLACE)
    near = F.regexp_extract(F.array_join("cells", "\t"), v.NUMBER_NEAR, 1)
    return _chosen(docs, [column, labelled, _first(blocks, good(near), ["sheet", "row_no"])], "quote_number", F.lit(None).cast("string"))


def dates(docs: DataFrame, blocks: DataFrame, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The quotation's date (a column, a labelled value, a date in a text) and until when it is valid (a labelled value)."""
    day = lambda x: t.flex_date(x)
    column = _first(rows, day(sheets.cell("quote_date")), ["row_no"])
    said = pairs.withColumn("said", clean_value(F.col("value")))
    labelled = _first(said.where(F.col("key").rlike(v.DATE_KEY)), day(F.col("said")), PLACE)
    line = F.array_join("cells", "\t")
    near = F.coalesce(*(day(F.regexp_extract(line, p, 1)) for p in v.DATES_NEAR))
    valid = _first(said.where(F.col("key").rlike(v.VALIDITY_KEY)), day(F.col("said")), PLACE).withColumnRenamed("v", "valid_until")
    return _chosen(docs, [column, labelled, _first(blocks, near, ["sheet", "row_no"])], "quote_date", F.lit(None).cast("date")).join(valid, "doc_id", "left")


def currency(docs: DataFrame, every: DataFrame, rows: DataFrame) -> DataFrame:
    """The currency: a column, else the first sign of INR, USD, EUR in this order anywhere, else INR. every: all rows."""
    column = _column(rows, "currency").withColumn("v", t.norm_currency(F.col("v")))
    signs = {"INR": r"₹|INR|Rs\.", "USD": r"\$|USD", "EUR": "€|EUR"}
    line = F.array_join("cells", " ")
    found = every.groupBy("doc_id").agg(*[F.max(line.rlike(x)).alias(c) for c, x in signs.items()])
    sign = found.select("doc_id", F.coalesce(*(F.when(F.col(c), c) for c in signs)).alias("v")).where("v IS NOT NULL")
    return _chosen(docs, [column, sign], "currency", F.lit("INR"))


CHARGE = ["doc_id", "source", "sheet", "row_no", "charge_type", "amount", "tax_rate_pct"]


def _last_header(pattern: str, unless: str | None = None) -> Column:
    hit = lambda h: h.rlike(pattern) & (~h.rlike(unless) if unless else F.lit(True))
    return F.array_max(F.transform(F.col("headers"), lambda h, i: F.when(hit(F.lower(h)), i)))


def table_charges(sliced: DataFrame) -> DataFrame:
    """Surcharges in tables: rows whose first value names one, with the amount and tax columns' values, else the first
    positive number after it and the tax that the row names."""
    heads = sliced.where("kind = 'HEADER'").select(*sheets.TABLE, F.col("cells").alias("headers"))
    heads = heads.select(*sheets.TABLE, _last_header("amount|value|charge|rate").alias("amt"), _last_header("tax|gst", "amount|value|charge|rate").alias("tax"))
    rows = sliced.where("kind = 'ROW'").join(heads, sheets.TABLE)
    has = F.filter(F.transform("cells", t.strip), lambda c: c != "")
    at = lambda c: F.nullif(t.strip(F.try_element_at("cells", F.col(c) + 1)), F.lit(""))
    number = F.filter(F.transform(F.slice(has, 2, 1000000), t.norm_decimal), lambda x: x > 0)
    amount = F.when(at("amt").isNotNull(), t.norm_decimal(at("amt"))).otherwise(F.try_element_at(number, F.lit(1)))
    tax = F.when(at("tax").isNotNull(), t.norm_decimal(at("tax"))).otherwise(t.tax_rate(F.col("text")).cast("decimal(18,4)"))
    rows = rows.withColumns({"source": F.lit(0), "charge_type": v.charge_of(F.try_element_at(has, F.lit(1))), "amount": amount, "tax_rate_pct": tax})
    return rows.where("charge_type IS NOT NULL AND amount > 0").select(*CHARGE)


def text_charges(blocks: DataFrame) -> DataFrame:
    """Surcharges in texts: the first part of a line that names one and has an amount, in the next part or after its name."""
    parts = F.filter(F.transform(F.split(F.array_join("cells", "\t"), r"[\t:]+"), t.strip), lambda c: c != "")
    rows = blocks.withColumns({"parts": parts, "line": F.array_join("cells", "\t")}).select("doc_id", "sheet", "row_no", "line", "parts", F.posexplode("parts").alias("nth", "part"))
    kind = v.charge_of(F.col("part"))
    after = lambda n: t.norm_decimal(F.try_element_at("parts", F.col("nth") + 1 + n))
    near = F.coalesce(*(F.when(kind == k, F.nullif(F.regexp_extract("line", rf"(?i)\b(?:{'|'.join(w)})[\s#.:/-]*₹?\s*(\d+(?:\.\d+)?)", 1), F.lit(""))) for k, w in v.CHARGES.items())).cast("decimal(18,4)")
    amount = F.when(after(1) > 0, after(1)).otherwise(near)
    tax = F.when((after(2) > 0) & (after(2) <= 40), after(2)).otherwise(t.tax_rate(F.col("line")).cast("decimal(18,4)"))
    rows = rows.withColumns({"source": F.lit(1), "charge_type": kind, "amount": amount, "tax_rate_pct": tax}).where("charge_type IS NOT NULL AND amount > 0")
    first = F.row_number().over(Window.partitionBy("doc_id", "sheet", "row_no").orderBy("nth"))
    return rows.withColumn("first", first).where("first = 1").select(*CHARGE)


def distinct_charges(charges: DataFrame) -> DataFrame:
    """The first of each kind and amount in a document, tables before texts."""
    first = F.row_number().over(Window.partitionBy("doc_id", "charge_type", "amount").orderBy("source", "sheet", "row_no"))
    return charges.withColumn("first", first).where("first = 1").drop("first")


def stated_total(docs: DataFrame, blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """The total that a document states: of its main table's grand total rows the last, else the first in a text."""
    line = F.col("text")
    number = t.norm_decimal(line)
    footer = _first(rows.where((F.col("row_kind") == "SUBTOTAL") & F.contains(F.lower(line), F.lit("grand total"))), F.when(number > 0, number), [(-F.col("row_no"))])
    said = t.norm_decimal(F.nullif(F.regexp_extract(F.array_join("cells", "\t"), v.STATED_TOTAL, 1), F.lit("")))
    return _chosen(docs, [footer, _first(blocks, F.when(said > 0, said), ["sheet", "row_no"])], "stated_total", F.lit(None).cast("decimal(18,4)"))


NOT_ITEMS = ["min qty", "max qty", "unit price", "subtotal", "grand total", "description", "item"]


def line_items(rows: DataFrame) -> DataFrame:
    """The line items of the main table, in order, with what their cells say: continuation rows add to the description
    before them; a price of 0 gives way to the first positive number outside quantity and description; the rate of tax is
    the sum of its parts, else the tax column's, else the one that the row names."""
    # What a cell says is a column of its own, and so is its number: written out in each rule, it would be found again for each.
    of = ["description", "qty", "uom", "unit_price", "discount", "hsn", "tax", "cgst", "sgst", "igst", "cess", "lead_time", *v.CODES]
    rows = rows.withColumns({f"_{role}": sheets.cell(role) for role in of})
    cell, number = lambda role: F.col(f"_{role}"), t.norm_decimal
    words = cell("description")
    item = (F.col("row_kind") == "ITEM") & words.isNotNull() & ~F.lower(words).isin(NOT_ITEMS)
    rows = rows.withColumn("is_item", F.coalesce(item, F.lit(False))).where("is_item OR row_kind = 'CONTINUATION'")
    more = F.nullif(t.strip(F.try_element_at("cells", F.coalesce("c_description", F.lit(0)) + 1)), F.lit(""))
    numbers = {"_n_price": number(cell("unit_price")), "_n_qty": number(cell("qty"), "1"), "_n_tax": number(cell("tax")), "_named": t.tax_rate(F.col("text")).cast("decimal(18,4)")}
    numbers |= {"_code": F.nullif(F.regexp_extract(words, v.LEADING_CODE, 1), F.lit("")), "_unit": t.norm_uom(cell("uom"))}
    rows = rows.withColumns(numbers)
    price = F.col("_n_price")
    spare = F.filter("cells", lambda c, i: (i != F.coalesce("c_qty", F.lit(-1))) & (i != F.coalesce("c_description", F.lit(-1))) & (number(c) > 0))
    qty = F.col("_n_qty")
    parts = F.array_compact(F.array(*[F.when(F.col(f"c_{c}").isNotNull(), F.struct(F.lit(c.upper()).alias("tax_type"), number(cell(c)).alias("rate"))) for c in ("cgst", "sgst", "igst", "cess")]))
    one = F.when(F.col("_n_tax") > 0, F.col("_n_tax")).when(F.col("_named") > 0, F.col("_named"))
    parts = F.when(F.size(parts) > 0, parts).when(one.isNotNull(), F.array(F.struct(F.lit("GST").alias("tax_type"), one.alias("rate")))).otherwise(F.array().cast("array<struct<tax_type:string,rate:decimal(18,4)>>"))
    code = F.col("_code")
    code = F.when((F.length(code) >= 3) & ~F.upper(code).isin([*t.STANDARD_UNITS, *v.NO_CODE]) & ~code.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$") & ~code.rlike(r"^\d+$"), code)
    out = rows.withColumns({
        "_more": more, "part_number": F.coalesce(*(cell(c) for c in v.CODES), code), "quoted_qty": F.when(qty > 0, qty).otherwise(F.lit(1).cast("decimal(18,4)")), "quoted_uom": F.col("_unit"),
        "unit_price": F.when(price == 0, F.coalesce(number(F.try_element_at(spare, F.lit(1))), price)).otherwise(price), "discount_pct": number(cell("discount")), "hsn_sac_code": cell("hsn"),
        "tax_components": parts, "lead_time_days": F.nullif(F.regexp_extract(cell("lead_time"), r"(\d+)", 1), F.lit("")).cast("int"),
    })
    rate = F.aggregate("tax_components", F.lit(0).cast("decimal(18,4)"), lambda a, x: (a + x["rate"]).cast("decimal(18,4)"))
    # The order is found last, of rows without their cells.
    said = ["doc_id", "sheet", "table_no", "row_no", "is_hidden", "is_item", "_more"]
    values = ["part_number", "hsn_sac_code", "quoted_qty", "quoted_uom", "unit_price", "discount_pct", "tax_components", "tax_rate_pct", "lead_time_days"]
    out = out.withColumn("tax_rate_pct", rate).select(*said, *values)
    order = Window.partitionBy("doc_id").orderBy("sheet", "row_no")
    out = out.withColumn("line_index", F.sum(F.col("is_item").cast("int")).over(order) - 1).where("line_index >= 0")
    parts = F.array_sort(F.collect_list(F.when(F.col("_more").isNotNull(), F.struct("row_no", "_more"))).over(Window.partitionBy("doc_id", "line_index")))
    out = out.withColumn("raw_description", F.array_join(parts["_more"], "\n")).where("is_item")
    return out.select("doc_id", F.col("line_index").cast("int").alias("line_index"), "sheet", "table_no", "row_no", "is_hidden", "raw_description", *values)


def tiers(sliced: DataFrame, kinds: DataFrame, blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Price tiers (doc_id, line_index, min_qty, max_qty, unit_price) of the tables read for them, on the first line with
    the row's code as its part number or in its description; the code may stand in a title of the sheet; the only line of a
    document takes tiers without a code. Repeated tiers of a line count once."""
    use = sheets.routed(kinds).where("route = 'TIERS'")
    rest = "sku|part|code"
    use = use.select(*sheets.TABLE, F.size("headers").alias("n"), _last_header(rest).alias("c_code"), _last_header("min|from", rest).alias("c_min"), _last_header("max|to", f"{rest}|min|from").alias("c_max"), _last_header("price|rate", f"{rest}|min|from|max|to").alias("c_price"))
    own = items.select("doc_id", "line_index", "part_number", F.lower("raw_description").alias("words"))
    titles = blocks.withColumn("title", F.lower(F.array_join("cells", "\t"))).where(F.col("title").rlike("volume pricing|tier pricing"))
    named = titles.join(own, "doc_id").where(F.contains("title", F.lower("part_number"))).groupBy("doc_id", "sheet").agg(F.min_by("part_number", F.struct(-F.col("row_no"), "line_index")).alias("title_code"))
    rows = sliced.where("kind = 'ROW'").join(use, sheets.TABLE).join(named, sheets.SHEET, "left")
    at = lambda c, other=None: F.coalesce(t.strip(F.try_element_at("cells", F.coalesce(F.col(c), other if other is not None else F.lit(None).cast("int")) + 1)), F.lit(""))
    code = F.when(F.col("c_code").isNotNull(), at("c_code")).otherwise(F.col("title_code"))
    low, high = at("c_min", F.lit(0)), at("c_max", F.when(F.col("n") > 1, 1))
    rows = rows.select(
        "doc_id", "sheet", "table_no", "row_no", F.nullif(code, F.lit("")).alias("code"), low.alias("low"), t.norm_decimal(low).alias("min_qty"), F.when(high.rlike(r"^\d+$"), t.norm_decimal(high)).alias("max_qty"), t.norm_decimal(at("c_price", F.when(F.col("n") > 2, 2))).alias("tier_price"),
    ).where(~F.lower("low").rlike("freight|packing|insurance|total|terms|notes|delivery|shipping") & (F.col("tier_price") > 0))
    alone = F.count("*").over(Window.partitionBy("doc_id")) == 1
    own = own.withColumn("alone", alone)
    fits = (F.col("part_number") == F.col("code")) | F.contains("words", F.lower("code"))
    found = rows.join(own, "doc_id").withColumn("fits", F.coalesce(fits, F.lit(False))).where("fits OR alone")
    line = found.groupBy("doc_id", "sheet", "table_no", "row_no", "min_qty", "max_qty", "tier_price").agg(F.min("line_index").alias("line_index"))
    return line.groupBy("doc_id", "line_index", "min_qty", "max_qty", F.col("tier_price").alias("unit_price")).agg(F.min(F.struct("sheet", "row_no")).alias("first")).select("doc_id", "line_index", "min_qty", "max_qty", "unit_price", "first.sheet", "first.row_no")


def evidence(rows: DataFrame, items: DataFrame) -> DataFrame:
    """For each line's fields the cell that they come from: (doc_id, line_index, field_name, raw_value, cell_range, method,
    confidence, status). Fields without a cell are INFERRED."""
    own = items.select("doc_id", "sheet", "row_no", "line_index", "part_number")
    rows = rows.join(own, ["doc_id", "sheet", "row_no"])

    def field(name: str, role: Column, raw: Column) -> Column:
        there = raw.isNotNull()
        return F.struct(
            F.lit(name).alias("field_name"), raw.alias("raw_value"), F.when(there, t.a1_ref(F.col("row_no") + 1, role + 1)).alias("cell_range"), F.when(there, "column_cell").otherwise("default").alias("method"),
            F.when(there, 0.95).otherwise(0.5).alias("confidence"), F.when(there, "CONFIRMED").otherwise("INFERRED").alias("status"),
        )

    roles = {"raw_description": "description", "quoted_qty": "qty", "quoted_uom": "uom", "unit_price": "unit_price", "discount_pct": "discount", "tax_rate_pct": "tax"}
    fields = [field(name, F.col(f"c_{role}"), sheets.cell(role)) for name, role in roles.items()]
    return rows.select("doc_id", "line_index", F.inline(F.array(*fields)))
