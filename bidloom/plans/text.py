"""Queries of the scalar text functions over cells derived from quoted lines, and their DuckDB SQL."""

from pyspark.sql import functions as F

from bidloom.functions import text as t
from bidloom.sources.domain import VIEWS, sql, table

QUERIES, ORACLE = {}, {}

VIEWS |= {
    "raw_cells": """
        SELECT quote_id, line_index, item_key, cast(unit_price AS decimal(18, 2)) AS price, quoted_qty, tax_rate_pct, part_number, raw_description, quoted_uom,
          CASE item_key % 6 WHEN 0 THEN '₹' || cast(unit_price AS decimal(18, 2)) WHEN 1 THEN 'Rs. 1,250.50 per unit' WHEN 2 THEN '  -' || item_key || ' ' WHEN 3 THEN 'on request' WHEN 4 THEN NULL ELSE 'Freight	' || item_key || '	0' END AS raw_price,
          CASE item_key % 9 WHEN 0 THEN 'Nos.' WHEN 1 THEN ' mtrs' WHEN 2 THEN 'KGS' WHEN 3 THEN 'l' WHEN 4 THEN '' WHEN 5 THEN 'Coil' WHEN 6 THEN NULL WHEN 7 THEN 'Pairs' ELSE 'bx' END AS raw_uom,
          CASE item_key % 7 WHEN 0 THEN '₹' WHEN 1 THEN 'rs.' WHEN 2 THEN 'usd' WHEN 3 THEN 'Euros' WHEN 4 THEN 'chf' WHEN 5 THEN NULL ELSE 'gold bars' END AS raw_currency,
          CASE item_key % 5 WHEN 0 THEN '2026-0' || (1 + item_key % 9) || '-1' || (item_key % 9) WHEN 1 THEN (1 + item_key % 27) || '/' || (1 + item_key % 12) || '/2026' WHEN 2 THEN (1 + item_key % 27) || '.' || (1 + item_key % 12) || '.2025' WHEN 3 THEN 'soon' ELSE NULL END AS raw_date,
          CASE item_key % 6 WHEN 0 THEN 'Payment: ' || (item_key % 90) || ' days credit' WHEN 1 THEN 'Payment terms net ' || (item_key % 60) WHEN 2 THEN (item_key % 50) || '% advance, delivery 3 weeks FOB Mumbai'
             WHEN 3 THEN 'Delivery: ' || (item_key % 40) || ' days EXW works' WHEN 4 THEN 'Dispatch in 2 weeks from PO, prices in USD' ELSE 'GST ' || (item_key % 28) || '% extra, € quoted' END AS terms,
          CASE item_key % 8 WHEN 0 THEN 'Freight Charges' WHEN 1 THEN 'Packing & forwarding @ 2%' WHEN 2 THEN 'Transit Insurance' WHEN 3 THEN 'Die charges' WHEN 4 THEN 'Customs duty' WHEN 5 THEN 'Taxes as applicable 18%' WHEN 6 THEN 'IGST: 12.5%' ELSE raw_description END AS charge_text
        FROM {quote_lines}""",
}
KEY = "quote_id, line_index"


def _case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def scalar(name: str, columns, oracle: str):
    """Registers a query that adds columns() to the key of each raw cell."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, "raw_cells").select("quote_id", "line_index", *[c.alias(n) for n, c in columns().items()])

    QUERIES[name], ORACLE[name] = run, sql(f"SELECT {KEY}, {oracle} FROM {{raw_cells}}")


def C(name):
    return F.col(name)


NUM = r"regexp_extract(regexp_replace(regexp_replace(raw_price, '[₹$€£]', '', 'g'), '(\d),(\d)', '\1\2', 'g'), '[-+]?\d+(?:\.\d+)?')"
scalar("norm_decimal", lambda: {"value": t.norm_decimal(C("raw_price"))}, f"coalesce(try_cast(nullif({NUM}, '') AS DECIMAL(18,4)), 0) AS value")
UOM = "trim(lower(raw_uom))"
scalar("norm_uom", lambda: {"uom": t.norm_uom(C("raw_uom"))}, f"CASE WHEN coalesce(raw_uom, '') = '' THEN 'PCS' ELSE coalesce({_case(f'''rtrim({UOM}, '.')''', t.UOM_CODES)}, {_case(UOM, t.UOM_CODES)}, upper(trim(raw_uom))) END AS uom")
scalar("norm_currency", lambda: {"currency": t.norm_currency(C("raw_currency"))}, f"CASE WHEN coalesce(raw_currency, '') = '' THEN 'INR' ELSE coalesce({_case('lower(trim(raw_currency))', t.CURRENCIES)}, CASE WHEN length(raw_currency) = 3 THEN upper(trim(raw_currency)) END, 'INR') END AS currency")
scalar("flex_date", lambda: {"day": t.flex_date(C("raw_date"))}, "coalesce(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%d/%m/%Y'), try_strptime(raw_date, '%d.%m.%Y'))::DATE AS day")
VIEWS["date_cells"] = """
SELECT quote_id, line_index, y, m, d, k, CASE k WHEN 0 THEN y || '-' || m || '-' || d WHEN 1 THEN d || '/' || m || '/' || y WHEN 2 THEN d || '-' || m || '-' || yy WHEN 3 THEN d || '.' || m || '.' || y WHEN 4 THEN d || ' ' || name || ' ' || y
  WHEN 5 THEN substr(name, 1, 3) || ' ' || d || ', ' || y WHEN 6 THEN d || '-' || substr(name, 1, 3) || '-' || yy WHEN 7 THEN y || '-' || mm || '-' || dd || ' 00:00:00' WHEN 8 THEN d || 'th of ' || lower(name) || ' ' || y WHEN 9 THEN y || mm || dd
  WHEN 10 THEN 'Mon, ' || d || ' ' || upper(name) || ' ' || y WHEN 11 THEN y || '/' || m || '/' || d WHEN 12 THEN 'within a month' WHEN 13 THEN '32/13/' || y WHEN 14 THEN y || '-' || mm || '-' || dd || 'T10:30:05Z' WHEN 15 THEN '  ' || name || ' ' || d || ' ' || y || ' ' ELSE m || ' ' || d || ' ' || y END AS raw
FROM (SELECT *, lpad(cast(m AS varchar(2)), 2, '0') AS mm, lpad(cast(d AS varchar(2)), 2, '0') AS dd, lpad(cast(y % 100 AS varchar(2)), 2, '0') AS yy, split_part('January,February,March,April,May,June,July,August,September,October,November,December', ',', m) AS name
  FROM (SELECT quote_id, line_index, item_key % 17 AS k, cast(2000 + item_key % 40 AS int) AS y, cast(1 + item_key % 12 AS int) AS m, cast(1 + item_key % 28 AS int) AS d FROM {quote_lines}) a) b"""


def free_dates(spark, sf_dir):
    return table(spark, sf_dir, "date_cells").select("quote_id", "line_index", "raw", t.flex_date(C("raw")).alias("day"))


# The dates that the texts were made from; two kinds are none.
QUERIES["free_dates"], ORACLE["free_dates"] = free_dates, sql("SELECT quote_id, line_index, raw, CASE WHEN k NOT IN (12, 13) THEN make_date(y, m, d) END AS day FROM {date_cells}")
TAX = r"""coalesce(nullif(regexp_extract({x}, '(?i)(?:gst|tax|igst|cgst\+sgst)[\s#.:/-]*(\d+(?:\.\d+)?)%', 1), ''), CASE WHEN regexp_matches(lower({x}), 'gst|tax') THEN nullif(regexp_extract({x}, '(\d+(?:\.\d+)?)%', 1), '') END, '0')::DECIMAL(9,4)"""
scalar("tax_rate", lambda: {"terms_rate": t.tax_rate(C("terms")), "charge_rate": t.tax_rate(C("charge_text"))}, f"{TAX.format(x='terms')} AS terms_rate, {TAX.format(x='charge_text')} AS charge_rate")
scalar("norm_code", lambda: {"code": t.norm_code(C("part_number"))}, "CASE WHEN part_number <> '' THEN regexp_replace(upper(part_number), '[^A-Z0-9]', '', 'g') END AS code")
scalar("norm_desc", lambda: {"description": t.norm_desc(F.concat(F.lit("Stainless Steel grade 304 "), C("raw_description")))}, "'ss304 ' || lower(raw_description) AS description")
SPEC_SQL = t.SPECS.replace("'", "''")
scalar("spec_tokens", lambda: {"specs": F.array_join(F.sort_array(t.spec_tokens(F.concat(C("raw_description"), F.lit(" m8x40mm 12v grade a2 "), C("item_key").cast("string"), F.lit("kg")))), ",")}, f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(raw_description || ' m8x40mm 12v grade a2 ' || item_key || 'kg'), '{SPEC_SQL}'))), ',') AS specs")
scalar("word_tokens", lambda: {"tokens": F.array_join(F.sort_array(t.word_tokens(F.lower("raw_description"))), ",")}, r"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(raw_description), '[\p{L}\p{N}_]+'))), ',') AS tokens")
CAT = {n: c for c, names in t.CATALOG_UNITS.items() for n in names}
scalar("catalog_uom", lambda: {"uom": t.catalog_uom(C("raw_uom"))}, f"CASE WHEN upper(trim(raw_uom)) IN ('', 'NONE', 'NULL', 'N/A', 'NA', '-', '—') THEN NULL ELSE coalesce({_case('upper(trim(raw_uom))', CAT)}, upper(trim(raw_uom))) END AS uom")
scalar("value_type", lambda: {"price_type": t.value_type(C("raw_price")), "date_type": t.value_type(C("raw_date")), "part_type": t.value_type(C("part_number"))}, ", ".join(
    rf"CASE WHEN coalesce(trim({c}), '') = '' THEN 'EMPTY' WHEN regexp_matches(regexp_replace({c}, '[₹$€,\s%]', '', 'g'), '^[-+]?\d*\.?\d+$') THEN 'NUMERIC' WHEN regexp_matches(trim({c}), '^\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}$') THEN 'DATE' ELSE 'TEXT' END AS {n}" for c, n in (("raw_price", "price_type"), ("raw_date", "date_type"), ("part_number", "part_type"))))
scalar("looks_like_identifier", lambda: {"is_id": t.looks_like_identifier(C("part_number")), "is_desc_id": t.looks_like_identifier(C("raw_description"))}, ", ".join(
    rf"length(trim({c})) BETWEEN 2 AND 40 AND ((regexp_matches({c}, '[0-9]') AND regexp_matches({c}, '\p{{L}}')) OR (regexp_matches({c}, '\p{{L}}') AND regexp_matches({c}, '[-_./#]')) OR (regexp_matches({c}, '[0-9]') AND regexp_matches({c}, '[-_./#]'))) AS {n}" for c, n in (("part_number", "is_id"), ("raw_description", "is_desc_id"))))
scalar("a1_ref", lambda: {"ref": t.a1_ref(C("line_index") + 1, C("item_key") % 18000 + 1)}, "(WITH RECURSIVE r AS (SELECT item_key % 18000 + 1 AS n, '' AS s UNION ALL SELECT (n - 1) // 26, chr((65 + (n - 1) % 26)::INT) || s FROM r WHERE n > 0) SELECT max(s) FILTER (WHERE n = 0) FROM r) || (line_index + 1) AS ref")
scalar("charge_type", lambda: {"charge": t.charge_type(C("charge_text"))}, "CASE " + " ".join(f"WHEN regexp_matches(lower(charge_text), '{"|".join(w)}') THEN '{k}'" for k, w in t.CHARGES.items()) + " ELSE 'OTHER' END AS charge")
scalar("payment_terms", lambda: {"credit_days": t.credit_days(C("terms")), "advance_pct": t.advance_pct(C("terms"))}, r"coalesce(nullif(regexp_extract(terms, '(?i)(\d+)\s*(?:days|days\s*credit|days\s*net)', 1), ''), nullif(regexp_extract(terms, '(?i)\bnet\s*(\d+)\b', 1), ''))::INT AS credit_days, nullif(regexp_extract(terms, '(?i)(\d+)%\s*(?:advance|upfront)', 1), '')::DECIMAL(9,4) AS advance_pct")
ONE, TWO = r"(?i)(?:delivery|lead\s*time|dispatch)[\s#.:/-]*(\d+)\s*(?:days|weeks|working\s*days)", r"(?i)(\d+)\s*(?:days|weeks)\s*(?:from\s*po|delivery)"
scalar("delivery_terms", lambda: {"lead_days": t.lead_days(C("terms")), "incoterm": t.incoterm(C("terms"))}, f"""nullif(CASE WHEN regexp_matches(terms, '{ONE}') THEN regexp_extract(terms, '{ONE}', 1) ELSE regexp_extract(terms, '{TWO}', 1) END, '')::INT
 * CASE WHEN contains(lower(CASE WHEN regexp_matches(terms, '{ONE}') THEN regexp_extract(terms, '{ONE}') ELSE regexp_extract(terms, '{TWO}') END), 'week') THEN 7 ELSE 1 END AS lead_days,
 coalesce({", ".join(f"CASE WHEN regexp_matches(terms, '(?i){chr(92)}b{x}{chr(92)}b') THEN '{x}' END" for x in ("EXW", "FOB", "CIF", "DDP", "FOR"))}) AS incoterm""")
scalar("currency_in", lambda: {"currency": t.currency_in(C("terms"))}, r"CASE WHEN regexp_matches(terms, '₹|INR|Rs\.') THEN 'INR' WHEN regexp_matches(terms, '\$|USD') THEN 'USD' WHEN regexp_matches(terms, '€|EUR') THEN 'EUR' ELSE 'INR' END AS currency")
scalar("coverage_pct", lambda: dict(zip(("pct", "label"), t.coverage(C("line_index") * 7, C("item_key") % 13), strict=True)), "(CASE WHEN item_key % 13 <= 0 OR line_index * 7 <= 0 THEN 0 ELSE least(100, round(line_index * 7 * 100.0::DOUBLE / (item_key % 13), 1)) END)::DOUBLE AS pct, CASE WHEN item_key % 13 <= 0 OR line_index * 7 <= 0 THEN '0%' WHEN least(100, round(line_index * 7 * 100.0::DOUBLE / (item_key % 13), 1)) = round(least(100, line_index * 7 * 100.0::DOUBLE / (item_key % 13))) THEN round(least(100, line_index * 7 * 100.0::DOUBLE / (item_key % 13)))::INT || '%' ELSE printf('%.1f', round(line_index * 7 * 100.0::DOUBLE / (item_key % 13), 1)) || '%' END AS label")
STD = ", ".join(f"'{u}'" for u in t.STANDARD_UNITS)
scalar("item_confidence", lambda: {"confidence": t.item_confidence(C("raw_description"), C("quoted_qty"), C("quoted_uom"), C("price"), C("tax_rate_pct"), C("part_number"))}, rf"greatest(0.1::DOUBLE, least(1.0::DOUBLE, round((5 + CASE WHEN length(trim(raw_description)) >= 3 AND NOT regexp_matches(raw_description, '^\d+$') THEN 25 ELSE 0 END + CASE WHEN price > 0 THEN 25 ELSE 0 END + CASE WHEN quoted_qty > 0 THEN 15 ELSE 0 END + CASE WHEN upper(quoted_uom) IN ({STD}) THEN 15 WHEN quoted_uom <> '' THEN 5 ELSE 0 END + CASE WHEN tax_rate_pct > 0 THEN 10 ELSE 0 END + CASE WHEN length(trim(part_number)) >= 2 THEN 5 ELSE 0 END) / 100.0::DOUBLE, 2))) AS confidence")
scalar("content_hash", lambda: {"quote_ref": F.concat(F.lit("Q-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "raw_description", "part_number"), 256), 1, 8)))}, "'Q-' || upper(substr(sha256(raw_description || '|' || part_number), 1, 8)) AS quote_ref")
