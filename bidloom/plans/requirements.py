"""Queries of catalogues and requirement lists, and their DuckDB SQL."""

from pyspark.sql import functions as F

from bidloom.functions import text as t
from bidloom.operators import requirements
from bidloom.plans.commercial import Tables
from bidloom.sources.domain import VIEWS, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql(oracle)
        return f

    return keep


#: Catalogues of 25 parts each, with headers in four ways.
VIEWS |= {
    "catalog_rows": """
        SELECT doc_id, cast(row_no AS int) AS row_no, cells FROM (
        SELECT 'C-' || (p_partkey ~/ 25) AS doc_id, 0 AS row_no, CASE (p_partkey ~/ 25) % 4 WHEN 0 THEN array('Item Code', 'Item Description', 'Mfg PN', 'Req. Qty', 'UOM', 'Make', 'Grade') WHEN 1 THEN array('SKU', 'Product Name', 'Quantity', 'Unit', 'Code', 'Size (mm)', 'Brand')
          WHEN 2 THEN array('Ref', 'Name', 'Order Qty', 'Pack', 'MPN', 'Supplier', 'Type') ELSE array('Particulars', 'Part No.', 'MPN', 'Demand', 'Units', '', 'Material') END AS cells FROM {part} WHERE p_partkey % 25 = 0
        UNION ALL SELECT 'C-' || (p_partkey ~/ 25), 1 + p_partkey % 25, CASE WHEN p_partkey % 19 = 0 THEN array('', '', '', '', '', '', '') WHEN (p_partkey ~/ 25) % 4 = 3 THEN array(p_name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END, CASE WHEN p_partkey % 10 = 0 THEN 'none' ELSE 'M' || p_partkey END, 'about ' || p_size, 'nos', '', p_type)
          ELSE array(CASE WHEN p_partkey % 6 = 0 THEN 'None' ELSE p_brand || '/' || (p_partkey % 7) END, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'mp' || p_partkey END, CASE WHEN p_partkey % 7 = 0 THEN 'tbd' ELSE p_size || ' pcs' END, CASE WHEN p_partkey % 8 = 0 THEN '-' ELSE 'Kgs' END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, p_type) END FROM {part}) x""",
    "asked_lines": """
        SELECT 'RFQ-' || (l_orderkey % 500) AS rfq_id, cast(row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS int) AS pos, CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 5 = 1 THEN 'new ' || (l_partkey % 40) ELSE p_brand || '-' || p_partkey END AS sku,
               CASE WHEN l_partkey % 10 = 0 THEN lower(p_brand) || '-' || p_partkey ELSE '' END AS internal_sku, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE p_name END AS description, CASE WHEN l_partkey % 13 = 0 THEN 'N/A' WHEN l_partkey % 17 = 0 THEN '-3' ELSE cast(cast(l_quantity AS int) AS varchar(20)) END AS qty,
               CASE WHEN l_partkey % 7 = 0 THEN 'n/a' ELSE 'kg' END AS uom, CASE WHEN l_partkey % 6 = 0 THEN 'ITEM-' || p_partkey ELSE '' END AS internal_item_id
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
}
STEPS = " ".join(f"WHEN regexp_matches(' ' || said || ' ', ' (?:{"|".join(w)}) ') AND {r} IS NULL THEN '{r}'" for r, w in requirements.ALIASES.items())
ROLES = list(requirements.ALIASES)
VIEWS |= {
    "o_catalog_heads": "SELECT doc_id, max(cells) FILTER (WHERE row_no = 0) AS headers, count(*) FILTER (WHERE row_no > 0) AS n_rows FROM {catalog_rows} GROUP BY 1",
    "o_catalog_fold": f"""
        (WITH RECURSIVE f AS (SELECT doc_id, headers, n_rows, 0 AS i, {", ".join(f"NULL::INT AS {r}" for r in ROLES)}, []::INT[] AS specs, 0::DECIMAL(9,2) AS score FROM {{o_catalog_heads}}
          UNION ALL SELECT doc_id, headers, n_rows, i + 1, {", ".join(f"CASE WHEN role = '{r}' THEN i ELSE {r} END" for r in ROLES)}, CASE WHEN role = 'specs' THEN list_append(specs, i) ELSE specs END, (score + CASE role {" ".join(f"WHEN '{r}' THEN {x}" for r, x in requirements.ADDS.items())} ELSE 0 END)::DECIMAL(9,2)
          FROM (SELECT *, CASE {STEPS} WHEN regexp_matches(said, '{requirements.SPECIFICATIONS}') THEN 'specs' END AS role FROM (SELECT *, trim(regexp_replace(lower(headers[i + 1]), '[^\\w\\s]', '', 'g')) AS said FROM f WHERE i < len(headers))))
        SELECT * FROM f WHERE i = len(headers))""",
    "o_catalog": """
        SELECT doc_id, headers, n_rows, coalesce(sku, 0) AS sku, coalesce(words, 1) AS words, mpn, qty, uom, brand, specs, (score + CASE WHEN sku IS NULL THEN 0.2 ELSE 0 END + CASE WHEN words IS NULL THEN 0.2 ELSE 0 END + CASE WHEN n_rows >= 2 THEN 0.1 ELSE 0 END)::DOUBLE AS score FROM {o_catalog_fold}""",
}
@query("catalog_columns", 'SELECT doc_id, sku, words AS description, mpn, qty, uom, brand, len(specs)::INT AS n_specs, score FROM {o_catalog}')
def catalog_columns(t):
    return columns(t).select("doc_id", "sku", F.col("words").alias("description"), "mpn", "qty", "uom", "brand", F.size("specs").alias("n_specs"), "score")


def columns(t):
    heads = t.catalog_rows.groupBy("doc_id").agg(F.max(F.when(F.col("row_no") == 0, F.col("cells"))).alias("headers"), F.count_if(F.col("row_no") > 0).alias("n_rows"))
    return requirements.catalog_columns(heads)


def cell(role: str) -> str:
    return f"coalesce(trim(cells[{role} + 1]), '')"


def said(role: str) -> str:
    return f"CASE WHEN lower({cell(role)}) NOT IN ('', 'none') THEN {cell(role)} END"


CODES = "CASE upper({x}) " + " ".join(f"WHEN '{n}' THEN '{c}'" for c, names in t.CATALOG_UNITS.items() for n in names) + " ELSE upper({x}) END"
VIEWS["o_catalog_items"] = f"""
SELECT *, sum(n_warnings) OVER (PARTITION BY doc_id) AS lost FROM (SELECT *, (no_code::INT + (nth > 1)::INT + (named IS NULL)::INT + (uom IS NOT NULL AND unit IS NULL)::INT + (qty IS NOT NULL AND amount IS NULL)::INT)::INT AS n_warnings
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY row_no) AS nth FROM (SELECT *, upper(coalesce({said("sku")}, {said("mpn")}, 'SKU-' || lpad(item_no::VARCHAR, 3, '0'))) AS code, {said("sku")} IS NULL AND {said("mpn")} IS NULL AS no_code, {said("words")} AS named, {said("mpn")} AS part, {said("brand")} AS make,
  CASE WHEN lower({cell("uom")}) NOT IN ('', 'none', 'null', 'n/a', 'na', '-', '—') THEN {CODES.format(x=cell("uom"))} END AS unit, nullif(greatest(try_cast(nullif(regexp_replace({cell("qty")}, '[^0-9.]', '', 'g'), '') AS DECIMAL(18,4)), 0), 0) AS amount
FROM (SELECT r.*, c.* EXCLUDE (doc_id), row_number() OVER (PARTITION BY r.doc_id ORDER BY row_no) AS item_no FROM {{catalog_rows}} r JOIN {{o_catalog}} c ON c.doc_id = r.doc_id WHERE score > 0.3 AND row_no > 0 AND array_to_string(cells, '') <> '' AND ({cell("sku")} <> '' OR {cell("words")} <> '')))))"""


@query("catalog_items", """
SELECT doc_id, item_no::INT AS item_no, code AS internal_sku, part AS manufacturer_part_number, coalesce(named, code) AS canonical_description, amount::DECIMAL(18,4) AS quantity, unit AS stocking_uom, coalesce(make, 'Standard') AS brand, len(list_filter(specs, lambda i: coalesce(trim(cells[i + 1]), '') <> ''))::INT AS n_specs, n_warnings,
CASE WHEN lost > 0 THEN greatest(0.60, round(least(1, score) - least(0.20, 0.02 * lost), 2)) ELSE least(1, score) END::DOUBLE AS confidence FROM {o_catalog_items}""")
def catalog_items(t):
    items = requirements.catalog_items(t.catalog_rows, columns(t))
    return items.select("doc_id", "item_no", "internal_sku", "manufacturer_part_number", "canonical_description", "quantity", "stocking_uom", "brand", F.size("specifications").alias("n_specs"), "n_warnings", "confidence")


VIEWS["o_asked_lines"] = """
SELECT *, unseen AND row_number() OVER (PARTITION BY rfq_id, code, unseen ORDER BY pos) = 1 AND row_number() OVER (PARTITION BY rfq_id, item_id, unseen ORDER BY pos) = 1 AS is_new
FROM (SELECT *, code NOT IN (SELECT upper(internal_sku) FROM {item_master}) AND item_id NOT IN (SELECT internal_item_id FROM {item_master}) AS unseen FROM (SELECT *, coalesce(nullif(internal_item_id, ''), 'ITEM-' || code) AS item_id
FROM (SELECT *, upper(coalesce(nullif(sku, ''), nullif(internal_sku, ''), 'SKU-' || lpad(pos::VARCHAR, greatest(3, length(pos::VARCHAR))::INT, '0'))) AS code, CASE WHEN try_cast(qty AS DECIMAL(18,4)) > 0 THEN try_cast(qty AS DECIMAL(18,4)) END AS amount, CASE WHEN uom <> 'n/a' THEN upper(uom) END AS unit FROM {asked_lines})))"""


@query("create_rfq_lines", "SELECT rfq_id, pos, item_id AS internal_item_id, code AS sku, coalesce(nullif(description, ''), code) AS description, amount AS requested_quantity, unit AS requested_uom, is_new FROM {o_asked_lines}")
def create_rfq_lines(t):
    return requirements.rfq_lines(t.asked_lines, t.item_master)


@query("requirement_preview", "SELECT rfq_id, pos, concat_ws(',', CASE WHEN amount IS NULL THEN 'quantity' END, CASE WHEN unit IS NULL THEN 'uom' END, CASE WHEN description = '' THEN 'description' END) AS missing_fields, amount IS NOT NULL AND unit IS NOT NULL AND description <> '' AS is_complete FROM {o_asked_lines}")
def requirement_preview(t):
    return requirements.completeness(requirements.rfq_lines(t.asked_lines, t.item_master))
