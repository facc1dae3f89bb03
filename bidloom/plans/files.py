"""Queries that write files of the given tables and read them back, and of accuracy; and their DuckDB SQL."""

from pyspark.sql import functions as F

from bidloom.operators import accuracy
from bidloom.plans.commercial import Tables
from bidloom.sources import files
from bidloom.sources.domain import VIEWS, sql
from bidloom.sources.stage import new_path

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql(oracle)
        return f

    return keep


@query("csv_cells", """
WITH p AS (SELECT p_partkey::VARCHAR AS key, [p_partkey::VARCHAR, p_name || chr(10) || 'size; ' || p_size, p_brand || ' "x"', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END] AS c FROM {part})
SELECT key, unnest(range(4))::INT AS col_no, unnest(c) AS value FROM p""")
def csv_cells(t):
    """The parts, written as files with semicolons, quotes and cells of two lines, and read as cells."""
    path = new_path(t.spark, "csv")
    words = F.concat(F.col("p_name"), F.lit("\n"), F.lit("size; "), F.col("p_size").cast("string"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))
    rows = t.part.select(F.col("p_partkey").cast("string").alias("key"), words.alias("words"), F.concat("p_brand", F.lit(' "x"')).alias("brand"), kind.alias("kind"))
    rows.write.options(sep=";", quote='"', escape='"', emptyValue="").csv(path)
    cells = files.csv_cells(files.documents(t.spark, path).where("reader = 'csv'").withColumn("doc_id", F.col("name")))
    keys = cells.where("col_no = 0").select("doc_id", "row_no", F.col("value").alias("key"))
    return cells.join(keys, ["doc_id", "row_no"]).select("key", "col_no", "value")


@query("json_records", "SELECT CASE WHEN event_id % 11 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 11 = 0 THEN '{broken ' || event_id END AS _bad FROM {events}")
def json_records(t):
    """The events, written as JSON lines of which every eleventh is broken, and read with the broken ones kept."""
    path = new_path(t.spark, "json")
    line = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    t.events.select(line.alias("value")).write.text(path)
    return files.records(t.spark, path, "event_id long, event_type string").select("event_id", "event_type", "_bad")


#: What was read of each part's description against the truth: words in another order, some missing, some run together.
VIEWS |= {
    "o_texts": "SELECT DISTINCT lower(p_type || ' ' || CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '') ELSE p_name END) AS a, lower(p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END || ' ' || p_size || 'mm') AS b FROM {part}",
    "o_sets": "SELECT a, b, array_to_string(list_sort(list_intersect(x, y)), ' ') AS both_, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS l, array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS r FROM (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM {o_texts})",
    "o_set_pairs": "SELECT DISTINCT x, y FROM (SELECT trim(both_ || ' ' || l) AS x, trim(both_ || ' ' || r) AS y FROM {o_sets} UNION ALL SELECT both_, trim(both_ || ' ' || l) FROM {o_sets} UNION ALL SELECT both_, trim(both_ || ' ' || r) FROM {o_sets}) WHERE x <> '' AND y <> ''",
    "o_indel": """
        SELECT x, y, 2 * prev[len(prev)] / (length(x) + length(y))::DOUBLE AS ratio FROM (
        WITH RECURSIVE step AS (SELECT x, y, 0 AS k, list_transform(range(length(y)), lambda z: 0::BIGINT) AS prev, []::BIGINT[] AS cur FROM {o_set_pairs} UNION ALL
          SELECT x, y, k + 1, CASE WHEN k % length(y) = length(y) - 1 THEN list_append(cur, v) ELSE prev END, CASE WHEN k % length(y) = length(y) - 1 THEN []::BIGINT[] ELSE list_append(cur, v) END
          FROM (SELECT *, CASE WHEN substr(x, 1 + k // length(y), 1) = substr(y, 1 + k % length(y), 1) THEN coalesce(prev[k % length(y)], 0) + 1 ELSE greatest(prev[1 + k % length(y)], coalesce(cur[k % length(y)], 0)) END AS v FROM step WHERE k < length(x) * length(y)))
        SELECT * FROM step WHERE k = length(x) * length(y))""",
}


@query("token_set_ratio", """
SELECT a, b, CASE WHEN both_ <> '' AND (l = '' OR r = '') THEN 1 ELSE greatest(p.ratio, coalesce(q.ratio, 0), coalesce(s.ratio, 0)) END::DOUBLE AS ratio FROM {o_sets} o LEFT JOIN {o_indel} p ON p.x = trim(both_ || ' ' || l) AND p.y = trim(both_ || ' ' || r)
LEFT JOIN {o_indel} q ON both_ <> '' AND q.x = both_ AND q.y = trim(both_ || ' ' || l) LEFT JOIN {o_indel} s ON both_ <> '' AND s.x = both_ AND s.y = trim(both_ || ' ' || r)""")
def token_set_ratio(t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    a = F.lower(F.concat_ws(" ", "p_type", name))
    b = F.lower(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")), F.concat(F.col("p_size").cast("string"), F.lit("mm"))))
    pairs = t.part.select(a.alias("a"), b.alias("b")).distinct()
    return pairs.withColumn("ratio", accuracy.token_set_ratio(F.col("a"), F.col("b")))


VIEWS |= {
    "truth_lines": "SELECT quote_id AS doc_id, CASE WHEN item_key % 8 = 0 THEN line_index + 1 ELSE line_index END AS line_index, CASE WHEN item_key % 5 = 0 THEN 'other goods' WHEN item_key % 3 = 0 THEN upper(raw_description) ELSE raw_description || ' in boxes' END AS raw_description FROM {quote_lines} WHERE item_key % 13 <> 0",
    "found_lines": "SELECT quote_id AS doc_id, line_index, raw_description FROM {quote_lines} WHERE item_key % 11 <> 0",
}


def greedy(found: str, truth: str) -> str:
    """Turns of a document's true lines, one after the other, in SQL; lines are numbered by line_index and description."""
    return f"""
WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index, raw_description) AS spot FROM {{{found}}}), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index, raw_description) AS turn FROM {{{truth}}}),
p AS (SELECT f.doc_id, turn, list_sort(list(spot)) AS options FROM f JOIN t ON t.doc_id = f.doc_id AND (contains(lower(f.raw_description), lower(t.raw_description)) OR contains(lower(t.raw_description), lower(f.raw_description))) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS nth FROM p),
g AS (SELECT DISTINCT doc_id, 0::BIGINT AS nth, []::BIGINT[] AS taken, NULL::BIGINT AS turn, NULL::BIGINT AS pick FROM n
  UNION ALL SELECT doc_id, nth, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, turn, pick FROM (SELECT n.doc_id, n.nth, taken, n.turn, list_filter(n.options, lambda o: NOT list_contains(taken, o))[1] AS pick FROM g JOIN n ON n.doc_id = g.doc_id AND n.nth = g.nth + 1))
SELECT g.doc_id, t.line_index, f.line_index AS found_index FROM g JOIN t ON t.doc_id = g.doc_id AND t.turn = g.turn JOIN f ON f.doc_id = g.doc_id AND f.spot = g.pick"""


@query("precision_recall", f"""
SELECT doc_id, n_found, n_there, n_true, coalesce(round(100.0 * n_true / nullif(n_found, 0), 2), 0)::DOUBLE AS precision_pct, coalesce(round(100.0 * n_true / nullif(n_there, 0), 2), 0)::DOUBLE AS recall_pct
FROM (SELECT doc_id, coalesce(a, 0)::BIGINT AS n_found, coalesce(b, 0)::BIGINT AS n_there, coalesce(n, 0)::BIGINT AS n_true FROM (SELECT doc_id, count(*) AS a FROM {{found_lines}} GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS b FROM {{truth_lines}} GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({greedy("found_lines", "truth_lines")}) GROUP BY 1) USING (doc_id))""")
def precision_recall(t):
    return accuracy.precision_recall(t.found_lines, t.truth_lines)


FIELDS = ("qty", "uom", "price", "disc", "tax")
VIEWS |= {
    "eval_lines": """
        SELECT 'D-' || (l_orderkey ~/ 2) AS doc_id, cast(row_number() OVER (PARTITION BY l_orderkey ~/ 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS bigint) AS line_index, l_partkey AS k, p_name, p_type, cast(l_quantity AS bigint) AS qty,
               CASE WHEN l_partkey % 2 = 0 THEN 'PCS' ELSE 'KG' END AS uom, cast(l_extendedprice AS decimal(18, 2)) AS price, cast(l_discount AS decimal(9, 4)) AS disc, cast(l_tax AS decimal(9, 4)) AS tax FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "eval_found": "SELECT doc_id, line_index, p_name || ' ' || p_type AS raw_description, qty, uom, price, disc, tax FROM {eval_lines} WHERE k % 17 <> 0",
    "eval_truth": """
        SELECT doc_id, line_index, CASE line_index % 3 WHEN 0 THEN split_part(p_type, ' ', 1) WHEN 1 THEN upper(p_name) ELSE p_name || ' ' || p_type || ' in boxes' END AS raw_description, CASE WHEN k % 10 = 0 THEN qty + 1 ELSE qty END AS qty,
               CASE WHEN k % 7 = 0 THEN 'SET' ELSE uom END AS uom, price, disc, CASE WHEN k % 19 = 0 THEN NULL ELSE tax END AS tax FROM {eval_lines} WHERE k % 13 <> 0""",
    "eval_states": """
        SELECT DISTINCT doc_id, CASE length(doc_id) % 3 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'RECONCILED' ELSE 'DISCREPANCY' END AS expected,
               CASE WHEN doc_id LIKE '%7' THEN 'REVIEW_REQUIRED' WHEN length(doc_id) % 3 = 0 THEN 'REVIEW_REQUIRED' WHEN length(doc_id) % 3 = 1 THEN 'RECONCILED' ELSE 'DISCREPANCY' END AS actual FROM {eval_lines}""",
}
VIEWS["o_hits"] = greedy("eval_found", "eval_truth")


@query("greedy_matches", "SELECT * FROM {o_hits}")
def greedy_matches(t):
    return accuracy.greedy_matches(t.eval_found, t.eval_truth)


@query("evaluation_report", f"""
SELECT n_documents, n_found, n_there, n_true, n_found - n_true AS n_false, {", ".join(f"coalesce(round(100.0 * {a} / nullif({b}, 0), 2), 100)::DOUBLE AS {k}_pct" for k, a, b in (("precision", "n_true", "n_found"), ("recall", "n_true", "n_there"), *((f, f + "_right", "n_true") for f in FIELDS), ("reconciliation", "ok", "n_documents"), ("review", "review", "n_documents")))}
FROM (SELECT count(*) AS n_found FROM {{eval_found}}), (SELECT count(*) AS n_there FROM {{eval_truth}}), (SELECT count(*) AS n_documents, count(*) FILTER (expected = actual) AS ok, count(*) FILTER (actual = 'REVIEW_REQUIRED') AS review FROM {{eval_states}}),
     (SELECT count(*) AS n_true, {", ".join(f"count(*) FILTER (f.{x} IS NOT DISTINCT FROM t.{x}) AS {x}_right" for x in FIELDS)} FROM {{o_hits}} h JOIN {{eval_found}} f ON f.doc_id = h.doc_id AND f.line_index = h.found_index JOIN {{eval_truth}} t ON t.doc_id = h.doc_id AND t.line_index = h.line_index)""")
def evaluation_report(t):
    return accuracy.evaluation_report(accuracy.evaluated(t.eval_found, t.eval_truth, FIELDS), t.eval_states, FIELDS)
