"""Regions, rows and profiles of document lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def doc_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, text) of each line of a text, from 1."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line_no"), "text")


def tokens(line):
    return F.filter(F.split(line, r"[ \t]+"), lambda x: x != "")


def _blank(line):
    return F.trim(line) == ""


def segment_regions(lines: DataFrame) -> DataFrame:
    """Runs of lines that are not blank, numbered within their document."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.coalesce(F.lag(_blank(F.col("text"))).over(order), F.lit(True))
    begins = (~_blank(F.col("text")) & before).cast("int")
    rows = lines.withColumn("region", F.sum(begins).over(order)).where(~_blank(F.col("text")))
    return rows.groupBy("doc_id", "region").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"), F.max(F.size(tokens(F.col("text")))).alias("n_cols"))


def numeric_rows(lines: DataFrame) -> DataFrame:
    """Lines that may be table rows: three tokens or more, two of them with digits."""
    cells = tokens(F.col("text"))
    return lines.where((F.size(cells) >= 3) & (F.size(F.filter(cells, lambda x: x.rlike("[0-9]"))) >= 2)).select("doc_id", "line_no", F.size(cells).alias("n_cells"))


def profile(lines: DataFrame) -> DataFrame:
    """Lines, lines that are not blank, their share, and the widest line in tokens, by document."""
    filled = F.count_if(~_blank(F.col("text")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), filled.alias("n_filled"), F.round(filled / F.count("*"), 4).alias("density"), F.max(F.size(tokens(F.col("text")))).alias("n_cols"))


def scan_warnings(lines: DataFrame) -> DataFrame:
    """What a scan of each document leaves to be desired: no text at all, or text without any row of numbers."""
    rows = numeric_rows(lines).groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    out = lines.groupBy("doc_id").agg(F.sum(F.length(F.trim("text"))).alias("n_chars")).join(rows, "doc_id", "left")
    warning = F.when(F.col("n_chars") == 0, "SCANNED_PDF_NO_TEXT").when(F.col("n_rows").isNull(), "PDF_TABLE_EXTRACTION_UNSUPPORTED")
    return out.select("doc_id", "n_chars", warning.alias("warning"))


def merge_continuations(lines: DataFrame) -> DataFrame:
    """Lines that do not begin with a capital go on from the item before them; (doc_id, item_no, n_lines, text)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.where(~_blank(F.col("text"))).withColumn("item_no", F.sum(F.col("text").rlike(r"^[A-ZÀ-ÖØ-Þ]").cast("int")).over(order)).where("item_no > 0")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return rows.groupBy("doc_id", "item_no").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
