"""Quotation files as tables: which reader takes a file, its id, comma-separated files as cells, and JSON records."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Readers by suffix; a spreadsheet's and a printed document's cells or lines come as tables of their own.
READERS = {"csv": "csv", "txt": "csv", "tsv": "csv", "json": "json", "xlsx": "cells", "xls": "cells", "xlsm": "cells", "pdf": "lines"}
DELIMITERS = ",\t;|"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The files under path: (path, name, suffix, reader, error, length, content); a file of an unknown suffix has an error
    and no reader; an empty file has no row. Columns that are not asked for, the content too, are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    reader = F.coalesce(*(F.when(suffix == s, r) for s, r in READERS.items()))
    error = F.when(reader.isNull(), F.concat(F.lit("Unsupported file format: "), suffix))
    return files.select("path", name.alias("name"), suffix.alias("suffix"), reader.alias("reader"), error.alias("error"), "length", "content")


def with_doc_id(files: DataFrame) -> DataFrame:
    """files with the hash of their content and the quotation's id from it."""
    digest = F.sha2("content", 256)
    return files.withColumns({"content_hash": digest, "doc_id": F.concat(F.lit("Q-"), F.upper(F.substring(digest, 1, 8)))})


def decoded(data: bytes) -> str:
    """UTF-8 with or without a byte order mark, else Latin-1."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def delimiter(text: str) -> str:
    """The delimiter found most often in the first line that has any, the first of equals; a comma where none has."""
    for line in text.splitlines():
        counts = [line.count(d) for d in DELIMITERS]
        if max(counts):
            return DELIMITERS[counts.index(max(counts))]
    return ","


def rows_of(data: bytes) -> list[list[str]]:
    """A file's rows, quoted cells of several lines in one, all as wide as the widest."""
    text = decoded(data)
    rows = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text))]
    width = max(map(len, rows), default=0)
    return [row + [""] * (width - len(row)) for row in rows]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True):
            rows = rows_of(data.as_py() or b"")
            width = len(rows[0]) if rows else 0
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                yield pa.record_batch({
                    "doc_id": pa.array([doc] * len(part) * width, pa.string()), "sheet": pa.array([0] * len(part) * width, pa.int32()), "row_no": pa.array([at + i for i in range(len(part)) for _ in range(width)], pa.int32()),
                    "col_no": pa.array(list(range(width)) * len(part), pa.int32()), "value": pa.array([c for row in part for c in row], pa.string()),
                })


def csv_cells(files: DataFrame) -> DataFrame:
    """Cells (doc_id, sheet, row_no, col_no, value) of comma-separated files (doc_id, content). A file is one record; an
    empty one has no cells."""
    return files.select("doc_id", "content").mapInArrow(_cells, "doc_id string, sheet int, row_no int, col_no int, value string")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records under path, one a line; a line that is none is a row of nulls with the line in ``_bad``."""
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of spreadsheets from a Parquet table of them under path: (doc_id, sheet, sheet_name, row_no, col_no, value,
    formula, has_formula, is_hidden_row, is_hidden_col). A null value is blank; of the columns that the table lacks, the sheet
    is the first, the name empty, the formula null and the flags false. A formula is a text that begins with an equals sign."""
    return as_cells(spark.read.parquet(path))


def as_cells(table: DataFrame) -> DataFrame:
    """``read_cells`` of a table at hand."""
    given = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in table.columns else F.lit(default)
    formula = F.col("formula").cast("string") if "formula" in table.columns else F.lit(None).cast("string")
    return table.select(
        F.col("doc_id").cast("string").alias("doc_id"), given("sheet", "int", 0).alias("sheet"), given("sheet_name", "string", "").alias("sheet_name"), F.col("row_no").cast("int").alias("row_no"), F.col("col_no").cast("int").alias("col_no"),
        F.trim(given("value", "string", "")).alias("value"), formula.alias("formula"), F.coalesce(formula.startswith("="), F.lit(False)).alias("has_formula"),
        given("is_hidden_row", "boolean", False).alias("is_hidden_row"), given("is_hidden_col", "boolean", False).alias("is_hidden_col"),
    )
