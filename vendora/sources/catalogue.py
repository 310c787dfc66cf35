"""Supplier files of any supported kind, by extension."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.sources import delimited, workbook

#: Extensions by kind.
KINDS = {".csv": "delimited", ".xlsx": "workbook", ".xls": "workbook", ".pdf": "pages"}


def kind_of(path: str) -> str:
    """delimited, workbook or pages; any other extension is an error."""
    kind = KINDS.get(posixpath.splitext(path)[1].lower())
    if kind is None:
        raise ValueError(f"unsupported file format: {path}")
    return kind


def read_file(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """All-string rows with _file and _row of a CSV file or a workbook (its sheets one after another).

    A .xls file is read if it is such an archive by its content; the older binary format gives a row with the reader's error.

    PDF files must be extracted first: see sources.pages.
    """
    kind = kind_of(path)
    if kind == "pages":
        raise ValueError("PDF files are read as extracted pages")
    if kind == "delimited":
        return delimited.read_delimited(spark, path, surplus=True)
    rows = workbook.read_workbook(spark, path, sheet)
    names = workbook.headers_of(spark, path, sheet)
    cells = [F.try_element_at("cells", F.lit(n)).alias(n) for n in names]
    return rows.select(*cells, F.col("path").alias("_file"), (F.coalesce("sheet_no", F.lit(0)).cast("bigint") * (1 << 32) + F.col("row")).alias("_row"))


def preview_file(spark: SparkSession, path: str, n: int = 5) -> tuple[list[str], DataFrame]:
    """Headers and first rows of a CSV file, of which only the head is read, or of a workbook's first sheet."""
    if kind_of(path) == "delimited":
        return delimited.preview_head(spark, path, n)
    headers = workbook.headers_of(spark, path, first_only=True)
    rows = workbook.read_workbook(spark, path).where(F.coalesce("sheet_no", F.lit(0)) == 0)
    return headers, rows.orderBy("path", "row").limit(n).select(*(F.try_element_at("cells", F.lit(h)).alias(h) for h in headers))
