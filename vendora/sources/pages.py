"""Pages of documents after extraction: page, text, and the tables found on each as grids.

What reads a PDF is not part of the engine; everything that follows is.  A grid is
array<array<string>>, tables an array of grids (null or empty without any).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.functions.columns import strip
from vendora.sources.delimited import grid_rows, key_values

#: Key of a page's text, and most characters of it that are kept.
PAGE_KEY, PAGE_TEXT = "texto_completo_pagina_", 20_000
SNIPPET_LINES = 3


def wanted_pages(pages: DataFrame, wanted: list[int] | None) -> DataFrame:
    return pages.where(F.col("page").isin(*wanted)) if wanted else pages


def table_rows(pages: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """page, table, row, cells (header -> cell) of all tables with a header and a row; rows of another width are left out."""
    grids = wanted_pages(pages, wanted).select("page", F.posexplode("tables").alias("table", "grid"))
    return grid_rows(grids).select("page", "table", "row", "cells")


def page_texts(pages: DataFrame, wanted: list[int] | None = None, most: int = PAGE_TEXT) -> DataFrame:
    """Text of a document without tables: page, nome_base and leftovers for each page with text."""
    rows = wanted_pages(pages, wanted).where(strip(F.coalesce("text", F.lit(""))) != "")
    number = F.col("page").cast("string")
    return rows.select("page", F.concat(F.lit("Conteúdo da Página "), number).alias("nome_base"), F.create_map(F.concat(F.lit(PAGE_KEY), number), F.substring(strip("text"), 1, most)).alias("leftovers"))


def document_rows(pages: DataFrame, document: str, wanted: list[int] | None = None) -> DataFrame:
    """document, page, row, cells: rows of tables, or, for documents whose tables give no row, the texts of their pages."""
    grids = wanted_pages(pages, wanted).select(document, "page", F.posexplode("tables").alias("table", "grid"))
    found = grid_rows(grids).select(document, "page", "table", "row", "cells")
    with_rows = found.select(document).distinct()
    rest = wanted_pages(pages, wanted).join(with_rows, document, "left_anti").where(strip(F.coalesce("text", F.lit(""))) != "")
    number = F.col("page").cast("string")
    cells = F.create_map(F.concat(F.lit(PAGE_KEY), number), F.substring(strip("text"), 1, PAGE_TEXT))
    texts = rest.select(document, "page", F.lit(None).cast("int").alias("table"), F.lit(0).alias("row"), cells.alias("cells"))
    return found.unionByName(texts)


def _cell(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def _body(grid: Column) -> Column:
    return F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))


def single_page(pages: DataFrame) -> DataFrame:
    """page, headers, rows of each page: its first table with something in its body, else its lines split at whitespace, the first as header.

    A page with neither has empty ones.
    """
    useful = F.filter("tables", lambda t: (F.size(t) >= 2) & F.exists(_body(t), lambda r: F.exists(r, lambda c: _cell(c) != "")))
    table = F.try_element_at(useful, F.lit(1))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r"), strip), lambda x: x != "")
    words = F.transform(lines, lambda x: F.split(x, r"(?U)\s+"))
    none = F.array().cast("array<array<string>>")
    grid = F.when(table.isNotNull(), F.transform(table, lambda r: F.transform(r, _cell))).when(F.size(lines) >= 2, words).otherwise(none)
    header = F.coalesce(F.try_element_at(grid, F.lit(1)), F.array().cast("array<string>"))
    return pages.select("page", header.alias("headers"), _body(grid).alias("rows"))


def region_rows(regions: DataFrame) -> DataFrame:
    """regions with headers, rows of each region: the first table's header, its rows and all rows of later tables; without tables, lines split at two spaces."""
    tables = F.coalesce("tables", F.array().cast("array<array<array<string>>>"))
    joined = F.flatten(tables)
    split = F.transform(F.split(strip(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.transform(F.split(x, "  "), strip))
    empty = F.array().cast("array<array<string>>")
    grid = F.when(F.size(tables) > 0, joined).when(strip(F.coalesce("text", F.lit(""))) != "", split).otherwise(empty)
    header = F.coalesce(F.try_element_at(grid, F.lit(1)), F.array().cast("array<string>"))
    return regions.select(*(c for c in regions.columns if c not in ("text", "tables")), header.alias("headers"), _body(grid).alias("rows"))


def region_pairs(regions: DataFrame) -> DataFrame:
    """page, pairs (map) of the key and value lines of each region that has any, to be standardised."""
    return key_values(regions).where(F.size("pairs") > 0).select("page", "pairs")


def preview(pages: DataFrame, start: int = 1, count: int = 1) -> DataFrame:
    """page, has_table, snippet (its first lines) of count pages from start on; all of them if count is 0."""
    rows = pages.where(F.col("page") >= start)
    rows = rows.where(F.col("page") < start + count) if count else rows
    first = F.slice(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r"), 1, SNIPPET_LINES)
    return rows.select("page", (F.coalesce(F.size("tables"), F.lit(0)) > 0).alias("has_table"), F.array_join(first, "\n").alias("snippet"))


def full_page(pages: DataFrame) -> DataFrame:
    """page, text, table: a page's whole text and the rows of its region table without the header, null if it has none."""
    rows = region_rows(pages.withColumn("_text", F.coalesce("text", F.lit(""))))
    return rows.select("page", F.col("_text").alias("text"), F.when(F.size("rows") > 0, F.col("rows")).alias("table"))
