"""Delimited supplier files: sniff the head of each file on the driver, then read distributed.

Every cell is a string; the header row names the columns.  Cells may hold line feeds in quotes, and a
file of any size is still read by many tasks: a first pass over its splits finds what each does
to the state at its start (outside of quotes, or within), these functions are composed in
the order of splits, and so every task of the second pass knows whether its first line
starts a row.  The pieces of a row that crosses a border meet in a small shuffle.
"""

from __future__ import annotations

import ast
import codecs
import csv
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendora.functions.columns import clean, strip

#: Candidate delimiters, the order of the fallback, and the name of surplus cells.
DELIMITERS = ",;\t|"
FALLBACK = (";", "\t", ",")
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
SURPLUS = "None"
SAMPLE_BYTES = 64 * 1024
#: Spark reads no Windows code page: such a file is read as Latin-1 and these characters are put right after.
SPARK_NAMES = {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32": "UTF-32"}
#: Encodings in which the bytes of quotes, delimiters and line feeds stand for nothing else.
BYTEWISE = ("utf-8-sig", "cp1252")
_LATIN = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0))
_TO_WINDOWS = str.maketrans(_LATIN, _WINDOWS)


#: Cells may be as long as a file.
csv.field_size_limit(1 << 30)


def _fields(row: str, sep: str) -> list[str]:
    """Cells of one row."""
    return next(csv.reader([row], delimiter=sep), [])


def charset(sample: bytes) -> str:
    """Python name of the encoding of a file, from its first bytes: its mark, else where its zeros are, else whether it is UTF-8."""
    for mark, name in MARKS:
        if sample.startswith(mark):
            return name
    even, odd = sample[0::2].count(0), sample[1::2].count(0)
    if 4 * max(even, odd) > len(sample) // 2 and 4 * min(even, odd) < max(even, odd):  # letters below U+0100 in two bytes
        return "utf-16-le" if odd > even else "utf-16-be"
    return "utf-8-sig" if _decodes(sample) else "cp1252"


def _text(sample: bytes, encoding: str) -> str:
    return sample[: len(sample) // 4 * 4 if "32" in encoding else len(sample) // 2 * 2 if "16" in encoding else None].decode(encoding, "replace").removeprefix("\ufeff")


def sniff(sample: bytes, encoding: str | None = None) -> tuple[str, str]:
    """(delimiter, Python encoding) from the first bytes of a file; the dialect is guessed from the first five lines."""
    encoding = encoding or charset(sample)
    lines = _text(sample, encoding).splitlines()
    try:
        return csv.Sniffer().sniff("\n".join(lines[:5]), DELIMITERS).delimiter, encoding
    except csv.Error:
        return next((d for d in FALLBACK[:-1] if lines and d in lines[0]), FALLBACK[-1]), encoding


def _decodes(sample: bytes) -> bool:
    try:
        sample.decode("utf-8")
    except UnicodeDecodeError as e:
        return len(sample) == SAMPLE_BYTES and e.start >= SAMPLE_BYTES - 3  # a character cut off by the end of the sample
    return True


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files that a path or pattern names, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out: list[str] = []
    for found in system.globStatus(hadoop) or ():
        inner = system.listStatus(found.getPath()) if found.isDirectory() else [found]
        out += [str(x.getPath().toString()) for x in inner if not x.isDirectory() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def head_of(spark: SparkSession, path: str, size: int = SAMPLE_BYTES) -> bytes:
    """The first bytes of a file of any size."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def _header(sample: bytes, sep: str, encoding: str) -> list[str]:
    return next((row for row in csv.reader(_text(sample, encoding).splitlines(keepends=True), delimiter=sep) if row), [])


def _surplus(sep: str, width: int):
    """Cells of a raw line beyond the header's, as a list's text; only lines of another width than the header's are split here."""

    @F.pandas_udf("string")
    def cells(raw: pd.Series) -> pd.Series:
        def beyond(line: str | None) -> str | None:
            row = _fields(line, sep) if line else []
            return str(row[width:]) if len(row) > width else None

        return raw.map(beyond)

    return cells


def surplus_cells(text: str) -> list[str]:
    """The cells that a surplus column's text lists."""
    return ast.literal_eval(text)


def _read(spark: SparkSession, paths: list[str], sep: str, encoding: str, header: list[str], multi_line: bool, surplus: bool) -> DataFrame:
    names = [f"_c{i}" for i in range(len(header))]
    schema = ", ".join(f"{n} string" for n in [*names, "_raw"])
    # Where bytes can't be read line by line, a file is one task.
    multi_line = multi_line or encoding not in BYTEWISE
    options = {"sep": sep, "encoding": SPARK_NAMES.get(encoding, encoding), "header": True, "enforceSchema": True, "multiLine": multi_line, "escape": '"', "columnNameOfCorruptRecord": "_raw", "mode": "PERMISSIVE"}
    rows = spark.read.schema(schema).options(**options).csv(paths)
    of = lambda c: F.translate(F.col(c), _LATIN, _WINDOWS) if encoding == "cp1252" else F.col(c)
    over = _surplus(sep, len(header))(of("_raw")) if surplus else F.lit(None)
    return _named(rows.select(*(of(n).alias(n) for n in names), over.cast("string").alias(SURPLUS), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")), header, surplus)


def _named(rows: DataFrame, header: list[str], surplus: bool) -> DataFrame:
    """Columns _c0, _c1, ... under their header; of columns with one name the last counts."""
    last = {h: f"_c{i}" for i, h in enumerate(header)}
    return rows.select(*(F.col(c).alias(h) for h, c in last.items()), *([SURPLUS] if surplus else []), "_file", "_row")


def after_line(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a line feed at the end of a line is within quotes, given whether the line starts there.

    A quote counts at the start of a cell only; within quotes two of them are one.
    """
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] == b'"':
                at, inside = at + 1, True
            else:
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
        end = line.find(b'"', at)
        while end >= 0 and line[end + 1 : end + 2] == b'"':
            end = line.find(b'"', end + 2)
        if end < 0:
            return True
        at, inside = line.find(sep, end + 1) + 1, False
        if not at:
            return False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw lines with their file and the start of their split, in order."""
    return spark.read.option("lineSep", "\n").text(paths).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def splits_of(spark: SparkSession, paths: list[str], sep: str) -> list:
    """For each split (file, start), in order: within and without, whether it ends in quotes if it starts within them or not; closes, whether a row that was open at its start ends there; spans, whether any row goes on beyond a line; utf8."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, split, state = sep.encode(), None, None

        def said() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("file", "start", *state), (*split, *state.values()), strict=True))])

        for batch in batches:
            for line, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != split:
                    if split:
                        yield said()
                    split, state = place, {"within": True, "without": False, "closes": False, "spans": False, "utf8": True}
                    line = line.removeprefix(codecs.BOM_UTF8)
                if not line.isascii():
                    try:
                        line.decode()
                    except UnicodeDecodeError:
                        state["utf8"] = False
                if b'"' in line:
                    state["within"], state["without"] = after_line(line, state["within"], mark), after_line(line, state["without"], mark)
                    state["closes"] |= not state["within"]
                    state["spans"] |= state["without"]
        if split:
            yield said()

    found = _lines(spark, paths).mapInArrow(scan, "file string, start bigint, within boolean, without boolean, closes boolean, spans boolean, utf8 boolean")
    return sorted(found.collect(), key=lambda r: (r.file, r.start))  # a row a split


def _across(spark: SparkSession, paths: list[str], splits: list, sep: str, encoding: str, header: list[str], surplus: bool) -> DataFrame:
    """As _read, of files whose rows may go on over lines and splits."""
    begins: dict[tuple[str, int], tuple[bool, int]] = {}  # of a split: whether a row is open, and the split where that began
    for before, this in zip([None, *splits], splits, strict=False):
        open_, since = False, this.start
        if before is not None and before.file == this.file:
            was, from_ = begins[before.file, before.start]
            open_ = before.within if was else before.without
            # A row that was open before and never closed there is still the same.
            since = (from_ if was and not before.closes else before.start) if open_ else this.start
        begins[this.file, this.start] = open_, since
    shared = spark.sparkContext.broadcast(begins)  # a row a split

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, split = sep.encode(), None
        inside, since, place, held, first, at = False, 0, 0, [], 0, 0

        def row(whole: bool) -> tuple:
            return *split[:1], since, split[1], first, whole, b"\n".join(held)

        for batch in batches:
            out = []
            for line, *here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != split:
                    if held:
                        out.append(row(False))
                    split, (inside, since), held, at = here, shared.value[tuple(here)], [], here[1]
                    line = line.removeprefix(codecs.BOM_UTF8)
                    crossing = inside
                    first = at
                held.append(line)
                at += len(line) + 1
                if b'"' in line:
                    inside = after_line(line, inside, mark)
                if not inside:
                    out.append(row(not crossing))
                    held, first, since, crossing = [], at, split[1], False
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, r, strict=True)) for r in out], _PIECES)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, row(False), strict=True))], _PIECES)

    pieces = _lines(spark, paths).mapInArrow(rows_of, "file string, since bigint, start bigint, at bigint, whole boolean, line binary")
    # Rows that are open at a border: one for each split at most.
    joined = F.transform(F.array_sort(F.collect_list(F.struct("start", "at", "line"))), lambda x: F.hex(x["line"]))
    crossing = pieces.where("not whole").groupBy("file", "since").agg(F.max_by("at", -F.col("start")).alias("at"), F.unhex(F.array_join(joined, "0A")).alias("line"))
    every = pieces.where("whole").select("file", "at", "line").unionByName(crossing.select("file", "at", "line"))
    width, names = len(header), [f"_c{i}" for i in range(len(header))]

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode(encoding, "replace") for x in batch.column(2).to_pylist()]
            read = [_fields(t, sep) for t in texts]
            keep = [i for i, r in enumerate(read) if r]
            column = lambda c: pa.array([read[i][c] or None if c < len(read[i]) else None for i in keep], pa.string())
            over = pa.array([str(read[i][width:]) if len(read[i]) > width else None for i in keep], pa.string())
            yield pa.RecordBatch.from_arrays([*(column(c) for c in range(width)), over, *(batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1))], [*names, SURPLUS, "_file", "_row"])

    # The first row that isn't blank is the header; it lies in the first split of its file.
    top = every.where(F.length(F.regexp_replace(F.col("line").cast("string"), "[\r\n]", "")) > 0).groupBy("file").agg(F.min("at").alias("_top"))
    body = every.join(F.broadcast(top), "file").where("at > _top").select("file", "at", "line")  # a row a file, whose names the driver holds as well
    read = body.mapInArrow(cells, ", ".join(f"{n} string" for n in [*names, f"`{SURPLUS}`", "_file"]) + ", _row bigint")
    return _named(read, header, surplus)


_PIECES = pa.schema([("file", pa.string()), ("since", pa.int64()), ("start", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), ("line", pa.binary())])


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multi_line: bool = True, surplus: bool = False) -> DataFrame:
    """All-string rows with _file and _row (in file order); missing cells are null, empty cells too.

    Each file has its own dialect and header, sniffed from its head unless given; files
    that agree are read together, and columns that a file lacks are null.  multi_line lets
    quoted cells hold line feeds: a first pass over the splits of all files finds where rows go on, and
    whether bytes beyond a head aren't UTF-8 (such a file is cp1252).  Files of UTF-16 and UTF-32 are one task each.
    With surplus, cells beyond the header are kept in a column named ``None``, as the text of
    a list.  A path without files is an error.
    """
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(path)
    heads = {f: head_of(spark, f) for f in files}
    dialects = {f: (sep or found[0], encoding or found[1]) for f in files for found in [sniff(heads[f], encoding)]}
    splits: dict[str, list] = {}
    for mark in {d[0] for d in dialects.values()} if multi_line else ():
        for split in splits_of(spark, own, mark) if (own := [f for f in files if dialects[f][0] == mark and dialects[f][1] in BYTEWISE]) else ():
            splits.setdefault(_place(split.file), []).append(split)
    groups: dict[tuple, list[str]] = {}
    for f in files:
        own_sep, own_encoding = dialects[f]
        found = splits.get(_place(f), [])
        if not encoding and not all(x.utf8 for x in found):
            own_encoding = "cp1252"
        lines = any(x.spans for x in found)
        groups.setdefault((own_sep, own_encoding, tuple(_header(heads[f], own_sep, own_encoding)), lines), []).append(f)
    parts = []
    for (own_sep, own_encoding, header, lines), own in groups.items():
        if lines:
            found = [x for f in own for x in splits[_place(f)]]
            parts.append(_across(spark, own, sorted(found, key=lambda r: (r.file, r.start)), own_sep, own_encoding, list(header), surplus))
        else:
            parts.append(_read(spark, own, own_sep, own_encoding, list(header), False, surplus))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.select(*(F.col("`" + c.replace("`", "``") + "`") for c in rows.columns if c not in ("_file", "_row")), "_file", "_row")


def _place(path: str) -> str:
    """A file's path without its scheme and authority, in which listings and readers differ; escapes resolved."""
    return unquote(re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", path))


def headers_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("_file", "_row")]


def preview(rows: DataFrame, n: int = 5) -> tuple[list[str], DataFrame]:
    """Headers and the first n rows."""
    headers = headers_of(rows)
    return headers, rows.orderBy("_file", "_row").limit(n).select(*(F.col("`" + h.replace("`", "``") + "`") for h in headers))


def preview_head(spark: SparkSession, path: str, n: int = 5) -> tuple[list[str], DataFrame]:
    """Headers and the first n rows of the first file of a path, from as much of its head as they take."""
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(path)
    size = SAMPLE_BYTES
    while True:
        head = head_of(spark, files[0], size)
        sep, encoding = sniff(head[:SAMPLE_BYTES])
        rows = [r for r in csv.reader(_text(head, encoding).splitlines(keepends=True), delimiter=sep) if r]
        if len(head) < size or len(rows) > n + 1:  # the last row may be cut
            break
        size *= 4
    header, body = (rows[0] if rows else []), rows[1 : n + 1]
    names = list(dict.fromkeys(header))
    last = {h: i for i, h in enumerate(header)}
    cells = [tuple((r[last[h]] or None) if last[h] < len(r) else None for h in names) for r in body]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in names])
    return names, spark.createDataFrame(cells, schema)


def key_values(pages: DataFrame, text_column: str = "text") -> DataFrame:
    """pages with pairs, a map of a region's text: lines with a colon split once; without any such line, ``col_{i}`` for each line."""
    lines = F.filter(F.split(F.col(text_column), "\n"), lambda x: strip(x) != "")
    pairs = F.filter(lines, lambda x: F.contains(x, F.lit(":")))
    keyed = F.transform(pairs, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    plain = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("col_"), i.cast("string")).alias("k"), strip(x).alias("v")))
    chosen = F.when(F.size(pairs) > 0, keyed).otherwise(plain)
    last = F.aggregate(chosen, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return pages.withColumn("pairs", last)


def standard_header(cells: Column) -> Column:
    """Header cells cleaned; a blank one is ``coluna_vazia_{i}``."""
    return F.transform(cells, lambda h, i: F.coalesce(clean(h), F.concat(F.lit("coluna_vazia_"), i.cast("string"))))


def grid_rows(grid: DataFrame) -> DataFrame:
    """Extracted table grids (``grid`` array<array<string>>) to rows of header -> cell.

    The first row is the header, a blank header is ``coluna_vazia_{i}``, and rows of
    another width are left out.  Of headers with one name the last counts.
    """
    header = standard_header(F.element_at("grid", 1))
    body = F.filter(F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0))), lambda r: F.size(r) == F.size(F.element_at("grid", 1)))
    # Cells of a header that comes again further right are left out.
    entries = lambda r: F.filter(F.transform(F.arrays_zip(header.alias("k"), r.alias("v")), lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(header, e["i"] + 2, F.size(header)), e["k"]))
    cells = F.transform(body, lambda r: F.map_from_entries(F.transform(entries(r), lambda e: F.struct(e["k"], e["v"]))))
    return grid.where(F.size("grid") > 1).select("*", F.posexplode(cells).alias("row", "cells"))
