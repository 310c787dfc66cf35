"""Chat formatting with schema fingerprints, in DataFrame functions only.

A layout is known by its fingerprint: the hash of its sorted nested field paths.  The
fingerprint selects a declarative mapping, a SQL expression over the fields, to canonical turns.
Of the layouts whose paths a table or record has all, the one with the most is taken, so further fields,
known ones too, change nothing; a record in which two layouts of one size are whole is left
unmapped, as either could lose texts.  Typed tables are fingerprinted by their schema, JSON records
row by row, so one column may mix prompts, instructions and message lists; both use the
same table of mappings.  A table with a role, a text and a turn is one of turns, whatever else it has.

Template: each turn is ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts a
backslash is doubled, and one is put after the first character of every control string
(``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so no text can hold a control
string and unescaping gives the text back.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])"
TURNS = "array<struct<role string, text string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted nested field paths of a type; [] stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _list(column: str, role: str, text: str) -> str:
    return f"transform({column}, m -> struct({role} as role, cast(m.{text} as string) as text))"


def _said(*turns: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"struct('{role}' as role, cast({text} as string) as text)" for role, text in turns) + ")"


_FROM = "case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else cast(m.`from` as string) end"
_ROLE = "cast(m.role as string)"
#: Field paths of a layout -> SQL expression of a record's turns.
LAYOUTS: dict[tuple[str, ...], str] = {
    ("messages[].content", "messages[].role"): _list("messages", _ROLE, "content"),
    ("messages[].role", "messages[].text"): _list("messages", _ROLE, "text"),
    ("conversations[].from", "conversations[].value"): _list("conversations", _FROM, "value"),
    ("prompt", "response"): _said(("user", "prompt"), ("assistant", "response")),
    ("completion", "prompt"): _said(("user", "prompt"), ("assistant", "completion")),
    ("answer", "question"): _said(("user", "question"), ("assistant", "answer")),
    ("instruction", "output"): _said(("user", "instruction"), ("assistant", "output")),
    ("input", "instruction", "output"): _said(("user", "concat_ws('\\n\\n', instruction, nullif(input, ''))"), ("assistant", "output")),
    ("prompt", "response", "system"): _said(("system", "system"), ("user", "prompt"), ("assistant", "response")),
}
#: Layouts of tables with one row for each turn: field paths -> SQL expressions of turn, role and text.
BY_TURN: dict[tuple[str, ...], dict[str, str]] = {
    ("role", "text", "turn"): {"turn": "turn", "role": "role", "text": "text"},
    ("content", "role", "turn"): {"turn": "turn", "role": "role", "text": "content"},
}


def known_paths() -> set[str]:
    """Paths that make up fingerprints of records."""
    return {p for paths in LAYOUTS for p in paths}


def largest_contained(paths: list[str], table: dict) -> tuple[str, ...] | None:
    """The largest layout of a table whose paths are all there; None if there is none, or if two are as large."""
    inside = sorted((x for x in table if set(x) <= set(paths)), key=len, reverse=True)
    return None if not inside or (len(inside) > 1 and len(inside[1]) == len(inside[0])) else inside[0]


def _layout_of(df: DataFrame, id_column: str) -> tuple[dict | str | None, list[str]]:
    """The mapping of a typed table, if a layout that it holds has one, and all its paths.

    A table that holds a layout of BY_TURN is one of turns (text goes before content, where a table has both); else it is one of records.
    """
    paths = [p for f in df.schema.fields if f.name != id_column for p in field_paths(f.dataType, f.name)]
    by_turn = max((x for x in BY_TURN if set(x) <= set(paths)), default=None)
    found = by_turn or largest_contained(paths, LAYOUTS)
    mappings = {fingerprint(list(x)): to for x, to in (LAYOUTS | BY_TURN).items()}
    return (mappings[fingerprint(list(found))] if found else None), paths


def canonical_turns(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text: a row for each turn of a typed table in any known layout, of records or of turns.

    Further columns are ignored.  An unknown layout, or two of one size, is an error that names
    the table's paths.  A record whose list of turns is null or empty has no row.
    """
    mapping, paths = _layout_of(df, id_column)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    key = F.col(id_column).cast("bigint").alias("conv_id")
    if isinstance(mapping, dict):
        return df.select(key, F.expr(mapping["turn"]).cast("bigint").alias("turn"), F.expr(mapping["role"]).cast("string").alias("role"), F.expr(mapping["text"]).cast("string").alias("text"))
    return df.select(key, F.posexplode(F.expr(mapping).cast(TURNS)).alias("turn", "m")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.text")


def turns_by_row(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id, turns for a typed table of whole records in a known layout; an unknown one is an error that names its paths."""
    mapping, paths = _layout_of(df, id_column)
    if not isinstance(mapping, str):
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return df.select(F.col(id_column).cast("bigint").alias("conv_id"), F.expr(mapping).cast(TURNS).alias("turns"))


def _record_type() -> str:
    """The type that holds every path of LAYOUTS, for reading JSON records."""
    lists: dict[str, set[str]] = {}
    plain = set()
    for path in known_paths():
        if "[]." in path:
            lists.setdefault(path.split("[].")[0], set()).add(path.split("[].")[1])
        else:
            plain.add(path)
    fields = [f"`{p}` string" for p in sorted(plain)] + [f"`{p}` array<struct<{', '.join(f'`{x}`: string' for x in sorted(own))}>>" for p, own in sorted(lists.items())]
    return ", ".join(fields)


def record_paths(record: Column) -> Column:
    """Sorted paths of a JSON object that any layout uses; of a list's elements, those that any of them has.  Null for other JSON."""
    known = F.array(*(F.lit(p) for p in sorted(known_paths())))
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    found = top
    for name in sorted({p.split("[].")[0] for p in known_paths() if "[]." in p}):
        elements = F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>")
        inner = F.flatten(F.filter(F.transform(elements, lambda e: F.json_object_keys(e)), lambda k: k.isNotNull()))
        prefix = F.lit(f"{name}[].")
        below = F.transform(inner, lambda k: F.concat(prefix, k))  # noqa: B023
        found = F.concat(found, F.coalesce(below, F.array().cast("array<string>")))
    return F.when(F.json_object_keys(record).isNotNull(), F.array_sort(F.array_intersect(F.array_distinct(found), known)))


def layout_paths(paths: Column) -> Column:
    """largest_contained of LAYOUTS as a column: the sorted paths of the layout that a record's paths hold, null for none or two of one size."""
    every = F.array(*(F.array(*(F.lit(p) for p in sorted(x))) for x in LAYOUTS))
    inside = F.filter(every, lambda x: F.size(F.array_except(x, paths)) == 0)
    size = F.array_max(F.transform(inside, lambda x: F.size(x)))
    largest = F.filter(inside, lambda x: F.size(x) == size)
    return F.when(F.size(largest) == 1, F.get(largest, F.lit(0)))


def turns_of_json(df: DataFrame, id_column: str = "conv_id", json_column: str = "record") -> DataFrame:
    """conv_id, turns, layout (fingerprint), paths for JSON records of mixed layouts; a row for every row of df.

    Each record is fingerprinted by itself, by the paths of the largest layout that it holds.
    turns is null for records that aren't objects, that hold no layout or two of one size
    (unmapped lists them, with the fingerprint of all their known paths).  Numbers and other scalars are taken as their JSON text.
    """
    rows = df.select(F.col(id_column).cast("bigint").alias("conv_id"), F.col(json_column).cast("string").alias("record"))
    rows = rows.select("conv_id", record_paths(F.col("record")).alias("paths"), F.from_json("record", _record_type()).alias("r"))
    held = F.coalesce(layout_paths(F.col("paths")), F.col("paths"))
    rows = rows.withColumn("layout", F.sha2(F.array_join(held, "\n"), 256)).select("conv_id", "paths", "layout", "r.*")
    turns = F.lit(None).cast(TURNS)
    for paths, sql in LAYOUTS.items():
        turns = F.when(F.col("layout") == fingerprint(list(paths)), F.expr(sql).cast(TURNS)).otherwise(turns)
    return rows.select("conv_id", turns.alias("turns"), "layout", "paths")


def unmapped(turns: DataFrame) -> DataFrame:
    """conv_id, layout, paths of the records that turns_of_json gave no turns: those to look at before they are lost."""
    return turns.where("turns is null").select("conv_id", "layout", "paths")


def format_turn_rows(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Format a table with one row for each turn: conv_id, n_turns, formatted, loss_spans.

    loss_spans are (start, length) in characters of formatted, from 0, around each
    assistant text.  Turns are ordered by turn, then role, then text; a null turn comes
    first; null roles and texts are empty; repeated rows are repeated turns; rows with a
    null conv_id are one conversation; other columns are ignored.  Starts are a running
    sum in a window, so a long conversation costs no more than its length; the window
    and the grouping share one shuffle.
    """
    missing = {"role", "text", "turn"} - set(df.columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)}")
    rows = df.select(F.col(id_column).cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    rows = rows.select("conv_id", "role", "piece", F.length("head").alias("to_body"), F.length("body").alias("size"), F.row_number().over(order).alias("at"), (F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")).alias("start"))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("start") + F.col("to_body")).alias("start"), F.col("size").cast("bigint").alias("length")))
    grouped = rows.select("conv_id", F.struct("at", "piece", span.alias("span")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def format_table(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Format a typed table in any known layout, which its fingerprint tells: conv_id, n_turns, formatted, loss_spans."""
    return format_turn_rows(canonical_turns(df, id_column))


def format_turns(df: DataFrame) -> DataFrame:
    """Format conv_id, turns as turns_by_row and turns_of_json give them.

    An empty list is a conversation without turns.  A null one is no conversation: its
    record has no mapping, and is listed by unmapped instead.
    """
    turns = df.select("conv_id", F.posexplode("turns").alias("turn", "m"))
    some = format_turn_rows(turns.select("conv_id", "turn", "m.role", "m.text"))
    none = df.where(F.size("turns") == 0).select("conv_id", F.lit(0).cast("bigint").alias("n_turns"), F.lit("").alias("formatted"), F.array().cast("array<struct<start bigint, length bigint>>").alias("loss_spans"))
    return some.unionByName(none)


def read_turns(formatted: Column) -> Column:
    """Turns read back from formatted text: array of (role, text), unescaped."""
    parts = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 2_000_000_000)
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; all read back from the formatted text.

    A conversation without turns has the digests of the empty text; repeated rows are
    digested each; an empty table gives an empty one.
    """
    rows = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
