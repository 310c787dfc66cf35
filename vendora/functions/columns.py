"""Column expressions: cleaning, search patterns, months, URLs and JSON."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that count as empty, after stripping and in lower case.
NULL_TOKENS = ("", "nan", "none", "#n/a", "na", "<na>")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Stripped text, or null for an empty token."""
    s = strip(c.cast("string"))
    return F.when(~F.lower(s).isin(*NULL_TOKENS), s)


def squeeze(c: Column) -> Column:
    """Whitespace runs to one space, stripped, empty to null."""
    s = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.nullif(s, F.lit(""))


def pattern_of(term: str) -> str:
    """The LIKE pattern of texts that contain a term; % and _ in it stay wildcards, a backslash is one."""
    return "%" + term.lower().replace("\\", "\\\\") + "%"


def contains_any(columns: list[str] | tuple[str, ...], term: str) -> Column:
    """Case-insensitive search of a term in any of the columns, as pattern_of says."""
    pattern = pattern_of(term)
    return reduce(or_, [F.coalesce(F.lower(F.col(c)).like(pattern), F.lit(False)) for c in columns])


def since_month_start(ts: Column, as_of: str) -> Column:
    """From the first instant of as_of's month on, without an upper bound."""
    return ts >= F.date_trunc("month", F.to_timestamp(F.lit(as_of))).cast("timestamp_ntz")


def host(url: Column) -> Column:
    """After the last //, up to the first /, in lower case; port and www. stay."""
    return F.lower(F.element_at(F.split(F.element_at(F.split(url, "//"), -1), "/"), 1))


def title(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def json_object_in(text: Column) -> Column:
    """The widest {...} of a text, if it is JSON; else the text."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    whole = F.when(found != "", found).otherwise(text)
    return F.when(F.try_parse_json(whole).isNotNull(), whole).otherwise(text)


def first_text(values: Column) -> Column:
    """First non-empty string of an array."""
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & (strip(v) != "")), F.lit(1))


def lines(text: Column, n: int) -> Column:
    """First n non-empty lines, stripped."""
    return F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), 1, n)


def split_list(text: Column) -> Column:
    """Comma list to array: trimmed, without empties."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def shorten(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments, navigation and tags out, entities of the five XML names back, spaces squeezed."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|noscript|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(body, r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeeze(text)
