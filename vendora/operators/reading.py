"""Scopes, filters, searches, pages and listings."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendora.functions.columns import contains_any, pattern_of


#: Kinds of usage and of history entries.
USAGE_ACTIONS = (
    "criacao_titulo_produto", "criacao_descricao_produto", "enriquecimento_web_produto", "otimizacao_seo_conteudo", "geracao_tags_produto", "analise_sentimento_reviews",
    "traducao_conteudo_produto", "sumarizacao_caracteristicas", "sugestao_atributos_gemini", "criacao_produto", "outro",
)
HISTORY_ACTIONS = ("CRIACAO", "ATUALIZACAO", "DELECAO")
#: Columns that searches look at.
PRODUCT_SEARCH = ("nome_base", "nome_chat_api", "descricao_original", "descricao_chat_api", "sku", "ean", "marca", "modelo")
SUPPLIER_SEARCH = ("nome", "email_contato", "contato_principal")
TYPE_SEARCH = ("key_name", "friendly_name", "description")


def tenant(df: DataFrame, owner: str, user: int | None, admin: bool = False, open_without_user: bool = False) -> DataFrame:
    """Rows of the user; all for an administrator; without a user none, or all where the table is open."""
    if admin or (user is None and open_without_user):
        return df
    return df.where(F.lit(False)) if user is None else df.where(F.col(owner) == user)


def own_or_global(df: DataFrame, owner: str, user: int | None) -> DataFrame:
    c = F.col(owner)
    return df.where(c.isNull() if user is None else (c == user) | c.isNull())


def matching(df: DataFrame, equals: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, contains: dict | None = None) -> DataFrame:
    """Optional conditions: those with a value of None are left out; ranges are closed."""
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    for c, v in (at_least or {}).items():
        if v is not None:
            df = df.where(F.col(c) >= F.lit(v).cast(df.schema[c].dataType))
    for c, v in (at_most or {}).items():
        if v is not None:
            df = df.where(F.col(c) <= F.lit(v).cast(df.schema[c].dataType))
    for c, v in (contains or {}).items():
        if v is not None:
            df = df.where(F.lower(F.col(c)).like(pattern_of(v)))
    return df


def search(df: DataFrame, columns: list[str] | tuple[str, ...], term: str | None) -> DataFrame:
    return df.where(contains_any(columns, term)) if term else df


GRAM, GRAM_BUCKETS = 3, 64


def grams_in(text: str | None) -> set[str]:
    """The different runs of GRAM characters of a text."""
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)} if text else set()


def trigram_index(df: DataFrame, key: str, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Postings of the searched columns: gram_bucket, gram, key, a row for each different gram of a row's columns in lower case.

    To be written with partitionBy("gram_bucket"), so that a search reads the buckets of its grams alone.
    """

    def postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), [c.to_pylist() for c in batch.columns[1:]]
            for low in range(0, batch.num_rows, 100):
                found = [set().union(*(grams_in(t[i]) for t in texts)) for i in range(low, min(low + 100, batch.num_rows))]
                of = pa.array([low + i for i, x in enumerate(found) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([g for x in found for g in x], pa.string()), keys.take(of)], ["gram", key])

    lowered = df.select(key, *(F.lower(F.col(c).cast("string")).alias(f"_{i}") for i, c in enumerate(columns)))
    rows = lowered.mapInArrow(postings, T.StructType([T.StructField("gram", T.StringType()), df.schema[key]]))
    placed = rows.select(F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS)).cast("int").alias("gram_bucket"), "gram", key)
    return placed.repartition("gram_bucket", F.pmod(F.xxhash64(key), F.lit(GRAM_BUCKETS))).sortWithinPartitions("gram_bucket", "gram")


def grams_of_term(term: str) -> list[str]:
    """Grams that every text with this term has: those between its wildcards."""
    pieces = re.split("[%_]", term.lower())
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def search_indexed(df: DataFrame, index: DataFrame, key: str, columns: list[str] | tuple[str, ...], term: str | None) -> DataFrame:
    """search by the postings of trigram_index: keys with all grams of the term, looked up in df and verified there.

    A term without three characters in a row is searched by a scan.  The buckets and grams are
    literals, so only their partitions and row groups are read.  Postings are of a row, not of one of its columns;
    the pattern decides.
    """
    wanted = grams_of_term(term) if term else []
    if not wanted:
        return search(df, columns, term)
    spark = df.sparkSession
    places = spark.createDataFrame([(g,) for g in wanted], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS)).cast("int").alias("b")).distinct()
    hits = index.where(F.col("gram_bucket").isin([r.b for r in places.collect()]) & F.col("gram").isin(wanted))
    keys = hits.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted)).select(key)
    return search(df.join(keys, key, "left_semi"), columns, term)


def order_of(df: DataFrame, column: str | None, descending: bool, key: str) -> list[Column]:
    """Sort by a column of df, else by the key; the key breaks ties.  Nulls come last."""
    by = column if column in df.columns else key
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return [first] if by == key else [first, F.col(key).asc()]


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 10, most: int = 200) -> DataFrame:
    if skip < 0 or not 1 <= limit <= most:
        raise ValueError(f"skip must be 0 or more and limit between 1 and {most}")
    return df.orderBy(*order).offset(skip).limit(limit)


def held_page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 10, most: int = 200) -> DataFrame:
    """page, computed once and held by the driver (at most most rows), for joins that read it more than once."""
    rows = page(df, order, skip, limit, most)
    return df.sparkSession.createDataFrame(rows.collect(), rows.schema)


#: A deep page is sorted once so many rows are left around it.
ENOUGH = 100_000
BINS = 256


def _bin(values: Column, kind: T.DataType, low, high) -> Column:
    """A bin that grows with the value: BINS even ones of numbers and times, the next character of strings that begin alike."""
    if isinstance(kind, T.StringType):
        alike = len(os.path.commonprefix([low, high]))
        return F.substring(values, alike + 1, 1)
    number = lambda c: c.cast("timestamp").cast("double") if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else c.cast("double")
    first, last = number(F.lit(low).cast(kind)), number(F.lit(high).cast(kind))
    # Longs can differ by less than doubles tell: they are one bin, and what is left is sorted.
    return F.least(F.floor(F.coalesce(F.try_divide(number(values) - first, last - first), F.lit(0.0)) * BINS), F.lit(BINS - 1))


def _around(df: DataFrame, column: str, descending: bool, skip: int, limit: int, enough: int) -> tuple[DataFrame, int, bool]:
    """(rows, rank of the first of them, whether all have one value) that hold the ranks skip to skip + limit - 1 by one column, nulls last.

    Round by round the rows are counted in bins with their least and greatest values, and
    only the bins with those ranks stay; a filter on the values reaches the scan.
    """
    kind, value, before = df.schema[column].dataType, F.col(column), 0
    n, low, high = df.where(value.isNotNull()).agg(F.count("*"), F.min(value), F.max(value)).first()
    if skip >= n:
        return df.where(value.isNull()), n, True
    with_nulls = skip + limit > n
    while low != high:
        inside = df.where(value.between(F.lit(low).cast(kind), F.lit(high).cast(kind)))
        rows = inside.groupBy(_bin(value, kind, low, high).alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        rows.sort(key=lambda r: r.low, reverse=descending)
        kept, at = [], before
        for r in rows:
            if at + r.n > skip and at < skip + limit:
                kept.append((at, r))
            at += r.n
        before = kept[0][0]
        left = sum(r.n for _, r in kept)
        shrunk = len(kept) < len(rows)
        low, high = min(r.low for _, r in kept), max(r.high for _, r in kept)
        if left <= enough or not shrunk:
            break
    found = df.where(value.between(F.lit(low).cast(kind), F.lit(high).cast(kind)) | value.isNull() if with_nulls else value.between(F.lit(low).cast(kind), F.lit(high).cast(kind)))
    return found, before, low == high and not with_nulls


def deep_page(df: DataFrame, columns: list[tuple[str, bool]], skip: int, limit: int = 10, most: int = 200, enough: int = ENOUGH) -> DataFrame:
    """page for any skip, without a sort of all rows: columns (name, whether descending) in order, nulls last.

    Histograms of the first column find the values that hold the page (of its ties, histograms of the
    next one, and so on); what is left, at most about enough rows and the page, is sorted.
    Skips beyond the end give no rows.
    """
    if skip < 0 or not 1 <= limit <= most:
        raise ValueError(f"skip must be 0 or more and limit between 1 and {most}")
    rows, rest = df, skip
    for name, descending in columns:
        rows, before, one_value = _around(rows, name, descending, rest, limit, enough)
        rest -= before
        if not one_value:
            break
    order = [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in columns]
    return rows.orderBy(*order).offset(rest).limit(limit)


def page_number(skip: int, limit: int) -> int:
    return skip // limit + 1


def federated(branches: list[tuple[str, DataFrame, str, str, Column]], limit: int) -> DataFrame:
    """Newest rows of several tables: (kind, table, id column, name column, created) in each branch.

    Each branch is cut to its own top rows before the union, so only limit rows a branch
    are merged.
    """
    out = None
    for kind, df, key, name, created in branches:
        rows = df.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), F.col(name).alias("name"), created.alias("created"))
        top = rows.orderBy(F.desc_nulls_last("created"), F.desc("id")).limit(limit)
        out = top if out is None else out.unionByName(top)
    return out.orderBy(F.desc_nulls_last("created"), F.desc("id"), "kind").limit(limit)


def lookup(df: DataFrame, **equals) -> DataFrame:
    """The row with these values, by id or by a unique string; of several the first in order of all columns, none if a value is None."""
    if any(v is None for v in equals.values()):
        return df.limit(0)
    return matching(df, equals).orderBy(*df.columns).limit(1)


def same_name_elsewhere(df: DataFrame, key: str, name: str, owner: str | None = None) -> DataFrame:
    """Rows whose name, in lower case, another row (of the same owner, where one is given) has too."""
    same = [F.lower(F.col(name)).alias("_name"), *([F.col(owner).alias("_owner")] if owner else [])]
    many = df.groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1 and _name is not null")
    match = F.lower(df[name]) == many["_name"]
    if owner:
        match = match & df[owner].eqNullSafe(many["_owner"])
    return df.join(many, match, "left_semi")


def resolve(df: DataFrame, text: str, id_column: str, key_column: str, owner: str, user: int) -> DataFrame:
    """The row with this id, else with this key; own before global; none that belongs to another user."""
    by_id = F.col(id_column) == F.try_to_number(F.lit(text), F.lit("9999999999")).cast("bigint")
    by_key = F.col(key_column) == text
    rank = F.when(by_id, 0).when(by_key & (F.col(owner) == user), 1).otherwise(2)
    found = own_or_global(df.where(F.coalesce(by_id, F.lit(False)) | F.coalesce(by_key, F.lit(False))), owner, user)
    return found.withColumn("_rank", rank).orderBy("_rank", id_column).limit(1).drop("_rank")


def can_log_in(users: DataFrame) -> DataFrame:
    """Active users with a password hash."""
    return users.where(F.col("is_active") & F.col("hashed_password").isNotNull())


def valid_reset(users: DataFrame, token: str, now: str) -> DataFrame:
    """The user with this reset token (kept as its SHA-256), if it hasn't expired."""
    return users.where((F.col("reset_password_token") == F.sha2(F.lit(token), 256)) & (F.col("reset_password_token_expires_at") >= F.to_timestamp(F.lit(now))))


def attribute_conflicts(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (id, type_id, attribute_key) whose key another attribute of their type already has."""
    theirs = existing.select("type_id", "attribute_key", F.col("id").alias("_id"))
    return rows.join(theirs, (rows["type_id"] == theirs["type_id"]) & (rows["attribute_key"] == theirs["attribute_key"]) & ~theirs["_id"].eqNullSafe(rows["id"]), "left_semi")


def key_conflicts(rows: DataFrame, existing: DataFrame, key: str, owner: str, row_id: str = "id") -> DataFrame:
    """Rows whose key another row of the same owner, or a global one, already has."""
    theirs = existing.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"), F.col(row_id).alias("_id"))
    same = (F.col(key) == F.col("_key")) & (F.col("_owner").isNull() | F.col("_owner").eqNullSafe(F.col(owner))) & ~F.col("_id").eqNullSafe(F.col(row_id))
    return rows.join(theirs, same, "left_semi")
