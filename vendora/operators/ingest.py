"""Import of supplier rows: headers, cleaning, rejects, deduplication, upsert, audit."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendora.functions.columns import clean, strip
from vendora.plans.checkpoints import Tables, guarded, materialize
from vendora.plans.graph import components

#: Header in lower case -> standard field.
SYNONYMS = {
    "nome": "nome_base", "produto": "nome_base", "item": "nome_base", "title": "nome_base", "título": "nome_base", "titulo": "nome_base",
    "sku": "sku_original", "código": "sku_original", "codigo": "sku_original", "ref": "sku_original", "referência": "sku_original", "referencia": "sku_original",
    "marca": "marca", "fabricante": "marca", "brand": "marca",
    "categoria": "categoria_original", "category": "categoria_original",
    "descrição": "descricao_original", "descricao": "descricao_original", "description": "descricao_original",
    "ean": "ean_original", "gtin": "ean_original", "upc": "ean_original",
    "preço": "preco_original", "preco": "preco_original", "price": "preco_original", "valor": "preco_original",
    "url_imagem": "imagem_url_original", "imagem": "imagem_url_original", "image_url": "imagem_url_original",
}
FIELDS = ("nome_base", "sku_original", "ean_original", "marca", "categoria_original", "descricao_original", "preco_original", "imagem_url_original")
#: Fixed value: name of a product that has none.
NAMELESS = "Produto Importado"
REASON = "no name and no SKU"
DUPLICATE = "duplicate SKU or EAN"
#: Fixed value: columns whose names start so hold a reader's error instead of a cell.
READ_ERROR = "erro_processamento"
#: Fields of a file that reach products; the others are for display.
PRODUCT_FIELDS = ("nome_base", "descricao_original", "marca", "categoria_original")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def standardise(rows: DataFrame, headers: list[str], mapping: dict[str, str] | None = None, keep: tuple[str, ...] = (), product_type: int | None = None) -> DataFrame:
    """Standard fields, leftovers (map), reason, linha_original and product_type_id of every raw row; keep: columns passed on.

    Headers are matched in lower case and stripped; mapping (header -> field) overrides the
    synonyms.  Of several headers for one field the first with a value wins.  A row
    without name and SKU takes its first leftover as name; without one it has a reason.
    A reader's error is a reason as well.  linha_original has the cells as they came,
    only of rows with a reason.  product_type is stamped on all rows.
    """
    known = SYNONYMS | {k.strip().lower(): v for k, v in (mapping or {}).items()}
    sources: dict[str, list[str]] = {}
    rest, broken = [], []
    for h in headers:
        field = known.get(h.strip().lower())
        if h.strip().lower().startswith(READ_ERROR):
            broken.append(h)
        elif field in FIELDS:
            sources.setdefault(field, []).append(h)
        else:
            rest.append(h)
    value = lambda f: F.coalesce(*(clean(_quoted(h)) for h in sources[f])) if f in sources else F.lit(None).cast("string")
    # Of headers that differ in white space alone the last with a value counts, as one key.
    alike: dict[str, list[str]] = {}
    for h in rest:
        alike.setdefault(h.strip(), []).insert(0, h)
    pairs = [x for name, own in alike.items() for x in (F.lit(name), F.coalesce(*(clean(_quoted(h)) for h in own)))]
    none = F.create_map().cast("map<string,string>")
    left = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else none
    raw = F.create_map(*(x for h in headers for x in (F.lit(h), _quoted(h).cast("string")))) if headers else none
    failed = F.coalesce(*(clean(_quoted(h)) for h in broken)) if broken else F.lit(None).cast("string")
    out = rows.select(*(_quoted(k) for k in keep), *(value(f).alias(f) for f in FIELDS), left.alias("leftovers"), raw.alias("linha_original"), failed.alias("reason"))
    rescue = F.try_element_at(F.map_values("leftovers"), F.lit(1))
    bare = F.col("nome_base").isNull() & F.col("sku_original").isNull()
    out = out.withColumn("reason", F.coalesce("reason", F.when(bare & rescue.isNull(), F.lit(REASON)))).withColumn("nome_base", F.when(bare, rescue).otherwise(F.col("nome_base")))
    out = out.withColumn("linha_original", F.when(F.col("reason").isNotNull(), F.col("linha_original")))
    return out.withColumn("product_type_id", F.lit(product_type).cast("int"))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): standardised rows without and with a reason."""
    return rows.where("reason is null"), rows.where("reason is not null")


def product_name(name: Column, sku: Column) -> Column:
    return F.coalesce(name, sku, F.lit(NAMELESS))


#: Greatest lengths, and columns that may not be negative.
LENGTHS = {"nome_base": 255, "sku": 100, "ean": 13, "ncm": 8, "marca": 100, "modelo": 100, "categoria_original": 150}
NOT_NEGATIVE = ("preco_custo", "preco_venda", "estoque_disponivel", "peso_gramas")


def failed_rules(columns: dict[str, Column]) -> Column:
    """Array of the rules that a row fails; columns: standard name -> column, for those there are."""
    rules = [(f"{c}: longer than {n}", F.length(columns[c]) > n) for c, n in LENGTHS.items() if c in columns]
    rules += [(f"{c}: negative", columns[c] < 0) for c in NOT_NEGATIVE if c in columns]
    if "nome_base" in columns:
        rules.append(("nome_base: missing", F.coalesce(strip(columns["nome_base"]), F.lit("")) == ""))
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for text, bad in rules)))


#: A tenant of up to so many rows is scanned as one.
SCAN_ROWS = 500_000


def _grouped(tables: Tables, rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """rows (_t, _o, keys, ...) with _g: rows of a tenant with different _g share no key, even through other rows.

    Small tenants are one group.  In larger ones each key links its rows to the first of
    them (a minimum with partial aggregation, so a common key is no problem), and groups
    are the connected components.
    """
    big = rows.groupBy("_t").count().where(F.col("count") > most).select("_t")
    if big.isEmpty():
        return rows.withColumn("_g", F.lit(None).cast("bigint"))
    big = tables.write(big)
    large = tables.write(rows.join(big, "_t").select("_t", "_o", *keys))
    links = None
    for k in keys:
        first = large.where(F.col(k).isNotNull()).groupBy("_t", k).agg(F.min("_o").alias("_first"))
        found = large.join(first, ["_t", k]).select(F.struct("_t", "_o").alias("a"), F.struct("_t", F.col("_first").alias("_o")).alias("b"))
        links = found if links is None else links.unionByName(found)
    of = tables.own(components(links)).select(F.col("id._t").alias("_t"), F.col("id._o").alias("_o"), F.xxhash64("component").alias("_g"))
    # Rows alone in their group are dealt over tasks by themselves.
    return rows.join(of, ["_t", "_o"], "left").join(big.withColumn("_big", F.lit(True)), "_t", "left").withColumn("_g", F.coalesce("_g", F.when(F.col("_big"), F.xxhash64("_o")))).drop("_big")


def _free_of(rows: DataFrame, taken: DataFrame, names: list[str]) -> DataFrame:
    """rows without those that have a key of a taken row."""
    for n in names:
        rows = rows.join(taken.where(F.col(n).isNotNull()).select("_t", n).distinct(), ["_t", n], "left_anti")
    return rows


def _scan_in_order(rows: DataFrame, names: list[str]) -> DataFrame:
    """_t, _o, accepted, keys: the rule, row after row; a task holds the accepted keys of one tenant at a time."""
    schema = T.StructType([*(rows.schema[c] for c in ("_t", "_o", *names)), T.StructField("accepted", T.BooleanType())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, [set() for _ in names]
        for batch in batches:
            tenants, *columns = [batch.column(i).to_pylist() for i in (0, *range(2, len(names) + 2))]
            out = []
            for t, *own in zip(tenants, *columns, strict=True):
                if t != group:
                    group, taken = t, [set() for _ in names]
                good = not any(k in x for k, x in zip(own, taken, strict=True))
                if good:
                    for k, x in zip(own, taken, strict=True):
                        if k is not None:
                            x.add(k)
                out.append(good)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], schema.names)

    return rows.select("_t", "_o", *names).repartition("_t").sortWithinPartitions("_t", "_o").mapInArrow(scan, schema)


def _round(tables: Tables, open_: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, still open) after one round: rows that are the first open ones on all their keys are accepted, and rows that share a key with them fall.

    An accepted row is the first on each of its keys, so a key is taken in this round just
    if its first row is accepted.  Firsts are minima with partial aggregation; joins
    on a common key are split by AQE.
    """
    marked = open_
    for i, n in enumerate(names):
        first = open_.where(F.col(n).isNotNull()).groupBy("_t", n).agg(F.min("_o").alias(f"_f{i}"))
        marked = marked.join(first, ["_t", n], "left")
    ready = reduce(and_, [F.col(f"_f{i}").isNull() | (F.col(f"_f{i}") == F.col("_o")) for i in range(len(names))])
    marked = tables.write(marked.select("_t", "_o", *names, ready.alias("_ready")))
    accepted = marked.where("_ready").drop("_ready")
    return accepted, _free_of(marked.where("not _ready").drop("_ready"), accepted, names)


def _first_rows(tables: Tables, open_: DataFrame, names: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, still open) after the first most rows of each tenant are scanned in order and the rows that share a key with accepted ones fell."""
    one = open_.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("top"))
    placed = tables.own(numbered(open_, ["_t", "_o"], one))
    zero = placed.groupBy("_t").agg(F.min("number").alias("_zero"))
    placed = placed.join(zero, "_t").withColumn("_head", F.col("number") - F.col("_zero") < most)
    head = tables.write(_scan_in_order(placed.where("_head"), names))
    accepted = head.where("accepted").drop("accepted")
    return accepted, _free_of(placed.where("not _head").select("_t", "_o", *names), accepted, names)


def _accepted_of_large(tables: Tables, rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """_t, _o of the accepted rows of tenants with more than most rows: rounds over all tasks, then a scan of what is left.

    Rows whose keys are a chain in input order decide few rows a round; where a round
    decides less than an eighth, the first most rows are scanned instead.  Either way a
    step costs a pass over the open rows, and memory stays bounded.
    """
    open_, found = materialize(rows.select("_t", "_o", *names)), []

    def step(decide, *more) -> None:
        nonlocal open_
        held = Tables()
        try:
            accepted, rest = decide(held, open_, names, *more)
            found.append(tables.write(accepted.select("_t", "_o")))
            held.own(open_)
            open_ = materialize(rest)
        finally:
            held.drop()

    n = open_.count()
    while not open_.groupBy("_t").count().where(F.col("count") > most).isEmpty():
        step(_round)
        left = open_.count()
        if 8 * left > 7 * n and left:
            step(_first_rows, most)
            left = open_.count()
        n = left
    tables.own(open_)
    found.append(_scan_in_order(open_, names).where("accepted").select("_t", "_o"))
    return reduce(DataFrame.unionByName, found)


@guarded
def greedy_dedup(rows: DataFrame, tenant: str, order: str, keys: list[str], most: int = SCAN_ROWS) -> DataFrame:
    """rows with accepted: in order within a tenant, a row is rejected if an accepted row has one of its keys; null and empty keys never clash.

    Tenants of up to most rows are scanned one after another by tasks, sorted by order.  Larger
    ones are decided in rounds over all tasks (a row is accepted when it is the earliest open one on all its
    keys, and its conflicts fall) until most rows are left to scan, with the same result.
    order is unique within a tenant.
    """
    tables = Tables()
    names = [f"_k{i}" for i in range(len(keys))]
    narrow = rows.select(F.col(tenant).alias("_t"), F.col(order).alias("_o"), *(F.nullif(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in zip(keys, names, strict=True)))
    big = narrow.groupBy("_t").count().where(F.col("count") > most).select("_t")
    if big.isEmpty():
        marks = _scan_in_order(narrow, names).select("_t", "_o", "accepted")
    else:
        big = tables.write(big)
        small = _scan_in_order(narrow.join(big, "_t", "left_anti"), names).where("accepted").select("_t", "_o")
        large = _accepted_of_large(tables, narrow.join(big, "_t", "left_semi"), names, most)
        marks = tables.close(small.unionByName(large).withColumn("accepted", F.lit(True)))
    marks = marks.withColumnRenamed("_t", tenant).withColumnRenamed("_o", order)
    return rows.join(marks, [tenant, order], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def upsert(products: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """New state of products (tenant, id, sku, ean, fields) after accepted incoming rows (tenant, row_no, sku, ean, fields).

    A row updates the product with its SKU, else the one with its EAN; other rows are
    inserted, with ids after the greatest, in row order.  Null and empty keys match nothing.  If
    several rows hit one product the last wins.  change is unchanged, updated or created; before has the earlier values of
    updated products.
    """
    p = products.alias("p")
    by_sku = p.where("sku <> ''").groupBy("tenant", "sku").agg(F.min("id").alias("id_sku"))
    by_ean = p.where("ean <> ''").groupBy("tenant", "ean").agg(F.min("id").alias("id_ean"))
    matched = incoming.join(by_sku, ["tenant", "sku"], "left").join(by_ean, ["tenant", "ean"], "left").withColumn("hit", F.coalesce("id_sku", "id_ean"))
    payload = F.struct("sku", "ean", *fields)
    last = matched.where("hit is not null").groupBy("tenant", "hit").agg(F.max_by(payload, "row_no").alias("new"))
    new = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    state = products.join(last.withColumnRenamed("hit", "id"), ["tenant", "id"], "left")
    before = F.when(F.col("new").isNotNull(), payload)
    state = state.select("tenant", "id", *(new(c) for c in ("sku", "ean", *fields)), F.when(F.col("new").isNotNull(), "updated").otherwise("unchanged").alias("change"), before.alias("before"))
    inserted = numbered(matched.where("hit is null").select("tenant", "row_no", "sku", "ean", *fields), ["tenant", "row_no"], products.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))
    return state.unionByName(inserted.select("tenant", F.col("number").alias("id"), "sku", "ean", *fields, F.lit("created").alias("change"), F.lit(None).cast(state.schema["before"].dataType).alias("before")))


@guarded
def numbered(rows: DataFrame, order: list[str], start: DataFrame) -> DataFrame:
    """rows with number: top (of the one-row frame start) + 1, + 2, ... in order.

    Rows are sorted by range; each range is numbered by itself and moved up by the sizes
    of those before it, so no task sees all rows.
    """
    tables = Tables()
    ranged = tables.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_zero"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranged.join(F.broadcast(before.drop("n")), "_part").join(F.broadcast(start))
    return tables.close(out.withColumn("number", (F.col("top") + F.col("_before") + F.col("_at") - F.col("_zero") + 1).cast("bigint")).drop("_part", "_at", "_zero", "_before", "top"))


def audit(created: DataFrame, user: str, key: str) -> DataFrame:
    """For each created product a usage row of no credits and a history row."""
    rows = created.select(F.col(user).alias("user_id"), F.col(key).alias("product_id"))
    usage = rows.select("user_id", "product_id", F.lit("usage").alias("log"), F.lit("CRIACAO_PRODUTO").alias("action"), F.lit(0).alias("credits"))
    history = rows.select("user_id", "product_id", F.lit("history").alias("log"), F.lit("CRIACAO").alias("action"), F.lit(None).cast("int").alias("credits"))
    return usage.unionByName(history)


class Imported(NamedTuple):
    """state: products with change and before; errors: row, error, duplicado, linha_original, product_type_id; audit rows of created products."""

    state: DataFrame
    errors: DataFrame
    audit: DataFrame

    def updates(self) -> DataFrame:
        """tenant, id, before and after of the updated products."""
        after = F.struct(*self.state.schema["before"].dataType.names)
        return self.state.where("change = 'updated'").select("tenant", "id", "before", after.alias("after"))


@guarded
def import_rows(rows: DataFrame, headers: list[str], products: DataFrame, tenant: int, order: str, mapping: dict[str, str] | None = None, supplier: int | None = None, product_type: int | None = None) -> Imported:
    """A whole file for one tenant: standardise, validate, dedup, upsert, audit.

    products: tenant, id, sku, ean, PRODUCT_FIELDS, fornecedor_id, product_type_id; any of
    the fields may be lacking.  supplier is set on every product that the file touches,
    product_type only where it is given.  errors keep the row as it came: rejected cells
    by their headers, duplicates by product fields.
    """
    tables = Tables()
    fields = [f for f in (*PRODUCT_FIELDS, "fornecedor_id") if f in products.columns]
    if product_type is not None and "product_type_id" in products.columns:
        fields.append("product_type_id")
    ready = standardise(rows, headers, mapping, (order,), product_type).withColumn("tenant", F.lit(tenant).cast("bigint"))
    checked = ready.withColumn("failed", failed_rules({"nome_base": F.col("nome_base"), "sku": F.col("sku_original"), "ean": F.col("ean_original"), "marca": F.col("marca"), "categoria_original": F.col("categoria_original")}))
    as_product = F.create_map(*(x for f in ("nome_base", "sku_original", "ean_original", *PRODUCT_FIELDS[1:]) for x in (F.lit(f), F.col(f))))
    named = product_name(F.col("nome_base"), F.col("sku_original"))
    # A missing name is no failure here: the SKU or a fixed value takes its place.
    rules = F.filter("failed", lambda x: x != "nome_base: missing")
    checked = checked.withColumn("error", F.coalesce("reason", F.when(F.size(rules) > 0, F.array_join(rules, "; ")))).drop("failed")
    checked = tables.write(checked.withColumn("linha_original", F.coalesce("linha_original", as_product)))
    unique = tables.write(greedy_dedup(checked.where("error is null"), "tenant", order, ["sku_original", "ean_original"]))
    extra = {"nome_base": named, "fornecedor_id": F.lit(supplier).cast("int")}
    good = unique.where("accepted").select("tenant", F.col(order).alias("row_no"), F.col("sku_original").alias("sku"), F.col("ean_original").alias("ean"), *(extra.get(f, F.col(f)).alias(f) for f in fields))
    others = [c for c in products.columns if c not in ("tenant", "id", "sku", "ean", *fields)]
    state = upsert(products.drop(*others), good, fields)
    if others:  # columns that an import doesn't touch
        state = state.join(products.select("tenant", "id", *others), ["tenant", "id"], "left")
    state = tables.write(state)
    kept = [order, "error", "duplicado", "linha_original", "product_type_id"]
    failures = checked.where("error is not null").withColumn("duplicado", F.lit(False)).select(*kept)
    errors = failures.unionByName(unique.where("not accepted").withColumn("error", F.lit(DUPLICATE)).withColumn("duplicado", F.lit(True)).select(*kept))
    tables.made.remove(state)
    return Imported(state, tables.close(errors), audit(state.where("change = 'created'"), "tenant", "id"))


def started_import(files: DataFrame, file_id: int, supplier: int, pages: int = 1) -> DataFrame:
    """files with one of them in progress: its supplier and number of pages set, none processed."""
    return _patched_file(files, file_id, status=F.lit("PROCESSING"), fornecedor_id=F.lit(supplier).cast("int"), total_pages=F.lit(pages).cast("int"), pages_processed=F.lit(0))


def finished_import(files: DataFrame, file_id: int, result: Imported | None, pages: int = 1) -> DataFrame:
    """files after the import of one of them: IMPORTED with a JSON summary of counts, or FAILED without a result."""
    if result is None:
        return _patched_file(files, file_id, status=F.lit("FAILED"))
    changes = result.state.agg(F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "updated").alias("updated"))
    counts = changes.join(F.broadcast(result.errors.agg(F.count("*").alias("errors")))).select(F.to_json(F.struct("created", "updated", "errors")).alias("_summary"))  # one-row frames
    joined = files.join(F.broadcast(counts))
    return _patched_file(joined, file_id, status=F.lit("IMPORTED"), pages_processed=F.lit(pages).cast("int"), result_summary=F.col("_summary")).drop("_summary")


def page_done(files: DataFrame, file_id: int) -> DataFrame:
    """files after one more page of a file is imported."""
    return _patched_file(files, file_id, pages_processed=F.col("pages_processed") + 1)


def _patched_file(files: DataFrame, file_id: int, **new: Column) -> DataFrame:
    mine = F.col("id") == file_id
    return files.select(*(F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in files.columns))


def patched(df: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df after a partial update: patch has key, the fields and a flag ``set_{field}`` for each; a set null overwrites."""
    new = {f: F.when(F.coalesce(F.col(f"set_{f}"), F.lit(False)), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    side = patch.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields), *(f"set_{f}" for f in fields))
    return df.join(side, key, "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def seeded(df: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """df with the default rows that it lacks; a second time changes nothing."""
    return df.unionByName(defaults.join(df, key, "left_anti"), allowMissingColumns=True)


@guarded
def get_or_create(products: DataFrame, rows: DataFrame, fields: list[str], most: int = SCAN_ROWS) -> DataFrame:
    """State after rows (tenant, row_no, sku, ean, fields, given), one after another in order.

    A row with an SKU updates the tenant's product with that SKU, one with an EAN alone
    the product with that EAN; without such a product, or without both keys, a product is
    inserted, which later rows find.  Of several such products the one with the least id
    (and existing before new ones) is taken.  given (array of names, optional) says which
    columns a row sets; a set null overwrites.  New ids follow the greatest, in row order.
    change is unchanged, updated or created.

    Groups of rows and products that keys connect are scanned by themselves, as in
    greedy_dedup; products that share no key with any row aren't moved.
    """
    tables = Tables()
    names = ["sku", "ean", *fields]
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    given = F.col("given") if "given" in rows.columns else F.array(*(F.lit(c) for c in names))
    asked = tables.write(rows.select("tenant", F.col("row_no").cast("bigint").alias("row_no"), *names, given.alias("given")))
    # A product can be found by a key of its own, or by one that an earlier row gave it.
    touched = products.join(asked.where(blank("sku").isNotNull()).select("tenant", "sku").distinct(), ["tenant", "sku"], "left_semi").select("tenant", "id")
    touched = touched.union(products.join(asked.where(blank("ean").isNotNull()).select("tenant", "ean").distinct(), ["tenant", "ean"], "left_semi").select("tenant", "id")).distinct()
    touched = tables.write(touched)
    mine = products.join(touched, ["tenant", "id"], "left_semi")
    shape = lambda df, at, id_, given: df.select(F.col("tenant").alias("_t"), at.alias("_o"), id_.alias("id"), *names, given.alias("given"))
    before = shape(mine, F.struct(F.lit(0).alias("kind"), F.col("id").cast("bigint").alias("n")), F.col("id").cast("bigint"), F.array().cast("array<string>"))
    after = shape(asked, F.struct(F.lit(1).alias("kind"), F.col("row_no").alias("n")), F.lit(None).cast("bigint"), F.col("given"))
    every = tables.write(before.unionByName(after).withColumn("_sku", blank("sku")).withColumn("_ean", blank("ean")))
    grouped = _grouped(tables, every, ["_sku", "_ean"], most).select("_t", "_g", "_o", "id", *names, "given")
    out_type = T.StructType([T.StructField("tenant", every.schema["_t"].dataType), T.StructField("id", T.LongType()), T.StructField("row_no", T.LongType()), *(every.schema[c] for c in names), T.StructField("change", T.StringType())])
    arrow = [("change", pa.string()), ("id", pa.int64()), ("row_no", pa.int64())]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        found: dict[str, dict[str, list[dict]]] = {"sku": {}, "ean": {}}
        group = types = None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([x["_t"] for x in held], types["_t"]), *(pa.array([x[c] for x in held], dict(arrow)[c]) for c in ("id", "row_no")), *(pa.array([x[c] for x in held], types[c]) for c in names), pa.array([x["change"] for x in held], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["tenant", "id", "row_no", *names, "change"])

        def by(key: str, value: str) -> dict | None:
            # Products leave an index when their key changes, so only those that still have the key count.
            live = [x for x in found[key].get(value, ()) if x[key] == value]
            return min(live, key=lambda x: (x["id"] is None, x["id"] or 0, x["row_no"] or 0), default=None)

        for batch in batches:
            types = {f.name: f.type for f in batch.schema}
            for row in batch.to_pylist():
                if (row["_t"], row["_g"]) != group:
                    if held:
                        yield flush()
                    group, held, found = (row["_t"], row["_g"]), [], {"sku": {}, "ean": {}}
                old = row["id"] is not None
                hit = None if old else by("sku", row["sku"]) if row["sku"] else by("ean", row["ean"]) if row["ean"] else None
                if hit is None:
                    hit = {c: row[c] if old or c in row["given"] else None for c in names} | {"_t": row["_t"], "id": row["id"], "row_no": None if old else row["_o"]["n"], "change": "unchanged" if old else "created"}
                    held.append(hit)
                else:
                    hit |= {c: row[c] for c in row["given"] if c in names}
                    if hit["change"] == "unchanged":
                        hit["change"] = "updated"
                for key in ("sku", "ean"):
                    if hit[key] and not any(x is hit for x in found[key].get(hit[key], ())):
                        found[key].setdefault(hit[key], []).append(hit)
        if held:
            yield flush()

    scanned = tables.write(grouped.repartition("_t", "_g").sortWithinPartitions("_t", "_g", "_o").mapInArrow(scan, out_type))
    untouched = products.join(touched, ["tenant", "id"], "left_anti").select("tenant", F.col("id").cast("bigint").alias("id"), *names, F.lit("unchanged").alias("change"))
    new = numbered(scanned.where("id is null").select("tenant", "row_no", *names), ["tenant", "row_no"], products.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))
    known = scanned.where("id is not null").select("tenant", "id", *names, "change")
    return tables.close(untouched.unionByName(known).unionByName(new.select("tenant", F.col("number").alias("id"), *names, F.lit("created").alias("change"))))


def element_bounds(text: str) -> list[tuple[int, int]] | None:
    """Where the elements of a JSON list begin and end in its text; None for other texts."""
    decode, at, out = json.JSONDecoder().raw_decode, 0, []
    space = re.compile(r"[ \t\n\r]*")
    at = space.match(text, 0).end()
    if text[at : at + 1] != "[":
        return None
    at = space.match(text, at + 1).end()
    closed = text[at : at + 1] == "]"
    at = space.match(text, at + closed).end()
    while not closed:
        try:
            end = decode(text, at)[1]
        except ValueError:
            return None
        out.append((at, end))
        at = space.match(text, end).end()
        closed = text[at : at + 1] == "]"
        if not closed and text[at : at + 1] != ",":
            return None
        at = space.match(text, at + 1).end()
    return out if at == len(text) else None


#: Elements of a list that leave its task at a time.
LIST_ROWS = 2_000


def list_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, row_no, j (text) of each element of the JSON lists in a column; a text that is no list, or is broken anywhere, has none.

    A list is cut where its elements end and leaves its task a few rows at a time, dealt over all tasks, so only its
    text is ever in one place, and what follows is as parallel as for a table.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                bounds = element_bounds(text) if text else None
                for low in range(0, len(bounds or ()), LIST_ROWS):
                    part = bounds[low : low + LIST_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(part), batch.column(0).type), pa.array(range(low, low + len(part)), pa.int64()), pa.array([text[a:b] for a, b in part], pa.string())], [key, "row_no", "j"])

    rows = df.select(key, F.col(column).cast("string")).mapInArrow(cut, T.StructType([df.schema[key], T.StructField("row_no", T.LongType()), T.StructField("j", T.StringType())]))
    return rows.repartition(F.xxhash64(key, "row_no"))


@guarded
def commit_job(jobs: DataFrame, job_id: int, user: int, products: DataFrame, schema: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(products, jobs) after a staged job of the user is committed: its valid rows are applied one after another, invalid ones skipped, its status is COMPLETED.

    result_summary holds the staged rows as a JSON list; a row sets the fields that its
    JSON has.  A job of another user, or none, changes nothing.
    """
    mine = (F.col("id") == job_id) & (F.col("user_id") == user)
    staged = list_rows(jobs.where(mine).select(F.col("user_id").cast("bigint").alias("tenant"), "result_summary"), "tenant", "result_summary")
    rows = staged.select("tenant", "row_no", F.from_json("j", schema).alias("r"), F.json_object_keys("j").alias("given")).where("r is not null").select("tenant", "row_no", "given", "r.*")
    named = {c: F.col(c) for c in rows.columns if c in {*LENGTHS, *NOT_NEGATIVE}}
    good = rows.where(F.size(failed_rules(named)) == 0) if named else rows
    return get_or_create(products, good, fields), jobs.withColumn("status", F.when(mine, "COMPLETED").otherwise(F.col("status")))


def coerced_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with json_error: the first of the columns whose text isn't a JSON object; null if all are, or are null."""
    bad = [F.when(F.col(c).isNotNull() & (F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit("")).startswith("OBJECT") == F.lit(False)), F.lit(c)) for c in columns]
    return df.withColumn("json_error", F.coalesce(*bad, F.lit(None).cast("string")))


def coerced_options(text: Column) -> Column:
    """(options, valid) of a text that must be a JSON list; null is valid."""
    parsed = F.try_parse_json(text)
    is_list = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    return F.struct(F.when(is_list, F.try_variant_get(parsed, "$", "array<string>")).alias("options"), (text.isNull() | is_list).alias("valid"))


def mapping_or_default(mapping: dict[str, str] | None, suppliers: DataFrame, supplier_id: int) -> dict[str, str] | None:
    """The mapping given, else the supplier's own; one row is read."""
    if mapping is not None:
        return mapping
    row = suppliers.where(F.col("id") == supplier_id).select("default_column_mapping").first()
    return row.default_column_mapping if row else None


def page_plan(files: DataFrame, start: int = 1) -> DataFrame:
    """(id, page) of the pages to process of each file, from start to its last page."""
    last = F.coalesce("total_pages", F.lit(0))
    return files.where(last >= start).select("id", F.explode(F.sequence(F.lit(start), last)).alias("page"))


def inserted(df: DataFrame, rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with new rows; columns that rows lack, and nulls in those with a default, take the default, others are null."""
    filled = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})
    return df.unionByName(filled.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in filled.columns if c in df.columns)), allowMissingColumns=True)


#: Limits of users without a plan.
DEFAULT_LIMITS = {"limite_produtos": 50, "limite_enriquecimento_web": 10, "limite_geracao_ia": 20}


def with_quotas(users: DataFrame, plans: DataFrame) -> DataFrame:
    """users with copies of their plan's limits, or the default ones if they have no plan or one that isn't there; plans: plan and the limits."""
    rows = users.drop(*DEFAULT_LIMITS).join(plans.select("plan", *DEFAULT_LIMITS, F.lit(True).alias("_found")), "plan", "left")
    limits = {c: F.when(F.col("_found"), F.col(c)).otherwise(F.lit(v)).cast("int") for c, v in DEFAULT_LIMITS.items()}
    return rows.withColumns(limits).drop("_found")


def social_logins(users: DataFrame, logins: DataFrame, plan: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(users, refused) after logins (email, name, provider, provider_user_id), one for each email.

    Known active users keep what they have and get what is empty; inactive ones are
    refused; unknown emails become users with their local part as name if none is given.
    """
    filled = lambda c, new: F.coalesce(F.nullif(F.col(c), F.lit("")), F.when(F.col("is_active"), F.col(new)), F.col(c)).alias(c)
    side = logins.select("email", F.nullif("name", F.lit("")).alias("_name"), F.col("provider").alias("_provider"), F.col("provider_user_id").alias("_id"))
    known = users.join(side, "email", "left")
    known = known.select(*({"name": filled("name", "_name"), "provider": filled("provider", "_provider"), "provider_user_id": filled("provider_user_id", "_id")}.get(c, F.col(c)) for c in users.columns))
    new = logins.join(users, "email", "left_anti").select("email", F.coalesce(F.nullif("name", F.lit("")), F.element_at(F.split("email", "@"), 1)).alias("name"), "provider", "provider_user_id", F.lit(True).alias("is_active"), F.lit(plan).alias("plan"))
    refused = logins.join(users.where("not is_active").select("email"), "email", "left_semi")
    return known.unionByName(new.select(*(c for c in new.columns if c in users.columns)), allowMissingColumns=True), refused
