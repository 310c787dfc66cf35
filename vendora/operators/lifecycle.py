"""Deletes, references, ordering of siblings and keep-latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Of rows with equal keys the one with the greatest id; rows with a null key all stay.

    A grouped maximum with partial aggregation: no group is sorted or held in one task.
    """
    null = F.lit(False)
    for c in same:
        null = null | F.col(c).isNull()
    rows = df.where(~null)
    last = rows.groupBy(*same).agg(F.max_by(F.struct(*df.columns), key).alias("r")).select("r.*")
    return last.unionByName(df.where(null))


def without_children(children: DataFrame, parent_key: str, deleted: DataFrame) -> DataFrame:
    """Children whose parent isn't deleted (cascade); deleted: ids."""
    return children.join(deleted.select(F.col("id").alias(parent_key)), parent_key, "left_anti").select(*children.columns)


def parent_set_null(children: DataFrame, parent_key: str, deleted: DataFrame) -> DataFrame:
    gone = deleted.select(F.col("id").alias("_gone")).distinct()
    joined = children.join(gone, F.col(parent_key) == F.col("_gone"), "left")
    return joined.select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == parent_key else F.col(c) for c in children.columns))


def classify_batch(ids: DataFrame, rows: DataFrame, key: str, owner: str, user: int, admin: bool = False) -> DataFrame:
    """id, outcome of a batch delete: deleted, not_found or not_authorized."""
    found = ids.join(rows.select(F.col(key).alias("id"), F.col(owner).alias("_owner"), F.lit(True).alias("_found")), "id", "left")
    return found.select("id", F.when(F.col("_found").isNull(), "not_found").when(F.lit(admin) | F.coalesce(F.col("_owner") == user, F.lit(False)), "deleted").otherwise("not_authorized").alias("outcome"))


def in_use(parents: DataFrame, key: str, children: DataFrame, child_key: str) -> DataFrame:
    """parents with in_use: whether a child refers to them (which blocks a delete)."""
    used = children.select(F.col(child_key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("in_use", F.lit(True))
    return parents.join(used, key, "left").withColumn("in_use", F.coalesce("in_use", F.lit(False)))


def orphans(children: DataFrame, child_key: str, parents: DataFrame, key: str) -> DataFrame:
    """Children with a reference to no parent; a null reference is none."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(key).alias(child_key)), child_key, "left_anti").select(*children.columns)


def renumbered(df: DataFrame, parent: str, order: list, name: str = "position") -> DataFrame:
    """Siblings numbered from 0 without gaps."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1).cast("int"))


def moved(df: DataFrame, parent: str, key: str, chosen: int, up: bool, name: str = "position") -> DataFrame:
    """df after the row with the chosen key swaps places with the sibling before (up) or after it, renumbered from 0; at an edge nothing moves.

    Siblings stand in order of their number and then of the key, nulls last; if one of them
    has none, they are numbered by their places first.  Siblings with equal numbers stand by
    key before and after.
    """
    siblings = Window.partitionBy(parent)
    placed = siblings.orderBy(F.asc_nulls_last(name), F.asc(key))
    rows = df.withColumn("_at", F.row_number().over(placed) - 1).withColumn("_of", F.when(F.max(F.col(name).isNull()).over(siblings), F.col("_at")).otherwise(F.col(name)))
    mine = F.max(F.when(F.col(key) == chosen, F.col("_at"))).over(siblings)
    last = F.max("_at").over(siblings)
    rows = rows.withColumn("_me", mine).withColumn("_to", F.when(F.lit(up), F.when(mine > 0, mine - 1)).otherwise(F.when(mine < last, mine + 1)))
    number_at = lambda place: F.max(F.when(F.col("_at") == place, F.col("_of"))).over(siblings)
    rows = rows.withColumn("_mine", number_at(F.col("_me"))).withColumn("_theirs", number_at(F.col("_to")))
    swapped = F.when(F.col("_to").isNull(), F.col("_of")).when(F.col("_at") == F.col("_me"), F.col("_theirs")).when(F.col("_at") == F.col("_to"), F.col("_mine")).otherwise(F.col("_of"))
    again = siblings.orderBy("_new", key)
    return rows.withColumn("_new", swapped).withColumn(name, (F.row_number().over(again) - 1).cast("int")).select(*df.columns)


def domain_first(urls: DataFrame, group: str, position: str, url: str, domain: str) -> DataFrame:
    """URLs of a group numbered: those of the supplier's domain come first, the last found leading; the others keep their order."""
    match = F.coalesce(F.contains(F.lower(F.col(url)), F.col(domain)), F.lit(False))
    w = Window.partitionBy(group).orderBy(match.desc(), F.when(match, -F.col(position)).otherwise(F.col(position)))
    return urls.withColumn("place", F.row_number().over(w).cast("int"))


def nested(parents: DataFrame, key: str, children: DataFrame, child_key: str, fields: list[str], order: str, name: str) -> DataFrame:
    """parents with an ordered array of their children's fields, empty without children."""
    lists = children.groupBy(F.col(child_key).alias(key)).agg(F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))
    joined = parents.join(lists, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def product_details(products: DataFrame, suppliers: DataFrame, types: DataFrame, templates: DataFrame) -> DataFrame:
    """products with supplier_name, type_name and the type's attribute templates in order, null or empty without them.

    products: supplier_id, type_id; suppliers: id, name; types: id, name; templates: type_id, display_order, attribute_key.
    """
    named = products.join(suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name")), "supplier_id", "left")
    kinds = nested(types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name")), "type_id", templates, "type_id", ["attribute_key"], "display_order", "templates")
    joined = named.join(kinds, "type_id", "left")
    return joined.withColumn("templates", F.coalesce("templates", F.array().cast(joined.schema["templates"].dataType)))


def progress(files: DataFrame) -> DataFrame:
    """Import files with pages left and done: a file is done only when it is imported."""
    return files.withColumn("left", F.greatest(F.coalesce("total_pages", F.lit(0)) - F.col("pages_processed"), F.lit(0))).withColumn("done", F.col("status") == "IMPORTED")


def result_summary(changes: DataFrame, errors: DataFrame) -> DataFrame:
    """One row with counts of created, updated and failed rows."""
    a = changes.agg(F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "updated").alias("updated"))
    return a.join(F.broadcast(errors.agg(F.count("*").alias("errors"))))


def with_log_entry(df: DataFrame, log: str, actor: str, action: str, at: str) -> DataFrame:
    """Appends (timestamp, actor, action) to an array of such entries; a null log starts one."""
    entry = F.array(F.struct(F.lit(at).alias("timestamp"), F.lit(actor).alias("actor"), F.lit(action).alias("action")))
    kind = "array<struct<timestamp:string,actor:string,action:string>>"
    return df.withColumn(log, F.concat(F.coalesce(F.col(log).cast(kind), F.array().cast(kind)), entry))
