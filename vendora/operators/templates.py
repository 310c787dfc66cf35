"""Attributes of products checked against the templates of their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.functions.columns import split_list, strip

#: Kinds of attributes.
FIELD_TYPES = ("text", "number", "boolean", "select", "multiselect", "date", "textarea")
#: Texts of booleans, in lower case.
BOOLEANS = ("true", "false", "1", "0", "sim", "não", "nao")


def _fault(value: Column, kind: Column, options: Column) -> Column:
    """What is wrong with a value that is there, for its kind."""
    chosen = split_list(value)
    outside = F.exists(chosen, lambda x: ~F.array_contains(options, x))
    return (
        F.when((kind == "number") & F.try_to_number(F.replace(value, F.lit(","), F.lit(".")), F.lit("S999999999999999D999999")).isNull(), "not a number")
        .when((kind == "boolean") & ~F.lower(value).isin(*BOOLEANS), "not a boolean")
        .when((kind == "date") & F.to_date(F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).isNull(), "not a date")
        .when((kind == "select") & options.isNotNull() & ~F.array_contains(options, value), "not an option")
        .when((kind == "multiselect") & options.isNotNull() & outside, "not an option")
    )


def checked_attributes(products: DataFrame, templates: DataFrame) -> DataFrame:
    """id, attribute_key, value, reason: a row for each attribute of a product, and for each template of its type that it lacks.

    products: id, type_id, attributes (map of texts); templates: type_id, attribute_key, field_type,
    options (array, null for any), is_required, default_value.  A blank value is none, and takes the
    default if there is one; reason is null for good rows, and else ``missing`` (required, without value or
    default), ``unknown`` (no template of the product's type), or what its kind says.
    A product without a type has only unknown attributes.  Both sides are joined on type and key, so the
    cost is that of the attributes, not of products times templates.
    """
    held = products.select("id", "type_id", F.explode("attributes").alias("attribute_key", "value"))
    wanted = templates.select("type_id", "attribute_key", "field_type", "options", F.coalesce("is_required", F.lit(False)).alias("is_required"), "default_value", F.lit(True).alias("_known"))
    value = F.nullif(strip("value"), F.lit(""))
    own = held.join(wanted, ["type_id", "attribute_key"], "left").select("id", "attribute_key", "field_type", "options", "is_required", "_known", F.coalesce(value, "default_value").alias("value"))
    absent = products.select("id", "type_id", F.map_keys("attributes").alias("_keys")).join(wanted, "type_id").where(~F.coalesce(F.array_contains("_keys", F.col("attribute_key")), F.lit(False)))
    absent = absent.select("id", "attribute_key", "field_type", "options", "is_required", "_known", F.col("default_value").alias("value"))
    reason = F.when(F.col("_known").isNull(), "unknown").when(F.col("value").isNull(), F.when(F.col("is_required"), "missing")).otherwise(_fault(F.col("value"), F.col("field_type"), F.col("options")))
    return own.unionByName(absent).select("id", "attribute_key", "value", reason.alias("reason"))


def rejected(checked: DataFrame) -> DataFrame:
    """id, reasons: the faults of each product that has any, ``key: reason``, in order."""
    bad = checked.where(F.col("reason").isNotNull()).select("id", F.concat("attribute_key", F.lit(": "), "reason").alias("r"))
    return bad.groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("reasons"))
