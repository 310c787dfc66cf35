"""Product tables at rest: inserts, updates, upserts and deletes that rewrite only what they touch.

A table is a folder of Parquet partitions by a hash of its keys.  A change is first written in full, as
the new content of the partitions that it touches, beside them (``_staged-``); then a mark names it, and from
there on it holds: the partitions are overwritten from what is staged, and the mark goes.  A writer
that ends before the mark leaves the old state, one that ends after it a change that the
next reader or writer completes, as overwriting twice is no different.  One writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_MARK, _TABLE = "_pending", "_table"


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _sub(spark: SparkSession, path: str, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")


def _placed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    number = int(name.rpartition("_")[2])
    return rows.withColumn(name, F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(number)).cast("int"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _put(spark: SparkSession, path: str, name: str, value: dict) -> None:
    """A small file that is there as a whole or not at all."""
    system, _ = _system(spark, path)
    new = _sub(spark, path, f"{name}.new")
    stream = system.create(new, True)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    system.rename(new, _sub(spark, path, name))


def _get(spark: SparkSession, path: str, name: str) -> dict | None:
    system, _ = _system(spark, path)
    place = _sub(spark, path, name)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table of rows, in partitions by a hash of its keys; a path that is there already is an error."""
    name = f"bucket_of_{buckets}"
    placed = _placed(rows, keys, name)
    placed.repartition(name).write.partitionBy(name).parquet(path)
    _put(rows.sparkSession, path, _TABLE, {"bucket": name, "schema": _ddl(placed)})


def _partitions(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """All rows with the column of their partition, and its name; the table may be empty."""
    table = _get(spark, path, _TABLE)
    if table is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.schema(table["schema"]).parquet(path), table["bucket"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table, after a change that was left unfinished is completed."""
    complete(spark, path)
    rows, name = _partitions(spark, path)
    return rows.drop(name)


def complete(spark: SparkSession, path: str) -> bool:
    """Carry out a change that is marked; whether there was one."""
    change = _get(spark, path, _MARK)
    if change is None:
        return False
    system, _ = _system(spark, path)
    name, staged = change["bucket"], f"{path}/{change['staged']}"
    rows = spark.read.schema(change["schema"]).parquet(staged)
    rows.repartition(name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    for bucket in change["emptied"]:
        system.delete(_sub(spark, path, f"{name}={bucket}"), True)
    system.delete(_sub(spark, path, _MARK), False)
    system.delete(_sub(spark, path, change["staged"]), True)
    return True


def _put_mark(spark: SparkSession, path: str, change: dict) -> None:
    """From here on the change holds."""
    _put(spark, path, _MARK, change)


def _clear(spark: SparkSession, path: str) -> None:
    """Delete what writers left that ended before their mark."""
    system, place = _system(spark, path)
    for x in system.listStatus(place):
        if x.getPath().getName().startswith("_staged-"):
            system.delete(x.getPath(), True)


def apply_changes(spark: SparkSession, path: str, changed: DataFrame, keys: list[str], gone: Column | None = None) -> list[int]:
    """Put changed rows (all columns of the table, new ones or new versions of old ones) in place; of those where gone holds the old rows go.

    Returns the numbers of the partitions that were rewritten.  keys are those of create.
    Rows with the same keys as a changed one go, so keys should be unique in changed.
    """
    complete(spark, path)
    _clear(spark, path)
    table, name = _partitions(spark, path)
    columns = [c for c in table.columns if c != name]
    new = _placed(changed.select(*(F.col(c).cast(table.schema[c].dataType).alias(c) for c in columns), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("_gone")), keys, name)
    new = new.persist()
    try:
        touched = sorted(r[0] for r in new.select(name).distinct().collect())  # at most a row a partition
        if not touched:
            return []
        kept = table.where(F.col(name).isin(touched)).join(new.select(*keys, name), [*keys, name], "left_anti")
        staged = f"_staged-{uuid.uuid4().hex}"
        every = kept.select(*columns, name).unionByName(new.where("not _gone").select(*columns, name))
        every.repartition(name).write.partitionBy(name).parquet(f"{path}/{staged}")
    finally:
        new.unpersist()
    system, _ = _system(spark, path)
    filled = {int(m[1]) for x in system.listStatus(_sub(spark, path, staged)) if (m := re.search(rf"{name}=(\d+)$", x.getPath().getName()))}
    change = {"staged": staged, "bucket": name, "emptied": [b for b in touched if b not in filled], "schema": _ddl(every)}
    _put_mark(spark, path, change)
    complete(spark, path)
    return touched


def apply_upsert(spark: SparkSession, path: str, state: DataFrame, keys: list[str]) -> list[int]:
    """The changed rows of a state that ingest.upsert or get_or_create gives, put in place."""
    return apply_changes(spark, path, state.where("change <> 'unchanged'"), keys)


def delete_rows(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> list[int]:
    """Delete the rows with these keys; keys that aren't there change nothing but rewrite their partition."""
    table, name = _partitions(spark, path)
    others = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c not in keys and c != name]
    return apply_changes(spark, path, rows.select(*keys, *others).distinct(), keys, F.lit(True))
