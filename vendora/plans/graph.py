"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.plans.checkpoints import discard, guarded, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the least of u and its neighbours; partial minima are formed before the shuffle."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


@guarded
def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable by links (a, b), for every linked id.

    Ids are of any ordered type; others than longs are numbered in their order first, so
    that rounds work on longs.  Self links and nulls are ignored.  Each round writes its
    edges, at most one for each vertex and former edge, to the shared folder; rounds grow
    with the logarithm of the longest path.  The result is such a table too.
    """
    if links.schema["a"].dataType.typeName() == "long":
        return _components(links)
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).where("id is not null").distinct()
    # The number of a sorted range comes before the place in it, so numbers are in the order of ids.
    named = materialize(ids.repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("n")))
    side = lambda c: named.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"))
    found = _components(links.join(side("a"), "a").join(side("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    least = named.select(F.col("n").alias("component"), F.col("id").alias("_least"))
    out = materialize(found.withColumnRenamed("id", "n").join(named, "n").join(least, "component").select("id", F.col("_least").alias("component")))
    discard(found)
    discard(named)
    return out


def _components(links: DataFrame) -> DataFrame:
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs)
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # In large every u exceeds its v, so a vertex's rows are its smaller neighbours.
        small = _least(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        done = materialize(small)
        state = done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(pairs)
        pairs = done
        if state == seen:
            break
        seen = state
    found = materialize(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct()))
    discard(pairs)
    return found
