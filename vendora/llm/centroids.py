"""Centroid clustering by Lloyd's rounds with Elkan's bounds.

A row keeps an upper bound of the distance to its centroid and a lower bound of the distance
to each one; after a round, bounds move by the distance that centroids moved.  A distance is
computed only where the bounds and the distances between centroids leave a doubt: a centroid is
skipped if its lower bound, or half its distance from the row's own centroid, *exceeds* the
upper bound, so a centroid at an equal distance is always looked at, and a tie goes to the
smaller number.  Bounds are floats, upper ones rounded up and lower ones down; distances that
decide are exact integers.

A round is one narrow pass over the rows, written with their new bounds to the shared folder.  With the rows
of a task come its changes of the cluster sums (what rows that moved bring and take away,
as integers), which Spark adds up; the driver holds centroids, sums and counts only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.store import lean
from vendora.plans.checkpoints import Tables, discard, guarded, materialize

K, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
#: Distances up to this are computed in 64 bits, larger ones with integers of any size.
_SAFE = 2.0**62
_STATE = "vec_id bigint, v array<bigint>, cluster int, upper float, lower array<float>, moved int, change array<bigint>, members bigint"


def integer_vectors(df: DataFrame, width: int = WIDTH, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, v array<bigint> with floor(scale * x) of each component.

    Kept are rows with an id and a vector of exactly width components, none null or not finite.
    A component beyond 2**53 after scaling raises.
    """
    x = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") == width))
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = lambda c: F.when(F.abs(c) < 2.0**53 / scale, F.floor(c * float(scale))).otherwise(F.raise_error(F.lit("a component exceeds 53 bits")).cast("bigint"))
    return rows.select("vec_id", F.transform("x", whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = "3") -> list[list[int]]:
    """The vectors of the k least sha256 of `seed:vec_id`, in that order; of rows with one id the least vector comes first."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def squared(rows: np.ndarray, centroid: list[int] | np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to a centroid."""
    centroid = np.asarray(centroid, dtype=np.int64)
    reach = float(np.abs(rows).max(initial=0)) + float(np.abs(centroid).max(initial=0))
    if reach * reach * rows.shape[1] < _SAFE:
        apart = rows - centroid
        return np.einsum("ij,ij->i", apart, apart)
    apart = rows.astype(object) - centroid.astype(object)
    return (apart * apart).sum(axis=1)


def over(x: np.ndarray) -> np.ndarray:
    """Floats not below the square roots of integers."""
    root = np.sqrt(np.nextafter(np.asarray(x).astype(np.float64), np.inf))
    return up(np.nextafter(root, np.inf))


def under(x: np.ndarray) -> np.ndarray:
    """Floats not above the square roots of integers."""
    root = np.sqrt(np.maximum(np.nextafter(np.asarray(x).astype(np.float64), -np.inf), 0))
    return down(np.maximum(np.nextafter(root, -np.inf), 0))


def up(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y).astype(np.float32)


def down(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y).astype(np.float32)


def assign(rows: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: list[list[int]]) -> int:
    """One round of Elkan's assignment, in place; returns how many distances of rows to centroids were computed."""
    k = len(centroids)
    points = np.array(centroids, dtype=np.int64)
    # half[i, j]: at most half the distance between two centroids; near[i]: the least of a row.
    half = np.array([under(squared(points, c)) for c in points], dtype=np.float32) / np.float32(2)
    half[np.arange(k), np.arange(k)] = np.inf
    near = half.min(axis=1)
    doubt = np.flatnonzero(~(upper < near[cluster]))
    if not len(doubt):
        return 0
    mine, own = rows[doubt], cluster[doubt]
    best = np.empty(len(doubt), dtype=object)
    for c in range(k):
        at = np.flatnonzero(own == c)
        best[at] = squared(mine[at], centroids[c])
    if max(best) < _SAFE:
        best = best.astype(np.int64)
    top, low = over(best), lower[doubt]
    low[np.arange(len(doubt)), own] = under(best)
    computed = len(doubt)
    for c in range(k):
        at = np.flatnonzero((own != c) & (top >= low[:, c]) & (top >= half[own, c]))
        if not len(at):
            continue
        far = squared(mine[at], centroids[c])
        computed += len(at)
        low[at, c] = under(far)
        better = (far < best[at]) | ((far == best[at]) & (c < own[at]))
        to = at[better.astype(bool)]
        best[to], own[to] = far[better.astype(bool)], c
        top[to] = over(best[to])
    cluster[doubt], upper[doubt], lower[doubt] = own, top, low
    return computed


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _round(centroids: list[list[int]], drift: np.ndarray | None):
    """For mapInArrow: rows with new clusters and bounds, and for each cluster what this batch changes in its sums."""
    k = len(centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = _vectors(batch.column(1))
            if drift is None:
                old, cluster = np.full(n, -1, np.int32), np.zeros(n, np.int32)
                upper, lower = np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
            else:
                old = batch.column(2).to_numpy().copy()
                cluster = old.copy()
                upper = up(np.nextafter(batch.column(3).to_numpy().astype(np.float64) + drift[cluster], np.inf))
                lower = down(np.maximum(np.nextafter(_vectors(batch.column(4)).astype(np.float64) - drift, -np.inf), 0))
            assign(rows, cluster, upper, lower, centroids)
            moved = np.flatnonzero(old != cluster)
            change, members, which = [], [], []
            # A batch's sums are exact in 64 bits: components take 53 bits, and parts of 512 rows are added.
            for c in range(k):
                come, go = moved[cluster[moved] == c], moved[old[moved] == c]
                for sign, part in ((1, come), (-1, go)):
                    for a in range(0, len(part), 512):
                        which.append(c)
                        change.append((sign * rows[part[a : a + 512]].sum(axis=0)).tolist())
                        members.append(sign * len(part[a : a + 512]))
            m = len(which)
            floats = pa.array(lower.reshape(-1))
            empty = lambda kind, size: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column(0), empty(pa.int64(), m)]),
                pa.concat_arrays([batch.column(1).cast(pa.list_(pa.int64())), empty(pa.list_(pa.int64()), m)]),
                pa.concat_arrays([pa.array(cluster), empty(pa.int32(), m)]),
                pa.concat_arrays([pa.array(upper), empty(pa.float32(), m)]),
                pa.concat_arrays([pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), floats), empty(pa.list_(pa.float32()), m)]),
                pa.concat_arrays([empty(pa.int32(), n), pa.array(which, pa.int32())]),
                pa.concat_arrays([empty(pa.list_(pa.int64()), n), pa.array(change, pa.list_(pa.int64()))]),
                pa.concat_arrays([empty(pa.int64(), n), pa.array(members, pa.int64())]),
            ], ["vec_id", "v", "cluster", "upper", "lower", "moved", "change", "members"])

    return run


def _changes(written: DataFrame) -> list:
    """(cluster, place, change of the sum), and place -1 for the change of the count: at most k x (width + 1) rows."""
    rows = written.where("moved is not null")
    each = rows.select("moved", F.posexplode(F.concat(F.col("change"), F.array("members"))).alias("place", "x"))
    return each.groupBy("moved", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()


@guarded
def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector.

    vectors: vec_id, v as integer_vectors gives them, all of one length.  Centroids start as the vectors of
    first_centroids; each round assigns every row to the nearest (ties: smaller number) and makes
    each non-empty centroid the floor of its rows' mean; then rows are assigned once more.  When no
    centroid moved, further rounds can't change anything and are left out.  With fewer than k rows
    there are as many centroids as rows; rows that repeat are rows of their own; an empty table gives no rows.
    Raises if a squared distance exceeds 64 bits.
    """
    spark, tables = vectors.sparkSession, Tables()
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    rows = tables.write(vectors.select("vec_id", F.col("v").cast("array<bigint>").alias("v")))
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        tables.drop()
        return spark.createDataFrame([], schema)
    k, width = len(centroids), len(centroids[0])
    sums, counts = [[0] * width for _ in range(k)], [0] * k
    state, drift = rows, None
    for number in range(rounds + 1):
        after = _pass(state, centroids, drift)
        if state is not rows:
            discard(state)
        state = after
        if number == rounds:
            break
        for r in _changes(state):
            if r.place == width:
                counts[r.moved] += int(r.x)
            else:
                sums[r.moved][r.place] += int(r.x)
        moved = [[x // counts[c] for x in sums[c]] if counts[c] else centroids[c] for c in range(k)]
        if moved == centroids:
            break
        drift = np.array([float(over(squared(np.array([a], np.int64), b))[0]) for a, b in zip(centroids, moved, strict=True)])
        centroids = moved
    tables.own(state)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cluster = _vectors(batch.column(1)), batch.column(2).to_numpy()
            far = np.empty(len(cluster), dtype=object)
            for c in np.unique(cluster):
                far[cluster == c] = squared(rows[cluster == c], centroids[c])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([int(x) for x in far], pa.int64())], ["vec_id", "cluster", "distance"])

    final = tables.write(state.where("cluster is not null").select("vec_id", "v", "cluster").mapInArrow(lean(measure, "centroids"), "vec_id bigint, cluster int, distance bigint"))
    inertia = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    each = of([F.lit(inertia.get(c, 0)).cast("bigint") for c in range(k)])
    digest = of([F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids])
    return tables.close(final.select("vec_id", "cluster", "distance", each.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), digest.alias("centroid_sha256")))


def _pass(state: DataFrame, centroids: list[list[int]], drift: np.ndarray | None) -> DataFrame:
    columns = ["vec_id", "v"] if drift is None else ["vec_id", "v", "cluster", "upper", "lower"]
    rows = state if drift is None else state.where("cluster is not null")
    return materialize(rows.select(*columns).mapInArrow(lean(_round(centroids, drift), "centroids"), _STATE))
