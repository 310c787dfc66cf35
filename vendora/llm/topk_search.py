"""Exact top-k search by distributed histogram selection.

Vectors are cut into blocks: a cell holds one group of queries and one group of
candidates, and each cell scores all its pairs by matrix products.  Round by round,
every cell counts its scores in BINS bins of each query's present range, in one histogram
for each of its queries; the counts are summed over cells, and each query's range
shrinks to the bin that holds its k-th largest score, until the scores from that bin
upwards are few or the bin is one value wide.  A last pass returns scores at or above the
range's lower end (from each cell at most its k best, which loses nothing), and ties go to
the smaller id.

Groups are dealt by a hash of the id, so no source or repeated vector makes a cell
large.  Cells are as large as memory allows (GROUP_ROWS queries by CELL_ROWS candidates),
and there are at least as many as shuffle partitions.  So histograms grow with queries
times cells, not with pairs, and a row is sent once for each group of the other side, in
the narrowest integers that hold every component; nothing is broadcast or collected but the
counts that set the number of groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.plans.checkpoints import Tables, guarded

BINS = 256
GROUP_ROWS = 16_384
CELL_ROWS = 65_536
#: Queries and candidates of a cell that are scored at a time.
_QUERIES, _ROWS = 256, 8192
#: A query needs no further round when so many scores, besides ties, are left.
ENOUGH = 64
#: Scores are 64-bit integers, and so are the distances between them: a query whose bound is larger raises.
MOST_SCORE = 2.0**62


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, v array<bigint> with floor(256 * x) of each component.

    Left out are rows whose id or vector is null, and vectors with a component that is
    null or not finite.  An empty vector stays.  A component beyond 64 bits after
    scaling raises.
    """
    x = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = lambda c: F.when(F.abs(c) < 2.0**55, F.floor(c * 256.0)).otherwise(F.raise_error(F.lit("a component exceeds 64 bits")).cast("bigint"))
    return rows.select("vec_id", F.transform("x", whole).alias("v"))


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _scores(query_side: pa.Table, row_side: pa.Table):
    """For each slice of a cell's queries, (slice, scores of a slice of rows, ids of the rows, which aren't the query's own) for all slices of rows."""
    if not query_side.num_rows or not row_side.num_rows:
        return
    queries, rows = _matrix(query_side), _matrix(row_side)
    own, ids = query_side.column("vec_id").to_numpy(), row_side.column("vec_id").to_numpy()

    def over(part: slice):
        for low in range(0, len(ids), _ROWS):
            some = slice(low, low + _ROWS)
            yield _products(queries[part].astype(np.int64), rows[some].astype(np.int64)), ids[some], ids[some][None, :] != own[part][:, None]

    for at in range(0, len(own), _QUERIES):
        part = slice(at, at + _QUERIES)
        yield part, over(part)


def _best_of(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score and then the smaller id."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], scores[keep]


def _width(vectors: DataFrame) -> tuple[int, str]:
    """Number of vectors, and the narrowest integer type that holds all their components."""
    n, most = vectors.agg(F.count("*"), F.max(F.greatest(F.array_max("v"), -F.array_min("v") - 1))).first()
    return n, next(name for name, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if (most or 0) < 1 << bits)


@guarded
def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Both inputs are vec_id, v as integer_vectors gives them.  A row with the query's own
    id is no candidate; a query with fewer candidates returns all; vectors of another
    length are no candidates.  If a query id repeats, its least vector asks; if a candidate
    id repeats, each of its rows counts.  Raises where a score could exceed MOST_SCORE.
    """
    tables = Tables()
    n_rows, kind = _width(vectors)
    vectors = tables.write(vectors.select("vec_id", F.col("v").cast(f"array<{kind}>").alias("v"), F.size("v").alias("d")))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    n_asked, other = _width(asked)
    asked = tables.write(asked.withColumn("v", F.col("v").cast(f"array<{other}>")))
    n_groups = max(1, -(-n_asked // GROUP_ROWS))
    least = -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_groups)
    n_cells = max(1, -(-n_rows // CELL_ROWS), min(least, -(-n_rows // _QUERIES)))
    group = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("vec_id", "v", "d", group(n_cells).alias("cell"), each(n_groups).alias("grp"))
    # Bounds of all scores of a query: |q| |v| by Cauchy-Schwarz, rounded up, for the longest v of its length and another id.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    norms = vectors.groupBy("d", "vec_id").agg(F.max(norm).alias("most"))
    top = norms.groupBy("d").agg(F.max(F.struct("most", "vec_id")).alias("top"))
    second = norms.join(top, "d").where(F.col("vec_id") != F.col("top.vec_id")).groupBy("d").agg(F.max("most").alias("second"))
    longest = top.join(second, "d", "left")
    most = F.when(F.col("vec_id") == F.col("top.vec_id"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("top.most"))
    bound = norm * most * 1.000001
    reach = F.when(bound < MOST_SCORE, (F.ceil(bound) + 1).cast("bigint")).otherwise(F.raise_error(F.lit("a score could exceed 64 bits")).cast("bigint"))
    state = tables.write(asked.join(longest, "d").select("vec_id", "v", "d", group(n_groups).alias("grp"), (-reach).alias("lo"), (reach + 1).alias("hi"), (F.floor(reach / (BINS // 2)) + 1).cast("bigint").alias("width"), F.lit(0).cast("bigint").alias("above"), F.lit(False).alias("done")))

    def count(key, query_side: pa.Table, row_side: pa.Table) -> pa.Table:
        ids, bins, counts = [], [], []
        lo, hi, width = (query_side.column(c).to_numpy()[:, None] for c in ("lo", "hi", "width"))
        for part, slices in _scores(query_side, row_side):
            found = np.zeros(len(lo[part]) * BINS, np.int64)
            for scores, _, valid in slices:
                place = (scores - lo[part]) // width[part]
                own = np.arange(scores.shape[0])[:, None] * BINS + np.clip(place, 0, BINS - 1)
                # Scores from hi on are counted in above already; the last bin may reach beyond hi.
                found += np.bincount(own[valid & (place >= 0) & (scores < hi[part])], minlength=len(found))
            at = np.flatnonzero(found)
            ids.append(query_side.column("vec_id").to_numpy()[part][at // BINS])
            bins.append(at % BINS)
            counts.append(found[at])
        join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
        return pa.table({"vec_id": join(ids), "bin": join(bins), "n": join(counts)})

    def best(key, query_side: pa.Table, row_side: pa.Table) -> pa.Table:
        out = [[], [], []]
        lo = query_side.column("lo").to_numpy()[:, None]
        for part, slices in _scores(query_side, row_side):
            held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
            for scores, ids, valid in slices:
                at, to = np.nonzero(valid & (scores >= lo[part]))
                held = _best_of(*(np.concatenate(x) for x in zip(held, (at, ids[to], scores[at, to]), strict=True)), k)
            out[0].append(query_side.column("vec_id").to_numpy()[part][held[0]])
            out[1].append(held[1])
            out[2].append(held[2])
        join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
        return pa.table({"query_id": join(out[0]), "vec_id": join(out[1]), "score": join(out[2])})

    def over_cells(questions: DataFrame, fn, schema: str) -> DataFrame:
        spread = questions.select("vec_id", "v", "d", "grp", "lo", "hi", "width", each(n_cells).alias("cell"))
        return spread.groupBy("grp", "cell", "d").cogroup(rows.groupBy("grp", "cell", "d")).applyInArrow(fn, schema)

    while True:
        open_ = state.where(~F.col("done"))
        counts = over_cells(open_, count, "vec_id bigint, bin bigint, n bigint").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        counts = counts.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("bin")).alias("b"), "n"))).alias("h"))
        # Walk down from the top bin: the bin where the count reaches k, and the count above it.
        walk = F.aggregate("h", F.struct(F.col("above").alias("above"), F.lit(-1).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("n")), lambda s, x: F.when(s["bin"] >= 0, s).when(s["above"] + x["n"] >= k, F.struct(s["above"].alias("above"), (-x["b"]).alias("bin"), x["n"].alias("n"))).otherwise(F.struct((s["above"] + x["n"]).alias("above"), s["bin"].alias("bin"), s["n"].alias("n"))))
        found = open_.join(counts, "vec_id", "left").withColumn("w", F.when(F.col("h").isNotNull(), walk))
        few = F.coalesce(F.col("w.bin") < 0, F.lit(True))  # fewer than k candidates: all scores count
        nxt = found.select(
            "vec_id", "v", "d", "grp",
            F.when(few, F.col("lo")).otherwise(F.col("lo") + F.col("w.bin") * F.col("width")).alias("lo"),
            F.when(few, F.col("hi")).otherwise(F.least("hi", F.col("lo") + (F.col("w.bin") + 1) * F.col("width"))).alias("hi"),
            F.when(few | (F.col("width") == 1), F.col("width")).otherwise(F.expr(f"(width + {BINS - 1}) div {BINS}")).cast("bigint").alias("width"),
            F.when(few, F.col("above")).otherwise(F.col("w.above")).alias("above"),
            (few | (F.col("width") == 1) | (F.col("w.above") + F.col("w.n") <= ENOUGH)).alias("done"),
        )
        state = tables.write(state.where("done").unionByName(nxt))
        if state.where(~F.col("done")).isEmpty():
            break
    found = over_cells(state, best, "query_id bigint, vec_id bigint, score bigint")
    listed = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("t"))
    return tables.close(listed.select("query_id", F.posexplode("t").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")))
