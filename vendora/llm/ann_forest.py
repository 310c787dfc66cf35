"""Approximate nearest neighbours (cosine) by a forest of random-projection trees.

A tree cuts the unit vectors by hyperplanes: the normal of a node is the difference of two
of its vectors drawn at random, its threshold the median of their projections.  Trees are
fitted on the executors, one task a tree, on a bounded sample; every vector is then routed to
one leaf of each tree.  A query walks all trees with one priority queue, ordered by the least
margin on the way to a node, and visits the leaves that come out first; rows and questions
of a leaf meet in cells, where candidates are ranked by exact cosines of the original vectors.

How many leaves a query visits is calibrated: for a bounded sample of the questions the
exact neighbours are found by a scan, and the number is the least with which the queue
reaches RECALL of them.  So easy data cost little, and on data without structure, where
no index prunes much, the search still returns what it should.

Equal vectors are one class with its least ids (each class is indexed and asks once), so
copies, however many, add no work.  A question's own leaves come first, and from the others
cells return only candidates that are as near as the last one found there.  Leaves beyond CELL_ROWS rows are dealt over several cells,
and so are the questions of a leaf; nothing is dropped.

Bounds: a tree is fitted on about SAMPLE_PER_LEAF rows a leaf; all planes take at most
FOREST_BYTES (broadcast), beyond which leaves hold more rows; CALIBRATION questions.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.store import lean
from vendora.plans.checkpoints import Tables, guarded

TREES = 8
LEAF_ROWS = 256
SAMPLE_PER_LEAF = 16
FOREST_BYTES = 64 << 20
CALIBRATION = 128
RECALL = 0.96
CELL_ROWS, CELL_QUERIES = 65_536, 4_096
#: Matrix products may differ from exact scores by less than this.
_SLACK = 1e-9
_PART = 256


def clean_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, x: rows with an id and a vector that is not null, not zero, and without null or non-finite components.

    Components stay floats if they are, and are doubles otherwise; -0.0 becomes 0.0.
    """
    element = df.schema[vector_column].dataType.elementType.typeName()
    kind = "float" if element == "float" else "double"
    rows = df.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast(f"array<{kind}>").alias("x")).where("vec_id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0))
    return rows.select("vec_id", F.transform("x", lambda c: c + F.lit(0).cast(kind)).alias("x"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as doubles, each scaled by a power of two so that squares neither overflow nor vanish."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = _matrix(column)
    return x / _norms(x)[:, None]


def _least_ids(keep: int):
    """For mapInArrow: the distinct vectors of a batch, each with its keep least ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            raw, width = flat.tobytes(), flat.itemsize
            held: dict[bytes, list[int]] = {}
            first: list[int] = []
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                own = held.setdefault(raw[offsets[i] * width : offsets[i + 1] * width], [])
                if not own:
                    first.append(i)
                own.append(vec_id)
            ids = [sorted(set(v))[:keep] for v in held.values()]
            yield pa.RecordBatch.from_arrays([column.take(pa.array(first, pa.int64())), pa.array(ids, pa.list_(pa.int64()))], ["x", "ids"])

    return run


def classes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """x, ids: every distinct vector once, with its keep least ids; copies are folded before they are shuffled."""
    kind = vectors.schema["x"].dataType.simpleString()
    folded = vectors.select("vec_id", "x").mapInArrow(lean(_least_ids(keep), "ann_forest"), f"x {kind}, ids array<bigint>")
    return folded.groupBy("x").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


@dataclass
class Forest:
    """Complete trees of one depth; normals[t, i] and cuts[t, i] are those of node i (from 1, children 2 i and 2 i + 1) of tree t."""

    depth: int
    normals: np.ndarray
    cuts: np.ndarray

    def route(self, units: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each vector in a tree."""
        node = np.ones(len(units), np.int64)
        for _ in range(self.depth):
            side = (self.normals[tree, node] * units).sum(axis=1) > self.cuts[tree, node]
            node = 2 * node + side
        return node - (1 << self.depth)

    def walk(self, unit: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue.

        A node's priority is the least margin on its way, negative beyond a hyperplane; so
        the own leaf of each tree comes before any other.
        """
        leaves = 1 << self.depth
        heap = [(-np.inf, 0, tree, 1) for tree in range(len(self.normals))]
        while heap:
            priority, far, tree, node = heapq.heappop(heap)
            if node >= leaves:
                yield tree, node - leaves
                continue
            margin = float(self.normals[tree, node] @ unit) - float(self.cuts[tree, node])
            near = 2 * node + (margin > 0)
            heapq.heappush(heap, (max(priority, -abs(margin)), far, tree, near))
            heapq.heappush(heap, (max(priority, abs(margin)), 1, tree, near ^ 1))


def fit_tree(units: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normals and cuts of a complete tree over a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    size, width = 1 << depth, units.shape[1]
    normals, cuts = np.zeros((size, width), np.float32), np.zeros(size, np.float32)
    members: dict[int, np.ndarray] = {1: np.arange(len(units))}
    for node in range(1, size):
        own = members.pop(node)
        normal = np.zeros(width)
        if len(own) > 1:
            one, two = rng.choice(len(own), 2, replace=False)
            normal = units[own[one]] - units[own[two]]
        if not normal.any():
            normal = rng.normal(size=width)
        normals[node] = normal / np.sqrt(normal @ normal)
        at = units[own] @ normals[node].astype(np.float64)
        cuts[node] = np.median(at) if len(own) else 0.0
        beyond = at > cuts[node]
        members[2 * node], members[2 * node + 1] = own[~beyond], own[beyond]
    return normals, cuts


def fit_forest(classes: DataFrame, n: int, width: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> Forest:
    """A forest for n classes (cid, x) of one length; each tree is fitted by one task on its own sample."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf_rows)))))
    depth = min(depth, max(0, int(np.log2(FOREST_BYTES / (trees * (width + 1) * 4)))))
    share = min(1.0, SAMPLE_PER_LEAF * (1 << depth) / max(1, n))
    slots = 1 << 30
    drawn = F.pmod(F.xxhash64("cid", "tree"), F.lit(slots)) < int(share * slots)
    sample = classes.select("cid", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).where(drawn)

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        normals, cuts = fit_tree(_units(table.column("x")), depth, 1000 + key[0].as_py())
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "normals": pa.array([normals.tobytes()], pa.binary()), "cuts": pa.array([cuts.tobytes()], pa.binary())})

    normals = np.zeros((trees, 1 << depth, width), np.float32)
    cuts = np.zeros((trees, 1 << depth), np.float32)
    normals[:, :, 0] = 1.0  # of a tree whose sample is empty
    if depth:
        for row in sample.groupBy("tree").applyInArrow(fit, "tree int, normals binary, cuts binary").collect():
            normals[row.tree] = np.frombuffer(row.normals, np.float32).reshape(-1, width)
            cuts[row.tree] = np.frombuffer(row.cuts, np.float32)
    return Forest(depth, normals, cuts)


def _ranked(questions: np.ndarray, rows: np.ndarray, least: np.ndarray, keep: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, cosine) of the keep best rows of each question, by exact cosine and then the least id; none below what is known of a question's last one."""
    asked_norms, row_norms = _norms(questions), _norms(rows)
    rough = (questions / asked_norms[:, None]) @ (rows / row_norms[:, None]).T
    floor = np.partition(rough, -keep, axis=1)[:, -keep] if rows.shape[0] > keep else np.full(len(questions), -np.inf)
    floor = floor if known is None else np.maximum(floor, known)
    at, to = np.nonzero(rough >= floor[:, None] - _SLACK)
    exact = (questions[at] * rows[to]).sum(axis=1) / (asked_norms[at] * row_norms[to])
    if known is not None:
        good = exact >= known[at]
        at, to, exact = at[good], to[good], exact[good]
    order = np.lexsort((least[to], -exact, at))
    at, to, exact = at[order], to[order], exact[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < keep
    return at[first], to[first], exact[first]


def exact_neighbours(classes: DataFrame, units: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """q (row of units), x: the vectors of the k classes nearest to each of a bounded number of unit vectors, its own class left out; one scan."""
    kind = classes.schema["x"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            at, to, score = _ranked(units, rows, cids, k + 1)
            other = cids[to] != own[at]
            yield pa.RecordBatch.from_arrays([pa.array(at[other].astype(np.int32)), pa.array(score[other]), pa.array(cids[to[other]]), batch.column(1).take(pa.array(to[other]))], ["q", "score", "cid", "x"])

    found = classes.select("cid", "x").mapInArrow(lean(run, "ann_forest"), f"q int, score double, cid bigint, x {kind}")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "cid", "x"))), 1, k)
    return found.groupBy("q").agg(best.alias("b")).select("q", F.explode("b.x").alias("x"))


def calibrate(classes: DataFrame, asked: DataFrame, forest: Forest, shared, k: int, recall: float = RECALL) -> int:
    """The least number of leaves with which the queue meets recall of the exact neighbours of CALIBRATION questions."""
    trees = len(forest.normals)
    sample = asked.orderBy(F.xxhash64("cid"), "cid").limit(CALIBRATION).toArrow()
    if not sample.num_rows:
        return trees
    units, own = _units(sample.column("x")), sample.column("cid").to_numpy()

    def first_met(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        forest = shared.value
        wanted = _units(table.column("x"))
        homes = np.array([forest.route(wanted, t) for t in range(len(forest.normals))])
        met = np.zeros(len(wanted), np.int64)
        for number, (tree, leaf) in enumerate(forest.walk(units[key[0].as_py()]), 1):
            met[(met == 0) & (homes[tree] == leaf)] = number
            if met.all():
                break
        return pa.table({"met": pa.array(met)})

    met = sorted(r.met for r in exact_neighbours(classes, units, own, k).groupBy("q").applyInArrow(first_met, "met bigint").collect())
    return max(trees, met[min(len(met) - 1, int(np.ceil(recall * len(met))))] if met else 0)


@guarded
def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by cosine, ties to the smaller id.

    Both inputs are vec_id, x as clean_vectors gives them.  A row with the query's own id is no
    candidate, and neither are vectors of another length; a query with fewer candidates returns all.
    Rows that repeat an id and its vector count once; of a query id with several vectors the least
    one asks, and another vector under a candidate's id counts as a row.  An empty table gives no rows.
    """
    spark, tables = vectors.sparkSession, Tables()
    asked = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    # An id may have several vectors: so many rows of its own a query may meet.
    own_rows = vectors.select("vec_id", F.xxhash64("x").alias("h")).join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.count_distinct("h").alias("m")).agg(F.max("m")).first()[0]
    keep = k + (own_rows or 1)
    kind = vectors.schema["x"].dataType.simpleString()
    classes = tables.write(classes_of(vectors, keep).select(F.monotonically_increasing_id().alias("cid"), "x", "ids", F.size("x").alias("d")))
    asked = tables.write(asked.withColumn("d", F.size("x")).join(classes.select("x", "cid"), "x", "left"))
    # Questions that are no class themselves have a number of their own below zero.
    questions = tables.write(asked.groupBy("x", "d", "cid").agg(F.min("vec_id").alias("least")).select("x", "d", F.coalesce("cid", -1 - F.monotonically_increasing_id()).alias("cid")))
    found = None
    for row in classes.groupBy("d").count().join(questions.select("d").distinct(), "d").orderBy("d").collect():
        own, ask = classes.where(F.col("d") == row.d), questions.where(F.col("d") == row.d)
        part = _search(spark, tables, own, ask, row["count"], row.d, keep, k, trees, leaf_rows, recall, kind)
        found = part if found is None else found.unionByName(part)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if found is None:
        tables.drop()
        return spark.createDataFrame([], schema)
    pairs = F.flatten(F.transform("b", lambda b: F.transform(b["ids"], lambda i: F.struct((-b["score"]).alias("s"), i.alias("vec_id")))))
    listed = found.groupBy("cid", "x").agg(F.collect_set(F.struct("score", "ids")).alias("b")).select("cid", "x", F.slice(F.array_sort(pairs), 1, keep).alias("b"))
    each = asked.select("vec_id", "x").withColumnRenamed("vec_id", "query_id").join(listed.drop("cid"), "x")
    each = each.select("query_id", F.slice(F.filter("b", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("b"))
    return tables.close(each.select("query_id", F.posexplode("b").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score")))


def _search(spark, tables: Tables, classes: DataFrame, asked: DataFrame, n: int, width: int, keep: int, k: int, trees: int, leaf_rows: int, recall: float, kind: str) -> DataFrame:
    """cid, x of each question, and score, ids of classes found for it."""
    forest = fit_forest(classes, n, width, trees, leaf_rows)
    shared = spark.sparkContext.broadcast(forest)
    visits = calibrate(classes, asked, forest, shared, k, recall)

    def home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1)) if batch.num_rows else np.empty((0, width))
            for tree in range(trees):
                leaf = np.concatenate([shared.value.route(units[a : a + 4096], tree) for a in range(0, len(units), 4096)] or [np.empty(0, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), tree, np.int32)), pa.array(leaf.astype(np.int32)), *batch.columns], ["tree", "leaf", "cid", "x", "ids"])

    rows = tables.write(classes.select("cid", "x", "ids").mapInArrow(lean(home, "ann_forest"), f"tree int, leaf int, cid bigint, x {kind}, ids array<bigint>"))
    size = np.zeros((trees, 1 << forest.depth), np.int64)
    for row in rows.groupBy("tree", "leaf").count().collect():  # at most trees x leaves, bounded as the forest is
        size[row.tree, row.leaf] = row["count"]
    sizes = spark.sparkContext.broadcast(size)

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said(batch: pa.RecordBatch) -> pa.RecordBatch:
            places = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), pa.array(own, pa.bool_()), *(c.take(places) for c in batch.columns)], ["tree", "leaf", "own", "cid", "x"])

        for batch in batches:
            at, tree, leaf, own = [], [], [], []
            for i, unit in enumerate(_units(batch.column(1)) if batch.num_rows else ()):
                seen, number = np.zeros(trees, np.int64), 0
                for number, (t, j) in enumerate(shared.value.walk(unit), 1):
                    at.append(i)
                    tree.append(t)
                    leaf.append(j)
                    own.append(number <= trees)
                    seen[t] += sizes.value[t, j]
                    # Leaves of one tree are disjoint: with keep rows of a tree a question has what it returns.
                    if number >= visits and seen.max() >= keep:
                        break
                if len(at) >= 10_000:
                    yield said(batch)
                    at, tree, leaf, own = [], [], [], []
            yield said(batch)

    visited = tables.write(asked.select("cid", "x").mapInArrow(lean(visit, "ann_forest"), f"tree int, leaf int, own boolean, cid bigint, x {kind}"))
    # Cells of a leaf: its rows over r, the questions that visit it over s; most leaves have one cell.
    counts = visited.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / CELL_QUERIES).cast("int").alias("s"))
    counts = tables.write(counts.join(rows.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("r")), ["tree", "leaf"]))
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int").alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n)
    cells = ["tree", "leaf", "r", "s"]
    row_side = rows.join(counts, ["tree", "leaf"]).select("tree", "leaf", part("r"), every("s"), "cid", "x", "ids").groupBy(*cells)
    result = f"cid bigint, x {kind}, score double, ids array<bigint>"

    def rank(key: tuple[pa.Scalar, ...], ask: pa.Table, row: pa.Table) -> pa.Table:
        out = [[], [], []]
        if ask.num_rows and row.num_rows:
            questions, vectors = _matrix(ask.column("x")), _matrix(row.column("x"))
            least = np.array([v[0].as_py() for v in row.column("ids")])
            known = ask.column("known").to_numpy()
            for a in range(0, len(questions), _PART):
                at, to, score = _ranked(questions[a : a + _PART], vectors, least, keep, known[a : a + _PART])
                for held, values in zip(out, (at + a, to, score), strict=True):
                    held.append(values)
        at, to, score = (np.concatenate(v) if v else np.empty(0, np.int64) for v in out)
        at, to = pa.array(at.astype(np.int64)), pa.array(to.astype(np.int64))
        return pa.table([ask.column("cid").take(at), ask.column("x").take(at), pa.array(score.astype(np.float64)), row.column("ids").take(to)], names=["cid", "x", "score", "ids"])

    def ranked(visits: DataFrame) -> DataFrame:
        ask_side = visits.join(counts, ["tree", "leaf"]).select("tree", "leaf", every("r"), part("s"), "cid", "x", "known")
        return tables.write(ask_side.groupBy(*cells).cogroup(row_side).applyInArrow(rank, result))

    # The own leaves first: from the others only what is as near as the last of their candidates can matter.
    near = ranked(visited.where("own").withColumn("known", F.lit(-2.0)))
    last = near.groupBy("cid").agg(F.sort_array(F.collect_set(F.struct("score", "ids")), asc=False).alias("b")).select("cid", F.coalesce(F.get("b", F.lit(keep - 1))["score"], F.lit(-2.0)).alias("known"))
    far = ranked(visited.where("not own").join(last, "cid", "left").withColumn("known", F.coalesce("known", F.lit(-2.0))))
    return near.unionByName(far)
