"""N-gram Jaccard join by T-occurrence search (DivideSkip; Li, Lu and Lu, 2008).

Texts with equal shingle sets form a class, and classes are joined.  If two sets reach
the threshold, their prefixes (in the order of the shingle hashes, a quarter of a set)
share at least T shingles, where T follows from the two sizes.

1. Prefix postings (shingle, class, size) meet by shingle and form inverted lists; of a list
   that is long within a map task only a mark is sent.  Lists of one class vanish.  Lists of up to SHORT_LIST classes go to their classes;
   of longer ones each class is only told that it is in it.
2. Each class searches its short lists: DivideSkip merges the shorter of them with a
   heap that skips, and probes the longer ones by binary search.  Long lists lower the
   threshold by their number.  Only a class with more long lists than its T could have
   a partner that shares long lists alone; such classes are few, and go on to 3.
3. Among these classes the long lists are formed again.  Short ones are searched as
   before.  In those still long, which are groups of near copies, each class is paired
   with one class of its size band, the one in most long lists, which links nearly all.
4. Candidates are verified on whole sets.
5. Those that step 3 sent on and that are still outside the largest component are
   searched among all that it sent on: blocks of whole sets, of the size bands within
   reach, are inverted, and each query counts the shingles that it shares with each set
   of a block.  A block has at most BLOCK_SHINGLES shingles.  Of the links that are found in a block those that
   join two components are kept, so they are fewer than its sets and queries.
6. Links give connected components.

So no list is expanded into all its pairs unless it is short, and no pair that reaches
the threshold is lost.  Postings are moved as packed records; sets of candidates are read
again from the texts, which a bitmap of bounded size selects.

A class is known by 128 bits (cls, chk) of a digest of its set.  Postings and candidates
carry cls alone, which can at worst add candidates; whatever links or names classes
carries both.  A row is known by its doc_id and a hash of its text.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.kernel import U, runs_of_sorted, shingle_sets
from vendora.llm.store import PACKED, Deal, buckets_for, deal_out, fresh, gather, id_bitmap, in_bitmap, lean, long_array
from vendora.plans.checkpoints import Tables, guarded
from vendora.plans.graph import components

SHINGLE = 5
#: Links need 100 * intersection >= 80 * union.
SHORT_LIST = 64
BLOCK_SHINGLES = 500_000
#: Weight of the logarithm in DivideSkip's choice of the number of long lists.
DIVIDE_WEIGHT = 0.5

DOC = np.dtype([("doc", "<i8"), ("text", "<i8"), ("cls", "<u8"), ("chk", "<u8"), ("n", "<u4")])
POST = np.dtype([("tok", "<u8"), ("cls", "<u8"), ("n", "<u4")])
OCC = np.dtype([("q", "<u8"), ("c", "<u8"), ("tok", "<u4"), ("need", "<u4")])
LONG = np.dtype([("q", "<u8"), ("tok", "<u8"), ("n", "<u4")])
HEAVY = np.dtype([("tok", "<u8"), ("cls", "<u8"), ("n", "<u4"), ("lists", "<u4")])


def least_overlap(n):
    """Shared shingles that a set of n needs with any partner: 0.8 n, rounded up."""
    return -(-4 * n // 5)


def slack(n):
    """T of a set among its own: prefixes are longer by this than the shortest that must share one shingle."""
    return np.minimum(6 + n // 20, least_overlap(n))


def prefix_size(n):
    return n - least_overlap(n) + slack(n)


def needed(a, b):
    """Shingles that the prefixes of sets of a and b shingles share if the sets reach the threshold.

    Shared shingles outside may all lie behind the prefix that ends first, which can be
    that of either set.  At least slack(a) and slack(b) for sizes that allow a link.
    """
    return np.maximum(-(-4 * (a + b) // 9) - np.maximum(a - prefix_size(a), b - prefix_size(b)), 1)


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Values in at least `least` of the sorted lists, with the number of lists that hold them."""
    lists = sorted(lists, key=len)
    longest = len(lists[-1]) if lists else 0
    probed = min(least - 1, int(least / (DIVIDE_WEIGHT * math.log2(longest + 1) + 1)), len(lists) - 1) if lists else 0
    merged, probes = lists[: len(lists) - probed], lists[len(lists) - probed :]
    short = least - probed
    at = [0] * len(merged)
    heap = [(x[0], i) for i, x in enumerate(merged) if x]
    heapq.heapify(heap)
    out: dict[int, int] = {}
    while len(heap) >= short:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= short:
            count = len(popped)
            for x in probes:
                p = bisect_left(x, top)
                count += p < len(x) and x[p] == top
            if count >= least:
                out[top] = count
            for i in popped:
                at[i] += 1
                if at[i] < len(merged[i]):
                    heapq.heappush(heap, (merged[i][at[i]], i))
        else:
            # Too few lists hold top: skip to the value that could still reach the threshold.
            while heap and len(popped) < short - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            goal = heap[0][0]
            for i in popped:
                at[i] = bisect_left(merged[i], goal, at[i])
                if at[i] < len(merged[i]):
                    heapq.heappush(heap, (merged[i][at[i]], i))
    return out


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """(cls, chk) of a sorted set."""
    digest = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


def _token(x: np.ndarray) -> np.ndarray:
    return x["tok"]


def _query(x: np.ndarray) -> np.ndarray:
    return x["q"]


def _doc(x: np.ndarray) -> np.ndarray:
    return x["doc"].astype(U)


#: Postings that a map task looks through for long lists before it sends them.
BUFFER_POSTINGS = 200_000


def _told(post: np.ndarray) -> np.ndarray:
    out = np.empty(len(post), LONG)
    out["q"], out["tok"], out["n"] = post["cls"], post["tok"], post["n"]
    return out


def _postings(buckets: int, short_list: int):
    """Kind 0: documents.  Kind 1: postings by shingle.  Kind 2: classes told of long lists.

    A list that is long among the postings that a task holds is long for sure: its classes
    are told at once, and its bucket gets one posting of no shingles, which marks it as long.
    So a shingle that many classes share costs its bucket one record for each buffer.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, posts, told = Deal(buckets, DOC, 0), Deal(buckets, POST, 1), Deal(buckets, LONG, 2)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                post = _by_list(np.concatenate(held))
                held.clear()
                starts, lengths = runs_of_sorted(post["tok"])
                long = np.repeat(lengths > short_list, lengths)
                found = _told(post[long])
                yield from told.add(found["q"], found)
                marks = post[starts[lengths > short_list]]
                marks["cls"], marks["n"] = 0, 0
                for part in (post[~long], marks):
                    yield from posts.add(part["tok"], part)

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            rows = []
            for row, mine in shingle_sets(batch.column(1), SHINGLE):
                n = len(mine)
                cls, chk = class_of(mine) if n else (0, 0)
                both = cls << 64 | chk
                rows.append((ids[row], texts[row], cls, chk, n))
                if n and both not in seen:
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(both)
                    part = np.empty(int(prefix_size(n)), POST)
                    part["tok"], part["cls"], part["n"] = mine[: len(part)], cls, n
                    held.append(part)
                    size += len(part)
                    if size >= BUFFER_POSTINGS:
                        size = 0
                        yield from send()
            every = np.array(rows, DOC)
            yield from docs.add(_doc(every), every)
        yield from send()
        for deal in (docs, posts, told):
            yield from deal.flush()

    return run


def _pairs(cls: np.ndarray, n: np.ndarray, tok: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs within runs (classes ascending in each) whose sizes allow a link, as OCC records."""
    for size in np.unique(lengths):
        first = starts[lengths == size]
        i, j = np.triu_indices(int(size), 1)
        step = max(1, 400_000 // len(i))
        for at in range(0, len(first), step):
            base = first[at : at + step, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
            fit = (5 * na >= 4 * nb) & (5 * nb >= 4 * na)
            a, b = a[fit], b[fit]
            out = np.empty(len(a), OCC)
            out["q"], out["c"], out["tok"], out["need"] = cls[b], cls[a], tok[a].astype(np.uint32), needed(na[fit], nb[fit])
            yield out


def _by_list(post: np.ndarray) -> np.ndarray:
    """Postings by shingle and class, without repeats."""
    # Marks of long lists are of no class and no shingles, so they come first.
    post = post[np.lexsort((post["n"], post["cls"], post["tok"]))]
    if len(post):
        post = post[np.concatenate(([True], (post["tok"][1:] != post["tok"][:-1]) | (post["cls"][1:] != post["cls"][:-1]) | (post["n"][1:] != post["n"][:-1])))]
    return post


def _lists(buckets: int, short_list: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, occ, told = Deal(1, DOC, 0), Deal(buckets, OCC, 1), Deal(buckets, LONG, 2)
        for found in gather(batches, {0: (DOC, _doc), 1: (POST, _token), 2: (LONG, _query)}):
            yield from keep.add(_doc(found[0]), found[0])
            yield from told.add(found[2]["q"], found[2])
            post = _by_list(found[1])
            starts, lengths = runs_of_sorted(post["tok"])
            # A list's mark comes first.
            marked = post["n"][starts] == 0
            starts, lengths = starts + marked, lengths - marked
            short = ~marked & (lengths > 1) & (lengths <= short_list)
            long = marked | (lengths > short_list)
            for part in _pairs(post["cls"], post["n"], post["tok"], starts[short], lengths[short]):
                yield from occ.add(part["q"], part)
            for start, length in zip(starts[long], lengths[long], strict=True):
                part = _told(post[start : start + length])
                yield from told.add(part["q"], part)
        yield from keep.flush()
        yield from occ.flush()
        yield from told.flush()

    return run


def _search(occ: np.ndarray, long_lists: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Candidate pairs (q, c) from the short lists of each q."""
    occ = occ[np.lexsort((occ["c"], occ["tok"], occ["q"]))]
    starts, lengths = runs_of_sorted(occ["q"])
    for start, length in zip(starts, lengths, strict=True):
        mine = occ[start : start + length]
        q = int(mine["q"][0])
        free = long_lists.get(q, 0)
        least = max(1, int(mine["need"].min()) - free)
        cuts, _ = runs_of_sorted(mine["tok"])
        if len(cuts) < least:
            continue
        values = mine["c"].tolist()
        ends = [*cuts[1:].tolist(), length]
        hits = divide_skip([values[a:b] for a, b in zip(cuts.tolist(), ends, strict=True)], least)
        if hits:
            need = dict(zip(values, mine["need"].tolist(), strict=True))
            for c, count in hits.items():
                if count >= max(1, need[c] - free):
                    yield q, c


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) of candidates, and rows (a, null, payload, n) with the long lists of classes that may share those alone."""
    for found in gather(batches, {1: (OCC, _query), 2: (LONG, _query)}):
        told = found[2][np.lexsort((found[2]["n"], found[2]["tok"], found[2]["q"]))]
        if len(told):  # a class that several tasks have seen may be told twice
            told = told[np.concatenate(([True], (told["q"][1:] != told["q"][:-1]) | (told["tok"][1:] != told["tok"][:-1])))]
        starts, lengths = runs_of_sorted(told["q"])
        long_lists = dict(zip(told["q"][starts].tolist(), lengths.tolist(), strict=True))
        pairs = list(_search(found[1], long_lists))
        sizes = np.minimum.reduceat(told["n"], starts) if len(starts) else starts
        heavy = [(told["q"][s], int(n), np.sort(told["tok"][s : s + k]).tobytes()) for s, k, n in zip(starts, lengths, sizes, strict=True) if k >= slack(int(n))]
        a = np.array([x for x, _ in pairs] + [x for x, _, _ in heavy], U)
        b = pa.array([int(np.uint64(x).view(np.int64)) for _, x in pairs] + [None] * len(heavy), pa.int64())
        yield pa.RecordBatch.from_arrays([long_array(a), b, pa.array([None] * len(pairs) + [x for _, _, x in heavy], pa.binary()), pa.array([None] * len(pairs) + [n for _, n, _ in heavy], pa.int64())], ["a", "b", "toks", "n"])


def _heavy_postings(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Deal(buckets, HEAVY, 0)
        for batch in batches:
            for cls, toks, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tok = np.frombuffer(toks, U)
                part = np.empty(len(tok), HEAVY)
                part["tok"], part["cls"], part["n"], part["lists"] = tok, np.int64(cls).view(U), n, len(tok)
                yield from out.add(tok, part)
        yield from out.flush()

    return run


def _heavy_lists(buckets: int, short_list: int):
    """Short lists in full, pivots in long ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occ = Deal(buckets, OCC, 1)
        for found in gather(batches, {0: (HEAVY, _token)}):
            post = _by_list(found[0])
            starts, lengths = runs_of_sorted(post["tok"])
            short = (lengths > 1) & (lengths <= short_list)
            for part in _pairs(post["cls"], post["n"], post["tok"], starts[short], lengths[short]):
                yield from occ.add(part["q"], part)
            for start, length in zip(starts[lengths > short_list], lengths[lengths > short_list], strict=True):
                part = _pivots(post[start : start + length])
                yield from occ.add(part["q"], part)
        yield from occ.flush()

    return run


def _records(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    fit = (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & (a["cls"] != b["cls"])
    a, b = a[fit], b[fit]
    out = np.empty(len(a), OCC)
    out["q"], out["c"] = np.maximum(a["cls"], b["cls"]), np.minimum(a["cls"], b["cls"])
    out["tok"], out["need"] = a["tok"].astype(np.uint32), needed(na[fit], nb[fit])
    return out


def band_of(n: np.ndarray) -> np.ndarray:
    """Sets that link are in the same size band or in adjacent ones."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1.25)).astype(np.int64)


def _pivots(mine: np.ndarray) -> np.ndarray:
    """Each member with the member of its size band that is in most long lists."""
    band = band_of(mine["n"])
    order = np.lexsort((mine["cls"], -mine["lists"].astype(np.int64), band))
    mine = mine[order]
    starts, lengths = runs_of_sorted(band[order])
    return _records(mine, mine[np.repeat(starts, lengths)])


_LINK = "a bigint, ak bigint, b bigint, bk bigint"


class Parts:
    """Numbers below n in parts that links join; the smaller part is renamed, so that all joins take n log n steps."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = [[i] for i in range(n)]

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.of[a], self.of[b]), key=lambda x: len(self.members[x]))
        if a != b:
            self.of[self.members[a]] = b
            self.members[b] += self.members[a]
            self.members[a] = []


def _block_search(key, block: pa.Table, queries: pa.Table) -> pa.Table:
    """Links (a, ak, b, bk) between queries and sets of a block that join different components.

    A link between components that others of the block have joined is left out: what is
    reachable stays the same, and the links are fewer than the components.
    """
    out: list[list[np.ndarray]] = [[], [], [], []]
    if block.num_rows and queries.num_rows:
        sets = [np.frombuffer(x.as_buffer(), U) for x in block.column("shingles").combine_chunks()]
        sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, holder = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
        own, keys, comps = (block.column(c).to_numpy() for c in ("cls", "chk", "comp"))
        names, at = np.unique(np.concatenate((comps, queries.column("q_comp").to_numpy())), return_inverse=True)
        parts, at, q_at = Parts(len(names)), at[: len(sets)], at[len(sets) :]
        asked = [queries.column(c).to_pylist() for c in ("q", "qk")]
        for cls, chk, comp, x in zip(*asked, q_at, queries.column("q_shingles").combine_chunks(), strict=True):
            mine = np.frombuffer(x.as_buffer(), U)
            shared = _shared(every, holder, mine, sizes)
            if shared is None:
                continue
            good = np.flatnonzero((100 * shared >= 80 * (len(mine) + sizes - shared)) & (parts.of[at] != parts.of[comp]))
            good = good[np.unique(parts.of[at[good]], return_index=True)[1]]
            for other in at[good]:
                parts.join(comp, other)
            for held, y in zip(out, (np.full(len(good), cls, np.int64), np.full(len(good), chk, np.int64), own[good], keys[good]), strict=True):
                held.append(y)
    join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
    return pa.table({name: join(x) for name, x in zip(("a", "ak", "b", "bk"), out, strict=True)})


def _shared(every: np.ndarray, holder: np.ndarray, mine: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Shingles that a query shares with each set of a block (at least for sets that can link); None if no set can.

    every, holder: the block's inverted lists, side by side.  The lists that are longest are
    left out of the merge, as many as the least overlap allows, and probed by binary
    search for the sets that the others leave.
    """
    least = int(least_overlap(len(mine)))
    first = np.searchsorted(every, mine)
    n = np.searchsorted(every, mine, "right") - first
    if np.count_nonzero(n) < least:
        return None
    order = np.argsort(n, kind="stable")
    first, n = first[order], n[order]
    probed = min(least - 1, int(least / (DIVIDE_WEIGHT * math.log2(int(n[-1]) + 1) + 1)))
    short, long = slice(0, len(n) - probed), range(len(n) - probed, len(n))
    at = np.repeat(first[short] - np.concatenate(([0], np.cumsum(n[short])[:-1])), n[short]) + np.arange(n[short].sum())
    shared = np.bincount(holder[at], minlength=len(sizes))
    left = np.flatnonzero(shared >= least - probed)
    if not len(left):
        return None
    for i in long:
        members = holder[first[i] : first[i] + n[i]]
        if len(members):
            place = np.minimum(np.searchsorted(members, left), len(members) - 1)
            shared[left] += members[place] == left
    out = np.zeros(len(sizes), np.int64)
    out[left] = shared[left]
    return out


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0):
            x = np.frombuffer(payload.as_buffer(), DOC)
            columns = [long_array(np.ascontiguousarray(x[c])) for c in ("doc", "text", "cls", "chk", "n")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "cls", "chk", "n"])


def _sets(bitmap: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap, batch.column(0).to_numpy())))
            names, sets = [], []
            for _, mine in shingle_sets(batch.column(1), SHINGLE):
                if len(mine):
                    names.append(class_of(mine))
                    sets.append(mine.tobytes())
            both = np.array(names, U).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([long_array(both[:, 0]), long_array(both[:, 1]), pa.array(sets, pa.binary())], ["cls", "chk", "shingles"])

    return run


def reaches(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link: each shingle of the smaller is looked up in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 5 * len(a) < 4 * len(b):
        return False
    at = np.searchsorted(b, a)
    shared = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * shared >= 80 * (len(a) + len(b) - shared)


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [reaches(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
        yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))


def _sets_of(tables: Tables, rows: DataFrame, firsts: DataFrame) -> DataFrame:
    return tables.write(rows.mapInArrow(lean(_sets(id_bitmap(firsts, "first"))), "cls bigint, chk bigint, shingles binary"))


def _named(tables: Tables, links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, ak, b, bk) as links (a, b) of vertices (first, cls, chk)."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("chk").alias(f"{c}k"), F.struct("first", "cls", "chk").alias(f"v{c}"))
    return tables.write(links.distinct().join(side("a"), ["a", "ak"]).join(side("b"), ["b", "bk"]).select(F.col("va").alias("a"), F.col("vb").alias("b")))


def _links(tables: Tables, rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates (a, b) verified on whole sets, as links of vertices."""
    pairs = tables.write(pairs.select("a", "b").distinct())
    sets = _sets_of(tables, rows, pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(classes, "cls").select("first"))
    left = sets.select(F.col("cls").alias("a"), F.col("chk").alias("ak"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("chk").alias("bk"), F.col("shingles").alias("y"))
    return _named(tables, pairs.join(left, "a").join(right, "b").select("a", "ak", "b", "bk", "x", "y").mapInArrow(lean(_verify), _LINK), classes)


def _rest_links(tables: Tables, rows: DataFrame, classes: DataFrame, heavy: DataFrame, found: DataFrame) -> DataFrame:
    """Links that pivots may have missed among the classes of heavy (cls, n), as far as they join components (id, component) of found."""
    firsts = heavy.join(classes, "cls").withColumn("id", F.struct("first", "cls", "chk"))
    labelled = firsts.join(found, "id", "left").select("cls", "chk", "n", "first", F.xxhash64(F.coalesce("component", "id")).alias("comp"))
    labelled = tables.write(labelled.withColumn("band", F.floor(F.log("n") / math.log(1.25)).cast("int")))
    main = labelled.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(1).select(F.col("comp").alias("main"))
    sets = _sets_of(tables, rows, firsts.select("first"))
    # Number of blocks of each band: a row for each band there is, a few dozen.
    bands = labelled.groupBy("band").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    whole = tables.write(labelled.join(sets.dropDuplicates(["cls", "chk"]), ["cls", "chk"]))
    block = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    rest = whole.join(F.broadcast(main), F.col("comp") == F.col("main"), "left_anti")
    asked = max(1, -(-int(rest.agg(F.sum("n")).first()[0] or 0) // (4 * BLOCK_SHINGLES)))
    cell = ("band", "block", "turn")
    index = whole.join(F.broadcast(bands), "band").select("band", block(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("turn"), "cls", "chk", "comp", "shingles")
    near = rest.withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1))))).join(F.broadcast(bands), "band")
    queries = near.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), block(F.lit(asked)).alias("turn"), F.col("cls").alias("q"), F.col("chk").alias("qk"), F.col("comp").alias("q_comp"), F.col("shingles").alias("q_shingles"))
    queries = queries.toDF(*(f"q_{c}" for c in cell), "q", "qk", "q_comp", "q_shingles")
    joining = index.groupBy(*cell).cogroup(queries.groupBy(*(f"q_{c}" for c in cell))).applyInArrow(_block_search, _LINK)
    a, b = F.struct(F.col("a").alias("c"), F.col("ak").alias("k")), F.struct(F.col("b").alias("c"), F.col("bk").alias("k"))
    ordered = joining.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    return _named(tables, ordered.select(F.col("a.c").alias("a"), F.col("a.k").alias("ak"), F.col("b.c").alias("b"), F.col("b.k").alias("bk")), classes)


def _classified(tables: Tables, docs: DataFrame, short_list: int) -> DataFrame:
    """doc_id, text_hash, n, vertex of every row of docs (doc_id, text, text_hash) that has a doc_id.

    vertex is the least class reachable by links, a struct whose first field is its least
    doc_id; null where a text has no shingles.
    """
    rows = docs.where("doc_id is not null")
    buckets = buckets_for(docs, "text", 1.5)
    lists = tables.write(deal_out(rows.mapInArrow(lean(_postings(buckets, short_list)), PACKED), buckets).mapInArrow(lean(_lists(buckets, short_list)), PACKED))
    numbered = tables.write(lists.where("kind = 0").select("payload").mapInArrow(lean(_documents), "doc_id bigint, text_hash bigint, cls bigint, chk bigint, n bigint"))
    classes = tables.write(numbered.where("n > 0").groupBy("cls", "chk").agg(F.min("doc_id").alias("first")))
    searched = tables.write(deal_out(lists.where("kind > 0"), buckets).mapInArrow(lean(_candidates), "a bigint, b bigint, toks binary, n bigint"))
    pairs, heavy = searched.where("b is not null").select("a", "b"), searched.where("b is null")

    any_heavy = not heavy.isEmpty()
    if any_heavy:
        posts = deal_out(heavy.select("a", "toks", "n").mapInArrow(lean(_heavy_postings(buckets)), PACKED), buckets)
        near = deal_out(posts.mapInArrow(lean(_heavy_lists(buckets, short_list)), PACKED), buckets).mapInArrow(lean(_candidates), "a bigint, b bigint, toks binary, n bigint")
        pairs = pairs.union(near.where("b is not null").select("a", "b"))
    found = tables.own(components(_links(tables, rows, classes, pairs)))
    if any_heavy:
        rest = _rest_links(tables, rows, classes, heavy.select(F.col("a").alias("cls"), "n"), found)
        if not rest.isEmpty():  # what is linked already goes as one link of each vertex
            found = tables.own(components(found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(rest)))
    vertices = classes.withColumn("id", F.struct("first", "cls", "chk")).join(found, "id", "left").select("cls", "chk", F.coalesce("component", "id").alias("vertex"))
    return numbered.join(vertices, ["cls", "chk"], "left").select("doc_id", "text_hash", "n", "vertex")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").withColumn("text_hash", F.xxhash64("text"))


@guarded
def ngram_components(docs: DataFrame, short_list: int = SHORT_LIST) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) for every row of docs.

    Only doc_id and text are read.  A null or empty text, or one without words, has no
    shingles and links with nothing.  Rows that repeat a doc_id are told apart by their
    texts.  A row without doc_id takes no part; its component is null.  An empty table gives
    an empty one.
    """
    tables, every = Tables(), _keyed(docs)
    least = _classified(tables, every, short_list).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("vertex.first", "doc_id").alias("component_id"))

    def count_only(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(mine) for _, mine in shingle_sets(batch.column(1), SHINGLE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(0)], ["doc_id", "n_shingles", "component_id"])

    return tables.close(least.unionByName(every.where("doc_id is null").mapInArrow(lean(count_only), "doc_id bigint, n_shingles bigint, component_id bigint")))


@guarded
def keep_first_of_components(docs: DataFrame, short_list: int = SHORT_LIST) -> DataFrame:
    """One row of each component, with all its columns: the least by doc_id, then by the hash of its text; of identical rows any one.

    Rows without doc_id stay, and so do all rows whose text is null or has no words.
    """
    tables = Tables()
    rows = _classified(tables, _keyed(docs), short_list).where("vertex is not null").select("vertex", F.struct("doc_id", "text_hash").alias("row"))
    # Rows of a component are as many as its copies: the minimum and its count are formed before the shuffle.
    counted = tables.write(rows.groupBy("vertex", "row").count())
    kept = counted.groupBy("vertex").agg(F.min("row").alias("kept"))
    of, text = fresh(docs, "_gone_from"), fresh(docs, "_gone_text")
    fate = counted.join(kept, "vertex").select(F.col("row.doc_id").alias(of), F.col("row.text_hash").alias(text), (F.col("row") == F.col("kept")).alias("stays"), "count")
    fate = tables.close(fate.where("not stays or count > 1"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({of: F.col("doc_id").cast("bigint"), text: F.xxhash64(F.col("text").cast("string"))})
    out = keyed.join(fate.where("not stays").select(of, text), [of, text], "left_anti")
    twice = fate.where("stays").select(of, text)
    if not twice.isEmpty():  # rows that are there more than once
        out = out.join(twice, [of, text], "left_anti").unionByName(out.join(twice, [of, text], "left_semi").dropDuplicates([of, text]))
    return out.select(*own)
