"""Line deduplication by a segment-partition edit join (Pass-Join; Li et al., 2011).

Lines (text between line feeds) of at least MIN_CHARS characters are compared; shorter
ones are left alone.  Lines within MAX_EDITS edits of characters are linked, linked
lines form classes, and of each class the first occurrence, by doc_id and line number,
is kept.

A line within k edits of another shares one of that line's k + 1 segments, at a place
that the multi-match-aware rule limits.  One pass over the texts deals the keys of
segments and substrings, as packed records of line hashes, into buckets; equal keys
give candidate pairs, less those whose letter parities differ in more bits than
MAX_EDITS edits can change.  Of lists longer than SHORT_LIST each line is paired with
the first one; pairs between lines that this doesn't link follow in a second round,
where a list is spread over cells of two blocks each.
Candidates are verified on their texts by a banded bit-parallel edit distance, many
pairs at a time.  Of equal lines that a map task holds only the first is sent to be
compared; the others are later occurrences whatever the rest holds, and go straight to
their documents' places.

Lines are equal if their 128-bit hashes (h, k; xxh3 of the whole line) are; keys and
candidates carry h alone, and everything that decides about a line carries both.  A row
is known by its doc_id and a hash of its text, so rows that repeat a doc_id with other
texts keep their own places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.kernel import LongRangeHash, RangeHash, U, chunks, mix, runs_of_sorted
from vendora.llm.store import PACKED, Deal, buckets_for, deal_out, fresh, gather, id_bitmap, in_bitmap, lean, long_array
from vendora.plans.checkpoints import Tables, guarded
from vendora.plans.graph import components

SHORT_LIST = 64
_CHUNK_CHARS = 1 << 19
OCCURRENCE = np.dtype([("h", "<u8"), ("k", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("line", "<u4")])
KEY = np.dtype([("key", "<u8"), ("h", "<u8"), ("parity", "<u4")])
#: A line of a long list: its place in it, how many own the key and how many lines there are, and the line's component.
LISTED = np.dtype([("key", "<u8"), ("h", "<u8"), ("parity", "<u4"), ("place", "<u4"), ("owners", "<u4"), ("lines", "<u4"), ("comp", "<i8")])
#: A line in a cell of blocks of a long list: among its owners (bit 1), among the lines compared with them (bit 2), or both.
IN_CELL = np.dtype([("cell", "<u8"), ("h", "<u8"), ("parity", "<u4"), ("role", "u1"), ("comp", "<i8")])
#: Lines of a block.
BLOCK_LINES = 2048
MAX_EDITS = 2
MIN_CHARS = 20
_SEGMENT_CODE = U(0xD6E8FEB86659FD93)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a line feed after each, and offsets."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))


def segment_bounds(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and sizes of the edits + 1 segments of lines of these lengths; the last ones are longer by one where needed."""
    parts = edits + 1
    base, extra = length // parts, length % parts
    out, start = [], np.zeros_like(length)
    for i in range(parts):
        size = base + (i >= parts - extra)
        out.append((start, size))
        start = start + size
    return out


def join_keys(hashes: RangeHash, start: np.ndarray, length: np.ndarray, edits: int = MAX_EDITS):
    """Index keys (of each line's own segments) and probe keys (of substrings that shorter or equal lines may have as segments).

    Yields (is_index, line numbers, keys).  A substring is probed only where a pair
    within the edits must align by the multi-match-aware rule.  At equal lengths the
    aligned probe is the index key itself, so it is not repeated.
    """
    every = np.arange(len(start))
    for gap in range(edits + 1):
        fit = every if gap == 0 else every[length - gap > edits]
        own = length[fit] - gap
        for i, (at, size) in enumerate(segment_bounds(own, edits)):
            low, high = max(-i, gap - (edits - i)), min(i, gap + (edits - i))
            for shift in range(low, high + 1):
                begin = at + shift
                ok = (begin >= 0) & (begin + size <= length[fit])
                rows = fit[ok]
                first = start[rows] + begin[ok]
                keys = mix(hashes.of(first, first + size[ok]) ^ ((own[ok].astype(U) * U(64) + U(i)) * _SEGMENT_CODE))
                yield gap == 0 and shift == 0, rows, keys


def lines_of(points: np.ndarray, offsets: np.ndarray):
    """Start, length, text number and number within its text of every line."""
    ends = np.flatnonzero(points == 10)
    start = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else np.empty(0, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    return start, ends - start, doc, np.arange(len(start)) - np.searchsorted(start, offsets[:-1])[doc]


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b without what they share at their ends, which leaves the distance as it is."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """Edit distances of pairs of code point arrays, or most + 1 where they exceed most (at most 30).

    Columns of the dynamic programme restricted to the diagonals -most .. most, each as
    one machine word of vertical differences (Hyyro, 2003), for all pairs at once.
    """
    n = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.full(n, most + 1, np.int64)
    near = np.abs(la - lb) <= most
    if not near.any():
        return out
    width = 2 * most + 1
    long_a, long_b = int(la.max()), int(lb.max())
    wide = np.full((n, long_a + 2 * most + long_b + 2), 0xFFFFFFFF, np.uint32)
    text = np.full((n, long_b), 0xFFFFFFFE, np.uint32)
    for i in range(n):
        wide[i, most : most + la[i]] = a[i]
        text[i, : lb[i]] = b[i]
    one, top = U(1), U(1) << U(width - 1)
    full = (U(1) << U(width)) - one
    # Bit k of a column j stands for row j - most + k (rows from 0); rows above the first count down from the border.
    up = np.full(n, full ^ ((one << U(most)) - one) if most else full, U)
    down = np.zeros(n, U)
    low = np.full(n, most, np.int64)  # distance at the band's lowest row
    columns = np.zeros((n, long_b), U)
    for k in range(width):
        columns |= (wide[:, k : k + long_b] == text).astype(U) << U(k)
    for j in range(long_b):
        eq = columns[:, j]
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        hp = down | (full & ~(diag | up))
        hn = diag & up
        live = j < lb
        low += live & ((diag & top) == 0)
        moved = diag >> one
        up = np.where(live, (hn | ~(moved | hp)) & full, up)
        down = np.where(live, hp & moved, down)
    # After the last column, bit k of up and down is the step into row lb - most + k: walk from the lowest row up to row la.
    at = low.copy()
    for k in range(width - 1, 0, -1):
        step = (lb - most + k) > la
        bit = U(k - 1)
        at -= step & ((up >> bit) & one).astype(bool)
        at += step & ((down >> bit) & one).astype(bool)
    out[near] = np.minimum(at[near], most + 1)
    return out


def _parities(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each line, which of 32 letter classes occur an odd number of times; an edit changes at most two of them."""
    if not len(start):
        return np.empty(0, np.uint32)
    sums = np.concatenate(([np.uint32(0)], np.bitwise_xor.accumulate(np.uint32(1) << (points & np.uint32(31)))))
    return sums[start + length] ^ sums[start]


def _windows(text: str) -> Iterator[tuple[int, str]]:
    """(number of the first line, lines) of parts of a text that end at line feeds, of about _CHUNK_CHARS or of one line."""
    at = number = 0
    while len(text) - at > _CHUNK_CHARS:
        end = text.rfind("\n", at, at + _CHUNK_CHARS)
        if end < 0:
            end = text.find("\n", at)
            if end < 0:
                break
        part = text[at:end]
        yield number, part
        number += part.count("\n") + 1
        at = end + 1
    yield number, text[at:]


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Chunks of texts: their rows, the numbers of their first lines, and the texts; long texts come in windows."""
    sizes = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in texts])))
    for row, end in chunks(sizes, _CHUNK_CHARS):
        if end == row + 1 and sizes[end] - sizes[row] > _CHUNK_CHARS:
            for number, part in _windows(texts[row]):
                yield [row], [number], [part]
        else:
            yield list(range(row, end)), [0] * (end - row), [t or "" for t in texts[row:end]]


def _codes(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(U) + U(77))


def _hashed_lines(texts: list[str | None], least: int):
    """For chunks of texts: points, hashes of ranges, and start, length, row, number and hashes (h, k) of the lines compared."""
    for rows, numbers, part in _parts(texts):
        points, offsets = code_points(part)
        start, length, doc, number = lines_of(points, offsets)
        keep = length >= least
        start, length, doc, number = start[keep], length[keep], doc[keep], number[keep]
        ranges = RangeHash(_codes(points)) if len(points) <= 4 * _CHUNK_CHARS else LongRangeHash(points, _codes)
        raw = memoryview(points).cast("B")
        digests = b"".join([xxhash.xxh3_128_digest(raw[4 * s : 4 * (s + n)]) for s, n in zip(start.tolist(), length.tolist(), strict=True)])
        both = np.frombuffer(digests, U).reshape(-1, 2)
        yield points, ranges, start, length, np.array(rows, np.int64)[doc], number + np.array(numbers, np.int64)[doc], both[:, 0].copy(), both[:, 1].copy()


#: Line occurrences that a map task holds before it sends them.
BUFFER_LINES = 300_000


def _hash_of(x: np.ndarray) -> np.ndarray:
    return x["h"]


def _split_firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrences of lines, and later ones; a repeated row repeats its lines' places and is no later occurrence of itself."""
    x = x[np.lexsort((x["line"], x["text"], x["doc"], x["k"], x["h"]))]
    new = np.concatenate(([True], (x["h"][1:] != x["h"][:-1]) | (x["k"][1:] != x["k"][:-1]))) if len(x) else np.empty(0, bool)
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    return x[new], x[(x["doc"] != x["doc"][start]) | (x["text"] != x["text"][start]) | (x["line"] != x["line"][start])]


def _deal_lines(buckets: int, edits: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own, probe, later = Deal(buckets, OCCURRENCE, 0), Deal(buckets, KEY, 1), Deal(buckets, KEY, 2), Deal(buckets, OCCURRENCE, 3)
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                first, others = _split_firsts(np.concatenate(held))
                held.clear()
                yield from seen.add(first["h"], first)
                yield from later.add(others["doc"].astype(U), others)

        for batch in batches:
            ids, keys_of_texts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for points, ranges, start, length, row, number, h, k in _hashed_lines(batch.column(1).to_pylist(), least):
                part = np.empty(len(h), OCCURRENCE)
                part["h"], part["k"], part["doc"], part["text"], part["line"] = h, k, ids[row], keys_of_texts[row], number
                held.append(part)
                if sum(map(len, held)) >= BUFFER_LINES:
                    yield from send()
                # Copies within the chunk have the same keys.
                order = np.lexsort((k, h))
                first = order[np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (k[order][1:] != k[order][:-1])))] if len(h) else order
                h, start, length = h[first], start[first], length[first]
                parity = _parities(points, start, length)
                for is_index, rows, keys in join_keys(ranges, start, length, edits):
                    part = np.empty(len(rows), KEY)
                    part["key"], part["h"], part["parity"] = keys, h[rows], parity[rows]
                    yield from (own if is_index else probe).add(keys, part)
        yield from send()
        for deal in (seen, own, probe, later):
            yield from deal.flush()

    return run


def _unique(x: np.ndarray) -> np.ndarray:
    x = x[np.lexsort((x["h"], x["key"]))]
    return x[np.concatenate(([True], (x["key"][1:] != x["key"][:-1]) | (x["h"][1:] != x["h"][:-1])))] if len(x) else x


class _Pairs:
    """Collects candidate pairs that pass the parity filter, without repeats."""

    def __init__(self, edits: int):
        self.most = 2 * edits
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        good = (a["h"] != b["h"]) & (np.bitwise_count(a["parity"] ^ b["parity"]) <= self.most)
        x, y = a["h"][good], b["h"][good]
        if len(x):
            self.held.append(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1))
            self.size += len(x)
            if self.size > 2_000_000:
                self.held = [np.unique(np.concatenate(self.held), axis=0)]
                self.size = len(self.held[0]) // 2

    def batch(self) -> pa.RecordBatch:
        x = np.unique(np.concatenate(self.held), axis=0) if self.held else np.empty((0, 2), U)
        return _row_batch(0, x[:, 0], x[:, 1])


_ROWS = "kind int, a bigint, b bigint, payload binary"


def _row_batch(kind: int, a: np.ndarray, b: np.ndarray, payload: list | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), long_array(a), long_array(b), pa.array(payload or [None] * len(a), pa.binary())], ["kind", "a", "b", "payload"])


def _key_of(x: np.ndarray) -> np.ndarray:
    return x["key"]


def _match(edits: int, short_list: int):
    """Kind 0: candidate pairs.  Kind 1: occurrences, as payloads that hold all those of a line.  Kind 2: a line of a long list (line, list), with its record.  Kind 3: later occurrences, as payloads."""
    keys = {0: (OCCURRENCE, _hash_of), 1: (KEY, _key_of), 2: (KEY, _key_of), 3: (OCCURRENCE, lambda x: x["doc"].astype(U))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in gather(batches, keys):
            yield from match(found)

    def match(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for kind in (0, 3):
            yield _row_batch(max(kind, 1), np.zeros(1, np.int64), np.zeros(1, np.int64), [found[kind].tobytes()])
        own, probe = _unique(found[1]), _unique(found[2])
        pairs = _Pairs(edits)
        starts, lengths = runs_of_sorted(own["key"])
        first = np.searchsorted(probe["key"], own["key"][starts])
        probes = np.searchsorted(probe["key"], own["key"][starts], "right") - first
        short = (lengths <= short_list) & (probes <= short_list)
        for size in np.unique(lengths[short & (lengths > 1)]):
            i, j = np.triu_indices(int(size), 1)
            base = starts[short & (lengths == size)][:, None]
            pairs.add(own[(base + i).ravel()], own[(base + j).ravel()])
        some = short & (probes > 0)
        for size in np.unique(lengths[some]):
            pick = some & (lengths == size)
            for j in range(int(size)):
                n = probes[pick]
                at = np.repeat(first[pick] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                pairs.add(np.repeat(own[starts[pick] + j], n), probe[at])
        for s, n, f, p in zip(starts[~short], lengths[~short], first[~short], probes[~short], strict=True):
            mine, asking = own[s : s + n], probe[f : f + p]
            pivot = mine[:1]
            pairs.add(np.repeat(pivot, n - 1), mine[1:])
            pairs.add(np.repeat(pivot, p), asking)
            for before, part in ((0, mine), (n, asking)):
                record = np.empty(len(part), LISTED)
                record["key"], record["h"], record["parity"], record["comp"] = part["key"], part["h"], part["parity"], 0
                record["place"], record["owners"], record["lines"] = before + np.arange(len(part)), n, n + p
                yield _row_batch(2, part["h"].copy(), part["key"].copy(), [r.tobytes() for r in record])
        yield pairs.batch()

    return run


def _cells(x: np.ndarray) -> Iterator[np.ndarray]:
    """Lines of long lists in every cell of their lists that they take part in.

    A cell compares the owners of one block of a list with all lines of that block or a
    later one, so that each pair with an owner meets in one cell, and a long list is spread
    over as many cells as it has pairs of blocks.
    """
    place, owners, lines = (x[c].astype(np.int64) for c in ("place", "owners", "lines"))
    block, blocks, owned = place // BLOCK_LINES, -(-lines // BLOCK_LINES), -(-owners // BLOCK_LINES)
    owns = place < owners

    def of(pick: np.ndarray, low: np.ndarray, high: np.ndarray, role: int) -> np.ndarray:
        out = np.empty(int(pick.sum()), IN_CELL)
        for name in ("h", "parity", "comp"):
            out[name] = x[name][pick]
        out["role"] = role
        out["cell"] = mix(x["key"][pick] + mix(low.astype(U) * U(0x9E3779B97F4A7C15) + high.astype(U)))
        return out

    yield of(owns, block[owns], block[owns], 3)
    # Lines that ask may share the last block of the owners.
    pick = ~owns & (block < owned)
    yield of(pick, block[pick], block[pick], 2)
    for other in range(int(blocks.max(initial=0))):
        pick = owns & (block < other) & (other < blocks)
        yield of(pick, block[pick], np.full(int(pick.sum()), other), 1)
        pick = (other < block) & (other < owned)
        yield of(pick, np.full(int(pick.sum()), other), block[pick], 2)


def _relabel(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Deal(buckets, IN_CELL, 0)
        for batch in batches:
            payloads = batch.column(0).to_pylist()
            if payloads:
                part = np.frombuffer(b"".join(payloads), LISTED).copy()
                part["comp"] = batch.column(1).to_numpy()
                for records in _cells(part):
                    yield from out.add(records["cell"], records)
        yield from out.flush()

    return run


def _cell_of(x: np.ndarray) -> np.ndarray:
    return x["cell"]


def _match_rest(edits: int):
    """Pairs of long lists whose lines are in different components and pass the parity filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in gather(batches, {0: (IN_CELL, _cell_of)}):
            yield match(found[0])

    def match(found: np.ndarray) -> pa.RecordBatch:
        found = found[np.argsort(found["cell"], kind="stable")]
        pairs = _Pairs(edits)
        starts, lengths = runs_of_sorted(found["cell"])
        for s, n in zip(starts, lengths, strict=True):
            mine = found[s : s + n]
            own, others = mine[mine["role"] & 1 == 1], mine[mine["role"] & 2 == 2]
            step = max(1, 500_000 // max(len(own), 1))
            for at in range(0, len(others), step):
                part = others[at : at + step]
                near = np.bitwise_count(part["parity"][:, None] ^ own["parity"][None, :]) <= 2 * edits
                i, j = np.nonzero(near & (part["comp"][:, None] != own["comp"][None, :]))
                pairs.add(part[i], own[j])
        return pairs.batch()

    return run


def _texts(bitmap: bytes, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for points, _, start, length, _, _, h, k in _hashed_lines(batch.column(1).to_pylist(), least):
                lines, others, texts = [], [], []
                for i in np.flatnonzero(in_bitmap(bitmap, h.view(np.int64))):
                    line = int(h[i]) << 64 | int(k[i])
                    if line not in sent:
                        if len(sent) > 300_000:
                            sent.clear()
                        sent.add(line)
                        lines.append(h[i])
                        others.append(k[i])
                        texts.append(points[start[i] : start[i] + length[i]].tobytes())
                yield pa.RecordBatch.from_arrays([long_array(np.array(lines, U)), long_array(np.array(others, U)), pa.array(texts, pa.binary())], ["h", "k", "points"])

    return run


def _verify(edits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [_trimmed(*(np.frombuffer(v.as_buffer(), np.uint32) for v in pair)) for pair in zip(batch.column(4), batch.column(5), strict=True)]
            x, y = [a for a, _ in ends], [b for _, b in ends]
            order = np.argsort([len(v) for v in y], kind="stable") if y else []
            good = np.zeros(len(x), bool)
            at = 0
            while at < len(order):  # pairs of like length together, at most a few MB at a time
                n = max(1, min(len(order) - at, 400_000 // max(len(y[order[min(at + 255, len(order) - 1)]]), 1), 256))
                part = order[at : at + n]
                good[part] = edit_distances([x[i] for i in part], [y[i] for i in part], edits) <= edits
                at += n
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good))

    return run


def _links(tables: Tables, rows: DataFrame, pairs: DataFrame, edits: int, least: int) -> DataFrame:
    """Candidates (a, b) verified on their texts: links (a, b) of lines, each a struct (h, k)."""
    pairs = tables.write(pairs.distinct())
    ids = pairs.select(F.col("a").alias("h")).union(pairs.select("b"))
    texts = tables.write(rows.mapInArrow(lean(_texts(id_bitmap(ids, "h"), least)), "h bigint, k bigint, points binary").dropDuplicates(["h", "k"]))
    x = texts.select(F.col("h").alias("a"), F.col("k").alias("ak"), F.col("points").alias("x"))
    y = texts.select(F.col("h").alias("b"), F.col("k").alias("bk"), F.col("points").alias("y"))
    near = pairs.join(x, "a").join(y, "b").select("a", "ak", "b", "bk", "x", "y").mapInArrow(lean(_verify(edits)), "a bigint, ak bigint, b bigint, bk bigint")
    return tables.write(near.select(F.struct(F.col("a").alias("h"), F.col("ak").alias("k")).alias("a"), F.struct(F.col("b").alias("h"), F.col("bk").alias("k")).alias("b")))


def _firsts(bitmap: bytes):
    """Kind 0: later occurrences (row, line).  Kind 1: first occurrences of linked lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(payload.as_buffer(), OCCURRENCE)
                first, later = _split_firsts(x) if kind == 1 else (x[:0], x)
                first = first[in_bitmap(bitmap, first["h"].copy().view(np.int64))]
                for out, y in ((0, later), (1, first)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), out, np.int32)), long_array(y["h"].copy()), long_array(y["k"].copy()), pa.array(y["doc"].copy()), pa.array(y["text"].copy()), pa.array(y["line"].astype(np.int32))], ["kind", "h", "k", "doc_id", "text_hash", "line"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").withColumn("text_hash", F.xxhash64("text"))


@guarded
def repeated_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS, short_list: int = SHORT_LIST) -> DataFrame:
    """(doc_id, text_hash, line): places of lines, counted from 0, that repeat an earlier one or are within reach of its class.

    text_hash (xxhash64 of the text) tells the rows of one doc_id apart; the lesser comes
    first.  A later occurrence of an equal line within a row counts as well.  Null and empty
    texts have no lines; rows without doc_id take no part; rows that repeat a doc_id and
    text are one occurrence.
    """
    tables = Tables()
    rows = _keyed(docs).where("doc_id is not null")
    buckets = buckets_for(docs, "text", 2.0)
    matched = tables.write(deal_out(rows.mapInArrow(lean(_deal_lines(buckets, edits, least)), PACKED), buckets).mapInArrow(lean(_match(edits, short_list)), _ROWS))
    links = _links(tables, rows, matched.where("kind = 0").select("a", "b"), edits, least)
    listed = matched.where("kind = 2").select(F.col("a").alias("h"), "payload")
    if not listed.isEmpty():
        found = tables.own(components(links)).select(F.col("id.h").alias("h"), F.xxhash64("component").alias("component"))
        labelled = listed.join(found, "h", "left").select("payload", F.coalesce("component", "h").alias("comp"))
        rest = deal_out(labelled.mapInArrow(lean(_relabel(buckets)), PACKED), buckets).mapInArrow(lean(_match_rest(edits)), _ROWS).select("a", "b")
        links = links.union(_links(tables, rows, rest, edits, least))
    found = tables.own(components(links))
    linked = found.select(F.col("id.h").alias("h"), F.col("id.k").alias("k"), "component")
    seen = tables.write(matched.where("kind in (1, 3)").select("kind", "payload").mapInArrow(lean(_firsts(id_bitmap(linked, "h"))), "kind int, h bigint, k bigint, doc_id bigint, text_hash bigint, line int"))
    place = F.struct("doc_id", "text_hash", "line")
    firsts = seen.where("kind = 1").join(linked, ["h", "k"]).select("component", place.alias("place"))
    kept = firsts.groupBy("component").agg(F.min("place").alias("kept"))
    others = firsts.join(kept, "component").where("place <> kept").select("place.*")
    return tables.close(seen.where("kind = 0").select("doc_id", "text_hash", "line").unionByName(others))


def _without(text: str | None, gone: list[int] | None) -> tuple[str | None, int, int]:
    """Text without the lines of these numbers, its number of lines, and how many went."""
    if not text:
        return text, 0, 0
    if not gone:
        return text, text.count("\n") + 1, 0
    lines, out = text.split("\n"), set(gone)
    kept = [x for i, x in enumerate(lines) if i not in out]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _with_places(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """docs with a last column of the numbers of their repeated lines; the lists are small, so they are the hashed side."""
    of, text, gone = fresh(docs, "_gone_from"), fresh(docs, "_gone_text"), fresh(docs, "_gone")
    places = repeated_lines(docs, edits, least).groupBy(F.col("doc_id").alias(of), F.col("text_hash").alias(text)).agg(F.collect_set("line").alias(gone))
    rows = docs.withColumns({of: F.col("doc_id").cast("bigint"), text: F.xxhash64(F.col("text").cast("string"))})
    return rows.join(places.hint("shuffle_hash"), [of, text], "left").select(*(F.col(f"`{c}`") for c in docs.columns), gone)


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_dropped; a row for every row of docs.

    Only doc_id and text are read.  Null and empty texts have no lines and stay as they
    are, and so does the text of a row without doc_id.  A text may lose all its lines
    and become empty.  Rows that repeat a doc_id and text are one occurrence: none of
    them loses a line to another; rows that repeat a doc_id with other texts are told
    apart.  An empty table gives an empty one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_without(t.as_py(), g) for t, g in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.int64()), pa.array([x for _, _, x in found], pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return _with_places(rows, edits, least).mapInArrow(lean(run), "doc_id bigint, text string, n_lines bigint, n_dropped bigint")


def drop_repeated_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS) -> DataFrame:
    """docs with their own columns: text without repeated lines, n_chars its length; rows that had lines and lose them all go.

    Null and empty texts stay, and so do rows without doc_id; repeated rows are treated
    as by dedup_lines; an n_chars is changed only where its text is.
    """
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            gone = columns.pop()
            old = columns[at].to_pylist()
            texts = [_without(t, g)[0] for t, g in zip(old, gone.to_pylist(), strict=True)]
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pa.array([n if t == o or t is None else len(t) for t, o, n in zip(texts, old, columns[chars].to_pylist(), strict=True)], columns[chars].type)
            keep = pa.array([bool(t) or not o for t, o in zip(texts, old, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(keep)

    return _with_places(docs, edits, least).mapInArrow(lean(run), docs.schema)
