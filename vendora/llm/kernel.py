"""Vectorised text kernels over Arrow string buffers.

Texts arrive in Arrow batches; their UTF-8 bytes are one contiguous buffer.  The
functions here find words, hash byte ranges and build shingle sets with a fixed
number of numpy passes over that buffer, in chunks of bounded size, so that a task
needs a few tens of MB however long a batch is.  A single text larger than a chunk is
its own chunk: its bytes are hashed a few MB at a time, and it costs about four bytes
for each of its own besides a few numbers a word.

Hashes are 64-bit: a word is a polynomial over random byte codes modulo 2**64,
finished by a mixer; a shingle combines five mixed words.  Equality of shingles is
equality of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE_CODE_LOWER = _BYTE_CODE.copy()
_BYTE_CODE_LOWER[65:91] = _BYTE_CODE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = int(0x9E3779B97F4A7C15)
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SHINGLE_CODE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept up to a chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = np.empty(size, U)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
            done += step
        if size > 2 * (CHUNK_BYTES + 1):
            return out
        _powers[base] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class RangeHash:
    """Hashes of any ranges of a code sequence in constant time each."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.empty(len(codes) + 1, U)
        self.sums[0] = 0
        np.cumsum(codes * _power(_BASE, len(codes))[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = _power(_BASE_INV, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inv[start] + (end - start).astype(U))


class LongRangeHash:
    """As RangeHash, for sequences of any length: nothing is kept, each range is summed CHUNK_BYTES codes at a time."""

    def __init__(self, values: np.ndarray, code: Callable[[np.ndarray], np.ndarray]):
        self.values, self.code = values, code

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(start), U)
        powers = _power(_BASE, CHUNK_BYTES)
        for i, (low, high) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            for at in range(low, high, CHUNK_BYTES):
                part = self.code(self.values[at : min(at + CHUNK_BYTES, high)])
                sums[i : i + 1] += (part * powers[: len(part)]).sum(dtype=U, keepdims=True) * U(pow(_BASE, at - low, 1 << 64))
        return mix(sums + (end - start).astype(U))


def hash_ranges(codes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """RangeHash(codes[data]).of(start, end), a few MB of data at a time."""
    if len(data) <= 2 * CHUNK_BYTES:
        return RangeHash(codes[data]).of(start, end) if len(data) else np.empty(0, U)
    out = np.empty(len(start), U)
    order = np.argsort(start, kind="stable")
    at = 0
    while at < len(order):
        low = int(start[order[at]])
        stop = max(int(np.searchsorted(start[order], low + CHUNK_BYTES)), at + 1)
        pick = order[at:stop]
        near = pick[end[pick] <= low + 2 * CHUNK_BYTES]
        part = RangeHash(codes[data[low : low + 2 * CHUNK_BYTES]])
        out[near] = part.of(start[near] - low, end[near] - low)
        far = pick[end[pick] > low + 2 * CHUNK_BYTES]
        if len(far):
            out[far] = LongRangeHash(data, lambda x: codes[x]).of(start[far], end[far])
        at = stop
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (len + 1).

    data: the bytes of the texts; offsets are relative to it.
    """
    solid = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of texts: first row, end row, word hashes, first word of each row (len + 1), and starts and ends of words as bytes from the chunk's start."""
    data, offsets = text_buffer(column)
    codes = _BYTE_CODE_LOWER if lower else _BYTE_CODE
    for row, end in chunks(offsets):
        part = data[offsets[row] : offsets[end]]
        starts, ends, firsts = word_bounds(part, offsets[row : end + 1] - offsets[row])
        hashes = hash_ranges(codes, part, starts, ends)
        yield row, end, hashes, firsts, starts, ends


def shingle_hashes(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of k words of the rows, in order, and for each row the index of its first one (len + 1).

    A row with fewer words, but some, has its whole word sequence as one shingle.
    """
    counts = np.diff(firsts)
    number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(number)))
    rows = np.repeat(np.arange(len(counts)), number)
    at = firsts[:-1][rows] + (np.arange(bounds[-1]) - bounds[:-1][rows])
    out = np.full(len(at), k, U)
    if len(at):
        top = len(hashes) - 1
        short = counts[rows] < k
        for j in range(k):
            term = hashes[np.minimum(at + j, top)] * _SHINGLE_CODE[j]
            if short.any():
                term[short & (counts[rows] <= j)] = 0
            out += term
        out[short] += counts[rows][short].astype(U) - U(k)
    return mix(out), bounds


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for row, end, hashes, firsts, _, _ in words(column):
        every, bounds = shingle_hashes(hashes, firsts, k)
        for i in range(end - row):
            mine = np.sort(every[bounds[i] : bounds[i + 1]])
            if len(mine) > 1:
                mine = mine[np.concatenate(([True], mine[1:] != mine[:-1]))]
            yield row + i, mine


def runs_of_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values of a sorted array."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(values)])))
