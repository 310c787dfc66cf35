"""What the operators share: packed shuffles and id bitmaps.

A packed shuffle moves fixed-width binary records instead of rows.  Map tasks deal
records into buckets by a 64-bit key and send each bucket's records as one binary
value; all records of a key meet in one reduce task, as numpy arrays.  It costs the
record width on disk and a few ns of CPU a record.  The number of buckets follows from
bytes: BUCKET_BYTES of records each, which a reduce task works off in parts of
PART_BYTES by key, so it holds one bucket as it came and sorts one part at a time.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.llm.kernel import U, mix

#: Records that a map task holds before it sends them; more where there are many buckets, so that payloads stay long.
FLUSH_BYTES, MOST_FLUSH_BYTES, LEAST_PAYLOAD = 8 << 20, 64 << 20, 512
BUCKET_BYTES = 128 << 20
PART_BYTES = 16 << 20
PACKED = "bucket int, kind int, payload binary"


def buckets_for(df: DataFrame, column: str, growth: float = 1.0) -> int:
    """Buckets for a shuffle of growth bytes for each byte of a text column: the session's number of partitions, and more where a bucket would exceed BUCKET_BYTES."""
    held = df.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("bigint"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(held * growth) // BUCKET_BYTES), 1)


#: What a worker process keeps between tasks, and the operator it belongs to.
_kept: dict[str, object] = {}
_owner: list[str] = [""]


def kept(key: str, make: Callable[[], object]):
    """A value that a worker process keeps for the tasks of one operator."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _trim() -> None:
    """Give freed memory back: worker processes live on, and the executor's limit holds for all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def _claim(owner: str) -> None:
    """Drop what another operator keeps."""
    if _owner[0] != owner:
        _owner[0] = owner
        _kept.clear()
        gc.collect()
        _trim()


#: Bytes of an Arrow batch, so that long texts come a few at a time; a session's smaller setting stays.
BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bound_batches() -> None:
    session = SparkSession.getActiveSession()
    if session is not None:
        held = session.conf.get(_BATCH_SETTING).rstrip("b")
        if not held.isdigit() or int(held) > BATCH_BYTES:
            session.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def lean(fn, owner: str = "", keep: bool = True):
    """fn for mapInArrow that first drops what other operators keep in the worker and frees memory when it ends.

    Workers that wait for a task take turns, so each of them comes to hold what is kept; with keep
    false it goes when a task ends, and only busy workers hold it.
    Sets the session's bound of an Arrow batch to BATCH_BYTES where it is larger.
    Inner functions travel by value with the globals they name, so what a worker keeps is
    only reached through functions of this module.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _claim(owner)
        try:
            yield from fn(batches)
        finally:
            if not keep:
                _kept.clear()
                gc.collect()
            _trim()

    _bound_batches()
    return run


class Deal:
    """Map side of a packed shuffle: deals records into buckets by key."""

    def __init__(self, buckets: int, dtype: np.dtype, kind: int = 0):
        self.buckets, self.dtype, self.kind = buckets, np.dtype(dtype), kind
        self.limit = min(max(FLUSH_BYTES, buckets * LEAST_PAYLOAD), MOST_FLUSH_BYTES)
        self.keys: list[np.ndarray] = []
        self.records: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Yields batches when enough is held."""
        if len(records):
            self.keys.append(((mix(keys) >> U(32)) % U(self.buckets)).astype(np.uint32))
            self.records.append(records)
            self.held += records.nbytes
            if self.held >= self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.records:
            return
        keys = np.concatenate(self.keys)
        order = np.argsort(keys.astype(np.uint16) if self.buckets < 65536 else keys, kind="stable")
        records, keys = np.concatenate(self.records)[order], keys[order]
        self.keys, self.records, self.held = [], [], 0
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        offsets = (np.concatenate((starts, [len(keys)])) * self.dtype.itemsize).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(keys[starts].astype(np.int32)), pa.array(np.full(len(starts), self.kind, np.int32)), payload], ["bucket", "kind", "payload"])


def gather(batches: Iterable[pa.RecordBatch], kinds: dict[int, tuple[np.dtype, Callable[[np.ndarray], np.ndarray]]]) -> Iterator[dict[int, np.ndarray]]:
    """Reduce side: the records of the task by kind, in parts of about PART_BYTES; records with equal keys are in one part.

    kinds: kind -> record type and a function that gives the records' keys.
    """
    held: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    size = 0
    for batch in batches:
        column = batch.column(2)
        for i, kind in enumerate(batch.column(1).to_numpy()):
            held[int(kind)].append(np.frombuffer(column[i].as_buffer(), kinds[int(kind)][0]))
            size += held[int(kind)][-1].nbytes
    parts = min(-(-size // PART_BYTES), 60_000)
    if parts <= 1:
        yield {k: np.concatenate(v) if v else np.empty(0, kinds[k][0]) for k, v in held.items()}
        return
    bounds: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    for k, arrays in held.items():
        for i, x in enumerate(arrays):
            # The low bits of the mixed key; the bucket came from the high ones.
            part = ((mix(kinds[k][1](x)) & U(0xFFFFFFFF)) % U(parts)).astype(np.uint16)
            arrays[i] = x[np.argsort(part, kind="stable")]
            bounds[k].append(np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts)))))
    for p in range(parts):
        yield {k: np.concatenate([x[b[p] : b[p + 1]] for x, b in zip(held[k], bounds[k], strict=True)]) if held[k] else np.empty(0, kinds[k][0]) for k in kinds}


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def deal_out(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket")


#: Least and greatest number of bits of an id bitmap (4 and 64 MB); between them, 16 for each id.
BITMAP_BITS, MOST_BITMAP_BITS = 1 << 25, 1 << 29
_BUCKET_BITS = 4096 * 8


def id_bitmap(ids: DataFrame, column: str) -> bytes:
    """A one-hash Bloom filter of a column of longs, OR-ed on the executors; at most MOST_BITMAP_BITS bits reach the driver.

    It only spares work: what passes it by chance is dropped by the join that follows.
    """
    bits = BITMAP_BITS
    n = ids.count()
    while bits < MOST_BITMAP_BITS and bits < 16 * n:
        bits *= 2
    slot = F.pmod(F.col(column), F.lit(bits))
    rows = ids.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / _BUCKET_BITS).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("slot") % _BUCKET_BITS).alias("bits"))
    out = bytearray(bits // 8)
    for row in rows.collect():
        out[row.b * 4096 : row.b * 4096 + 4096] = row.bits
    return bytes(out)


def in_bitmap(bitmap: bytes, ids: np.ndarray) -> np.ndarray:
    slot = np.mod(ids.astype(np.int64), len(bitmap) * 8)
    return (np.frombuffer(bitmap, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == U else values.astype(np.int64))
