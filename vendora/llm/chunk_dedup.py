"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last WINDOW bytes cuts each text into chunks of about 25 bytes
on average, so a cut depends on the bytes before it alone and an insertion moves no
later cut.  The units compared are two adjacent chunks, and single chunks that are long
enough by themselves; they are known by a 96-bit digest, and of equal units the first, by
doc_id, text and place, is kept.  A span is a run of repeated units that all have a source in one
earlier row at one distance, so the whole of it stands there; spans of at least MIN_SPAN
bytes count as repeats, and shorter ones (a common line, a phrase) are left alone.

Units of a copied passage can come first in different places, as a phrase in it may be
older than the passage.  Where overlapping units have several sources, each unit is looked up
in the others that may run on (those of its neighbours, and the two most frequent ones): the source's row
has, at the place asked for, a unit that follows the same first one, or it hasn't.

A row is known by its doc_id and a hash of its text, so rows that repeat a doc_id with
other texts keep their own places.

Digests move as packed records.  Each map task first looks among the units that it holds:
of equal ones only the first is sent to be compared by digest, with the others following
it (by its place, of which a task's buffer bounds the number).  So a unit with any number
of copies costs its bucket one record for each buffer, not one for each copy, and
followers learn the first place from the unit they follow.  A last shuffle, by row,
joins repeated units into spans; lookups move only units of rows that are asked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.kernel import CHUNK_BYTES, U, chunks, hash_ranges, mix, text_buffer
from vendora.llm.store import PACKED, Deal, buckets_for, deal_out, gather, id_bitmap, in_bitmap, lean
from vendora.plans.checkpoints import Tables, guarded

WINDOW = 16
#: The top bits of the 16-bit gear hash that must be zero at a cut: 2**4 bytes between cuts on average.
CUT_BITS = 4
#: A cut so soon after another one is none; a chunk without a cut ends at MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 8, 256
MIN_SPAN = 100
_rng = np.random.Generator(np.random.PCG64(7))
_GEAR = _rng.integers(0, 1 << 16, 256, dtype=np.uint16)
_CODES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)

UNIT = np.dtype([("d1", "<u8"), ("d2", "<u4"), ("doc", "<i8"), ("text", "<i8"), ("at", "<u4"), ("size", "<u4")])
#: A unit (doc, text, at, size) that follows an equal one (lead, lead_text, lead_at).
FOLLOWER = np.dtype([("lead", "<i8"), ("lead_text", "<i8"), ("lead_at", "<u4"), ("doc", "<i8"), ("text", "<i8"), ("at", "<u4"), ("size", "<u4")])
#: Whether a unit (doc, text, at, size) with this first place is also in another row at another place.
LOOKUP = np.dtype([("in_doc", "<i8"), ("in_text", "<i8"), ("in_at", "<u4"), *FOLLOWER.descr])
#: Units that a map task holds before it sends them.
BUFFER_UNITS = 300_000


def _marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of the last WINDOW bytes of a text marks a cut."""
    rows = len(offsets) - 1
    if rows == 1 and len(data) > CHUNK_BYTES + WINDOW:
        found = []
        for at in range(0, len(data), CHUNK_BYTES):
            low = max(at - WINDOW + 1, 0)
            found.append(_marks(data[low : at + CHUNK_BYTES], np.array([0, 0])) + low)
            found[-1] = found[-1][found[-1] > at]
        return np.concatenate(found)
    # Zeros between texts keep the hash within its text.
    place = np.arange(len(data)) + WINDOW * np.repeat(np.arange(rows), np.diff(offsets)) if rows > 1 else slice(None)
    gear = np.zeros(len(data) + WINDOW * (rows - 1), np.uint16)
    gear[place] = _GEAR[data]
    width = 1
    while width < WINDOW:
        gear[width:] = gear[width:] + (gear[:-width] << np.uint16(width))
        width *= 2
    return np.flatnonzero((gear[place] >> np.uint16(16 - CUT_BITS)) == 0) + 1


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the chunks of texts that lie side by side in data (offsets from 0)."""
    cut = _marks(data, offsets)
    before = np.concatenate(([-MIN_CHUNK], cut[:-1]))
    of = np.searchsorted(offsets, cut - 1, "right")
    # A mark so soon after another one of its text, whether that is a cut or not, is no cut.
    cut = cut[(cut - before >= MIN_CHUNK) | np.concatenate(([True], of[1:] != of[:-1]))[: len(cut)]]
    for _ in range(3):  # not inside a character
        inside = np.zeros(len(cut), bool)
        ok = cut < len(data)
        inside[ok] = (data[cut[ok]] & 0xC0) == 0x80
        cut = cut + inside
    bounds = np.unique(np.concatenate((cut, offsets)))
    gaps = np.diff(bounds)
    for at in np.flatnonzero(gaps > MAX_CHUNK):
        more = np.arange(bounds[at] + MAX_CHUNK, bounds[at + 1], MAX_CHUNK)
        for _ in range(3):
            more = more + ((data[more] & 0xC0) == 0x80)
        cut = np.concatenate((cut, more))
    bounds = np.unique(np.concatenate((cut, offsets)))
    start, end = bounds[:-1], bounds[1:]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def units(start: np.ndarray, end: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the units made of chunks: neighbours in a text, chunks of at least `least` bytes, and the chunk of a text that has one only."""
    together = np.flatnonzero(doc[1:] == doc[:-1])
    paired = np.zeros(len(start), bool)
    paired[together] = paired[together + 1] = True
    single = np.flatnonzero((end - start >= least) | ~paired)
    return np.concatenate((start[together], start[single])), np.concatenate((end[together + 1], end[single])), np.concatenate((doc[together], doc[single]))


def _place(doc: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix((doc.astype(U) ^ mix(text.astype(U))) * U(0x9E3779B97F4A7C15) + at.astype(U))


def _elsewhere(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which units aren't at the place of the first equal one: a repeated row repeats its units' places and is no later occurrence of itself."""
    return (x["doc"] != x["doc"][first]) | (x["text"] != x["text"][first]) | (x["at"] != x["at"][first])


def _leads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x sorted by digest and place, and for each the index of the first equal one."""
    x = x[np.lexsort((x["at"], x["text"], x["doc"], x["d2"], x["d1"]))]
    new = np.concatenate(([True], (x["d1"][1:] != x["d1"][:-1]) | (x["d2"][1:] != x["d2"][:-1])))
    return x, np.flatnonzero(new)[np.cumsum(new) - 1]


def _followers(x: np.ndarray, first: np.ndarray, pick: np.ndarray) -> np.ndarray:
    out = np.empty(int(pick.sum()), FOLLOWER)
    for name, of in (("lead", "doc"), ("lead_text", "text"), ("lead_at", "at")):
        out[name] = x[of][first][pick]
    for name in ("doc", "text", "at", "size"):
        out[name] = x[name][pick]
    return out


def _at_lead(x: np.ndarray) -> np.ndarray:
    return _place(x["lead"], x["lead_text"], x["lead_at"])


def _at_self(x: np.ndarray) -> np.ndarray:
    return _place(x["doc"], x["text"], x["at"])


def _deal_units(buckets: int, least: int):
    """Kind 0: first units of each buffer, by digest.  Kind 1: the others, by the place of the one they follow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, others = Deal(buckets, UNIT, 0), Deal(buckets, FOLLOWER, 1)

        def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if held:
                x, first = _leads(np.concatenate(held))
                own = first == np.arange(len(x))
                yield from firsts.add(x["d1"][own], x[own])
                part = _followers(x, first, _elsewhere(x, first))
                yield from others.add(_at_lead(part), part)

        held: list[np.ndarray] = []
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, offsets = text_buffer(batch.column(1))
            for row, end in chunks(offsets):
                part = data[offsets[row] : offsets[end]]
                if not len(part):
                    continue
                own = offsets[row : end + 1] - offsets[row]
                start, stop, doc = units(*cut_points(part, own), least)
                made = np.empty(len(start), UNIT)
                made["d1"] = hash_ranges(_CODES[0], part, start, stop)
                made["d2"] = (hash_ranges(_CODES[1], part, start, stop) >> U(32)).astype(np.uint32)
                made["doc"], made["text"], made["at"], made["size"] = ids[row + doc], keys[row + doc], start - own[doc], stop - start
                held.append(made)
                if sum(map(len, held)) >= BUFFER_UNITS:
                    yield from send(held)
                    held = []
        yield from send(held)
        yield from firsts.flush()
        yield from others.flush()

    return run


def _find_repeats(buckets: int):
    """Kind 0: leads that follow a unit of another task (or buffer), by their own place.  Kind 1: followers, as they came."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, others = Deal(buckets, FOLLOWER, 0), Deal(buckets, FOLLOWER, 1)
        for found in gather(batches, {0: (UNIT, lambda x: x["d1"]), 1: (FOLLOWER, _at_lead)}):
            if len(found[0]):
                x, first = _leads(found[0])
                part = _followers(x, first, _elsewhere(x, first))
                yield from known.add(_at_self(part), part)
            yield from others.add(_at_lead(found[1]), found[1])
        yield from known.flush()
        yield from others.flush()

    return run


#: Repeats, spans and lookups at rest: kind, the row and place asked (of lookups), and the fields of FOLLOWER.
ROWS = ", ".join(["kind int", *(f"{n} bigint" for n in LOOKUP.names)])
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: Rows of a batch, so that readers hold little at a time.
BATCH_ROWS = 50_000


def as_rows(x: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(x), BATCH_ROWS):
        part = x[at : at + BATCH_ROWS]
        column = lambda n: pa.array(part[n].astype(np.int64)) if n in x.dtype.names else pa.nulls(len(part), pa.int64())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), *(column(n) for n in LOOKUP.names)], _NAMES)


def records(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    out = np.empty(batch.num_rows, kind)
    for name in kind.names:
        out[name] = batch.column(name).to_numpy()
    return out


def _deal_rows(buckets: int, kind: int, key, type_: np.dtype, pick=None):
    """Rows as packed records of a kind, by key; those that pick takes of a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Deal(buckets, type_, kind)
        for batch in batches:
            x = records(batch, type_)
            x = x if pick is None else x[pick(batch)]
            yield from out.add(key(x), x)
        yield from out.flush()

    return run


def _resolve(within: bool):
    """All repeats with the place of the first equal unit, as rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in gather(batches, {0: (FOLLOWER, _at_self), 1: (FOLLOWER, _at_lead)}):
            known, others = found[0], found[1]
            if len(known) and len(others):
                # Units of different sizes can begin at one place; their leads are the same where the sizes are.
                keys = _at_self(known) + known["size"]
                order = np.argsort(keys, kind="stable")
                at = order[np.minimum(np.searchsorted(keys[order], _at_lead(others) + others["size"]), len(keys) - 1)]
                same = (known["doc"][at] == others["lead"]) & (known["text"][at] == others["lead_text"]) & (known["at"][at] == others["lead_at"]) & (known["size"][at] == others["size"])
                others = others.copy()
                for name in ("lead", "lead_text", "lead_at"):
                    others[name][same] = known[name][at][same]
            for part in (known, others):
                yield from as_rows(part if within else part[part["doc"] != part["lead"]], 0)

    return run


def _row_key(x: np.ndarray) -> np.ndarray:
    return x["doc"].astype(U) ^ mix(x["text"].astype(U))


def _shift(x: np.ndarray) -> np.ndarray:
    return x["at"].astype(np.int64) - x["lead_at"].astype(np.int64)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    changed = np.zeros(len(columns[0]), bool)
    changed[:1] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return changed


def runs(x: np.ndarray, least: int) -> np.ndarray:
    """Spans (as followers: size bytes from at on stand at the lead's place) of units with their sources, without those within another span of the row."""
    if not len(x):
        return x
    x = x[np.lexsort((x["at"], _shift(x), x["lead_text"], x["lead"], x["text"], x["doc"]))]
    new = _new(x["doc"], x["text"], x["lead"], x["lead_text"], _shift(x))
    # Sources lie behind each other on one line; units that touch run on.
    at = x["at"].astype(np.int64) + (np.cumsum(new) << 33)
    end = np.maximum.accumulate(at + x["size"])
    start = np.flatnonzero(np.concatenate(([True], at[1:] > end[:-1])))
    size = end[np.concatenate((start[1:], [len(x)])) - 1] - at[start]
    out = x[start]
    out["size"] = size
    out = out[size >= least]
    out = out[np.lexsort((out["lead_at"], out["lead_text"], out["lead"], -out["size"].astype(np.int64), out["at"], out["text"], out["doc"]))]
    row = np.cumsum(_new(out["doc"], out["text"])).astype(np.int64) << 33
    end = np.maximum.accumulate(row + out["at"] + out["size"]) if len(out) else row
    inside = np.zeros(len(out), bool)
    inside[1:] = (row + out["at"] + out["size"])[1:] <= end[:-1]
    return out[~inside]


def lookups(x: np.ndarray, span: np.ndarray) -> np.ndarray:
    """What to ask for the units of spans with several sources; x is sorted by row and place, span numbers its spans from 0."""
    code = np.unique(np.stack((span, x["lead"], x["lead_text"], _shift(x))), axis=1, return_inverse=True)[1].reshape(-1)
    one = np.unique(code, return_index=True)[1]  # a unit of each source
    # Sources of the runs before and behind, and the two most frequent ones, of the same span.
    run = np.cumsum(_new(span, code)) - 1
    head = np.flatnonzero(_new(run))
    tried = []
    for step in (-1, 1):
        to = np.clip(np.arange(len(head)) + step, 0, len(head) - 1)
        tried.append(np.where(span[head[to]] == span[head], code[head[to]], code[head])[run])
    count = np.bincount(code)
    order = np.lexsort((np.arange(len(one)), -count, span[one]))
    first = np.flatnonzero(_new(span[one][order]))
    most, second = order[first], order[np.minimum(first + 1, len(order) - 1)]
    tried += [most[span], np.where(span[one[second]] == span[one[most]], second, most)[span]]
    unit = np.tile(np.arange(len(x)), len(tried))
    ask = np.concatenate(tried)
    pairs = np.unique(np.stack((unit, ask))[:, ask != code[unit]], axis=1)
    unit, source = pairs[0], x[one[pairs[1]]]
    place = x["at"][unit].astype(np.int64) - _shift(source)
    good = (place >= 0) & (place < 1 << 32)
    out = np.empty(int(good.sum()), LOOKUP)
    for name in FOLLOWER.names:
        out[name] = x[name][unit][good]
    out["in_doc"], out["in_text"], out["in_at"] = source["lead"][good], source["lead_text"][good], place[good]
    return out


def _asked(x: np.ndarray) -> np.ndarray:
    return _place(x["in_doc"], x["in_text"], x["in_at"])


def _ask(least: int):
    """Kind 0: spans of overlapping units that have one source.  Kind 1: units of those with several.  Kind 2: lookups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in gather(batches, {0: (FOLLOWER, _row_key)}):
            x = found[0]
            if not len(x):
                continue
            x = x[np.lexsort((x["size"], x["at"], x["text"], x["doc"]))]
            x = x[_new(*(x[n] for n in FOLLOWER.names))]  # rows that repeat
            at = x["at"].astype(np.int64) + (np.cumsum(_new(x["doc"], x["text"])) << 33)
            end = np.maximum.accumulate(at + x["size"])
            new = np.concatenate(([True], at[1:] > end[:-1]))
            start, span = np.flatnonzero(new), np.cumsum(new) - 1
            size = end[np.concatenate((start[1:], [len(x)])) - 1] - at[start]
            mixed = np.zeros(len(start), bool)
            mixed[span[1:][(~new[1:]) & ((x["lead"][1:] != x["lead"][:-1]) | (x["lead_text"][1:] != x["lead_text"][:-1]) | (_shift(x)[1:] != _shift(x)[:-1]))]] = True
            one = x[(~mixed & (size >= least))[span]]
            yield from as_rows(runs(one, least), 0)
            pick = (mixed & (size >= least))[span]
            if pick.any():
                part = x[pick]
                yield from as_rows(part, 1)
                yield from as_rows(lookups(part, np.cumsum(_new(span[pick])) - 1), 2)

    return run


def _answer(buckets: int):
    """For every lookup that finds its unit, the unit with that place as its source, by row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Deal(buckets, FOLLOWER, 1)
        for found in gather(batches, {0: (FOLLOWER, _at_self), 2: (LOOKUP, _asked)}):
            x, ask = found[0], found[2]
            if not len(x) or not len(ask):
                continue
            keys = _at_self(x) + x["size"]
            order = np.argsort(keys, kind="stable")
            at = order[np.minimum(np.searchsorted(keys[order], _asked(ask) + ask["size"]), len(keys) - 1)]
            same = (x["doc"][at] == ask["in_doc"]) & (x["text"][at] == ask["in_text"]) & (x["at"][at] == ask["in_at"])
            for name in ("size", "lead", "lead_text", "lead_at"):
                same &= x[name][at] == ask[name]
            made = np.empty(int(same.sum()), FOLLOWER)
            for name in ("doc", "text", "at", "size"):
                made[name] = ask[name][same]
            made["lead"], made["lead_text"], made["lead_at"] = ask["in_doc"][same], ask["in_text"][same], ask["in_at"][same]
            yield from out.add(_row_key(made), made)
        yield from out.flush()

    return run


def _spans(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in gather(batches, {1: (FOLLOWER, _row_key)}):
            yield from as_rows(runs(found[1], least), 0)

    return run


@guarded
def repeated_spans(docs: DataFrame, least: int = MIN_SPAN, within: bool = True) -> DataFrame:
    """doc_id, start and n_bytes of each repeated span (in bytes of UTF-8), first_doc_id, text_hash, first_start.

    The bytes of a span stand in an earlier place too: in a row of first_doc_id (maybe of doc_id itself, unless
    within is false: then only repeats across documents count), from first_start on.
    Spans of one text can overlap where their sources differ, but none lies within another.
    text_hash (xxhash64 of the text) tells the rows of one doc_id apart.  Only doc_id and
    text are read; null and empty texts have no spans; rows without doc_id take no part;
    rows that repeat a doc_id and text are one occurrence; of rows with one doc_id and
    different texts the one with the lesser text_hash comes first.
    """
    tables = Tables()
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    buckets = buckets_for(docs, "text", 2.0)
    packed = lambda df, fn: df.mapInArrow(lean(fn), PACKED)
    dealt = deal_out(packed(rows, _deal_units(buckets, least)), buckets)
    found = deal_out(packed(dealt, _find_repeats(buckets)), buckets)
    repeats = tables.write(found.mapInArrow(lean(_resolve(within)), ROWS))
    asked = tables.write(deal_out(packed(repeats, _deal_rows(buckets, 0, _row_key, FOLLOWER)), buckets).mapInArrow(lean(_ask(least)), ROWS))
    lookup = asked.where("kind = 2")
    # Only repeats of the rows that are asked move again: a bitmap of at most 64 MB picks them.
    row = lambda doc, text: F.xxhash64(doc, text).alias("row")
    bitmap = id_bitmap(lookup.select(row("in_doc", "in_text")).distinct(), "row")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    there = lambda batch: in_bitmap(shared.value, batch.column("row").to_numpy())
    wanted = repeats.withColumn("row", row("doc", "text"))
    # By place, so that the units of a row that many ask are spread.
    asking = packed(wanted, _deal_rows(buckets, 0, _at_self, FOLLOWER, there)).unionByName(packed(lookup, _deal_rows(buckets, 2, _asked, LOOKUP)))
    answers = packed(deal_out(asking, buckets), _answer(buckets))
    again = packed(asked.where("kind = 1"), _deal_rows(buckets, 1, _row_key, FOLLOWER)).unionByName(answers)
    several = deal_out(again, buckets).mapInArrow(lean(_spans(least)), ROWS)
    spans = asked.where("kind = 0").unionByName(several)
    return tables.close(spans.select(F.col("doc").alias("doc_id"), F.col("at").alias("start"), F.col("size").alias("n_bytes"), F.col("lead").alias("first_doc_id"), F.col("text").alias("text_hash"), F.col("lead_at").alias("first_start")))


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if gone and text:
                raw, at, kept = text.encode(), 0, []
                for span in sorted(gone, key=lambda s: s["start"]):
                    kept.append(raw[at : max(at, span["start"])])
                    at = max(at, span["start"] + span["n_bytes"])
                text = b"".join([*kept, raw[at:]]).decode()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def dedup_substrings(docs: DataFrame, least: int = MIN_SPAN) -> DataFrame:
    """doc_id, text without its repeated spans; a row for every row of docs.

    Null and empty texts and the texts of rows without doc_id stay as they are; a text may
    become empty; rows that repeat a doc_id and text lose the same spans, those with
    another text their own.  Other columns of docs are ignored.
    """
    gone = repeated_spans(docs, least).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n_bytes")).alias("gone"))
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").withColumn("text_hash", F.xxhash64("text"))
    return rows.join(gone.hint("shuffle_hash"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "gone").mapInArrow(lean(_without), "doc_id bigint, text string")
