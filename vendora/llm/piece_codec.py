"""SentencePiece BPE encoding and decoding by a table of last tokens.

For every prefix of a segment there is exactly one token that can come last in its
BPE encoding.  The table of these tokens is filled from left to right: the tokens
that end at a position are the matches of an Aho-Corasick automaton over the pieces,
and the one to store is the match whose predecessor (the last token of the prefix
before it) is compatible with it, that is, no merge of higher priority crosses their
border.  Reading the table from the end gives the ids.

A segment starts at a run of word marks, or is the text between line feeds, where no
piece can reach across (checked against the vocabulary when it is loaded); encodings
of segments are memoised in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vendora.llm.store import kept, lean

MARK = "▁"
#: Segments remembered by a worker.
MEMO_LIMIT = 150_000
_LEAST = -1


#: Texts that a model's normaliser, if it has one, would change, or that tell whether a mark is put in front.
PROBES = ("", " ", "a", " a ", "a  b", "ﬁ ½ Ａ", "e\u0301", "\t\n\u00a0\u3000x", "A\u200bB", "\x00 \x7f", "İß")


class PieceModel:
    """Ranks, splits and the automaton of a BPE model with byte fallback; built from the model file's bytes."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.end_id, self.unknown_id = sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id, self.byte_of, self.silent = {}, {}, set()
        normal = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif sp.is_control(i):
                self.silent.add(i)
            elif not sp.is_unknown(i):
                if sp.is_unused(i):
                    raise ValueError("models with unused pieces are not supported")
                normal.append(i)
        merged = sorted((i for i in normal if len(self.pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        letters = sorted({c for i in normal for c in self.pieces[i]})
        # Ranks: letters first (they need no merge), then pieces in the order BPE prefers them.
        self.text = letters + [self.pieces[i] for i in merged]
        self.rank = {t: r for r, t in enumerate(self.text)}
        ids = {self.pieces[i]: i for i in normal}
        self.ids = [ids.get(t) for t in self.text]
        self.first_merged = len(letters)
        self.split: list[tuple[int, int]] = [(r, r) for r in range(len(letters))]
        for r in range(len(letters), len(self.text)):
            self.split.append(self._parts(self.text[r], r))
        self.made = [x[0] != _LEAST for x in self.split]
        self.spoken = [p.replace(MARK, " ") for p in self.pieces]
        for i in self.silent:
            self.spoken[i] = ""
        reach = [t for t in self.text if re.search(f"[^{MARK}]{MARK}", t) or ("\n" in t and t != "\n")]
        self.by_segment = not reach
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t, (r, len(t)))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        for text in PROBES:
            if [i for s in self.segments(text) for i in self.tokens(s)] != sp.encode(text):
                raise ValueError("models with a normaliser, or without a mark in front, are not supported")

    def _parts(self, text: str, below: int) -> tuple[int, int]:
        """The two tokens whose merge is the last one when BPE makes this piece."""
        parts = list(text)
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, below) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best >= below:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2:
            return (_LEAST, _LEAST)  # BPE never makes it
        return self.rank[parts[0]], self.rank[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE can leave these two tokens side by side.

        Undoes the later merge of the two sides again and again; they don't fit if a
        merge across the border would have come before the merge undone last.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        a, b, limit, out = left, right, len(self.text), True
        rank, text, split, letters = self.rank, self.text, self.split, self.first_merged
        while True:
            crossing = rank.get(text[a] + text[b])
            if crossing is not None and crossing < limit:
                out = False
                break
            if a < letters and b < letters:
                break
            # Of equal merges BPE makes the leftmost first, so at equal ranks the right side is the later one.
            if a > b:
                limit, a = a, split[a][1]
            else:
                limit, b = b + 1, split[b][0]
        if len(self._fits) > 500_000:
            self._fits.clear()
        self._fits[left, right] = out
        return out

    def tokens(self, segment: str) -> list[int]:
        """Ids of a segment."""
        n = len(segment)
        last = [_LEAST] * (n + 1)  # rank of the last token of each prefix, or _LEAST for a letter outside the vocabulary
        width = [0] * (n + 1)
        known, fits, made = self._fits, self.fits, self.made
        for at, (rank, size) in self.automaton.iter(segment):  # at each end the longest match comes first
            at += 1
            if width[at] or not made[rank]:
                continue
            before = last[at - size]
            if before != _LEAST:
                good = known.get((before, rank))
                if not (fits(before, rank) if good is None else good):
                    continue
            last[at], width[at] = rank, size
        out: list[int] = []
        while n:
            rank = last[n]
            piece = self.ids[rank] if rank != _LEAST else None
            if piece is None:
                out.extend(self.byte_id.get(x, self.unknown_id) for x in reversed(segment[n - (width[n] or 1) : n].encode()))
            else:
                out.append(piece)
            n -= width[n] or 1
        out.reverse()
        return out

    def segments(self, text: str) -> list[str]:
        """Segments of a text after the word mark is put in front and for each space."""
        if not text:
            return []
        if not self.by_segment:
            return [MARK + text.replace(" ", MARK)]
        if text[0] != " " and "  " not in text and MARK not in text:
            return [MARK + w for w in text.split(" ")]
        return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: bytes are joined, marks become spaces, the first one is dropped."""
        text = self.decode_part(ids)
        return text[1:] if text.startswith(" ") else text

    def decode_part(self, ids: Iterable[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            out.append(self.spoken[i])
        if held:
            out.append(held.decode(errors="replace"))
        return "".join(out)


class _Memo(dict):
    """Segment -> its ids as decimal text, and what they decode to.

    Two generations: when the young one is full it becomes the old one, so frequent
    segments survive and at most 2 * MEMO_LIMIT are held.
    """

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.old: dict[str, tuple[str, str]] = {}

    def __missing__(self, segment: str) -> tuple[str, str]:
        out = self.old.get(segment)
        if out is None:
            if "\n" in segment and segment != "\n" and self.model.by_segment:
                parts = [self[s] for s in re.findall(r"\n|[^\n]+", segment)]
                return " ".join([p[0] for p in parts]), "".join([p[1] for p in parts])
            ids = self.model.tokens(segment)
            out = " ".join(map(str, ids)), self.model.decode_part(ids)
            if len(segment) > 48:
                return out
        if len(self) >= MEMO_LIMIT:
            self.old = dict(self)
            self.clear()
        self[segment] = out
        return out


class Codec:
    """Encoder and decoder of whole texts with memoised segments."""

    def __init__(self, model: bytes):
        self.model = PieceModel(model)
        self.memo = _Memo(self.model)

    def encode_parts(self, text: str | None) -> list[tuple[str, str]]:
        memo = self.memo
        return [memo[s] for s in self.model.segments(text or "")]

    def encode(self, text: str | None) -> list[int]:
        """Ids with the end id."""
        return [int(x) for part, _ in self.encode_parts(text) for x in part.split()] + [self.model.end_id]

    def round_trip(self, text: str | None) -> tuple[str, str]:
        """Ids as decimal text, and the text that they decode to."""
        parts = self.encode_parts(text)
        said = "".join([p[1] for p in parts])
        return " ".join([p[0] for p in parts] + [str(self.model.end_id)]), said[1:] if said.startswith(" ") else said


def codec(model: bytes) -> Codec:
    """One codec for each model and task."""
    return kept(f"codec {hashlib.sha256(model).hexdigest()}", lambda: Codec(model))


def _each(fn, schema: pa.Schema):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 500
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays(fn(part), schema=schema)

    return over


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, round_trip (whether decoding gives the text back).

    The end id comes last; a null or empty text has only that.  Repeated rows give repeated
    rows; other columns of docs are ignored.  A model that isn't BPE without normaliser and
    with a mark in front is an error.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(part: pa.RecordBatch) -> list:
        own = codec(model)
        numbers, same = [], []
        for text in part.column(1):
            text = text.as_py() or ""
            ids, back = own.round_trip(text)
            numbers.append(np.fromstring(ids, np.int32, sep=" "))
            same.append(back == text)
        sizes = [len(x) for x in numbers]
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(numbers or [np.empty(0, np.int32)]))), pa.array(same, pa.bool_())]

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(lean(_each(run, schema), "piece_codec", keep=False), "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text from doc_id, ids; null or empty ids give an empty text, ids beyond the vocabulary are an error."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(part: pa.RecordBatch) -> list:
        own = codec(model).model
        return [part.column(0), pa.array([own.decode(x or ()) for x in part.column(1).to_pylist()], pa.string())]

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "cast(ids as array<int>) ids").mapInArrow(lean(_each(run, schema), "piece_codec", keep=False), "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip (whether the text came back).

    One narrow pass; nothing is shuffled.  Null and empty texts encode to the end id
    alone.  Repeated rows give repeated rows; other columns of docs are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(part: pa.RecordBatch) -> list:
        own = codec(model)
        counts, ids, said, same = [], [], [], []
        for text in part.column(1):
            text = text.as_py() or ""
            numbers, back = own.round_trip(text)
            counts.append(numbers.count(" ") + 1)
            ids.append(hashlib.sha256(numbers.encode()).hexdigest())
            said.append(hashlib.sha256(back.encode()).hexdigest())
            same.append(back == text)
        return [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string()), pa.array(same, pa.bool_())]

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(lean(_each(run, schema), "piece_codec", keep=False), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
