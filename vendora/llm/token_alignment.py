"""Cross-tokenizer alignment of a byte-level BPE (A) and a SentencePiece BPE (B).

Both tokenizers cut the same bytes, a space and the text.  The tokens of B, in order, are a
static index of intervals; every token of A is a stabbing query answered by two binary searches
(the first B token that ends behind its start, the last that starts before its end), which give
the B tokens that it overlaps.  Gaps between B tokens that no A token spans are the group
boundaries: both tokenizers have a token end there.

Texts are cut into chunks where white space that begins with a space or line feed follows a
solid character: neither tokenizer has a token across such a place, so chunks are tokenised
and aligned by themselves, those of many texts at once on one byte axis, and short ones are
remembered in a table of bounded size.

Pair counts of the corpus come from counts of short chunks, which are summed before each different one is
tokenised once, and from long chunks directly.  The second pass looks counts up in slices
of at most about SLICE pairs, broadcast one at a time; with more pairs than one slice holds,
a pass for each slice adds what it knows and is written, so memory doesn't grow with the corpus.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.piece_codec import MARK, PieceModel
from vendora.llm.store import kept, lean
from vendora.plans.checkpoints import Tables, guarded

#: Short chunks are counted and remembered; a worker remembers at most twice MEMO.
SHORT, MEMO = 48, 160_000
SLICE = 4_000_000
#: Characters of texts that are worked on at a time (or one text).
STEP_CHARS = 2 << 20
#: So many chunks are tokenised as one text, which begins with FIRST.
TOGETHER, FIRST = 64, " a"
#: A solid character (not one that any engine counts as white space), then white space that begins with a space or line feed.
_OPEN = re.compile("[\\s\\u180e\\u200b-\\u200d\\u2060\\ufeff]")
_CUT = re.compile("(?<=[^\\s\\u180e\\u200b-\\u200d\\u2060\\ufeff])(?=[ \\n])")


def byte_characters() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenizerPair:
    """Tokenizer A (bytes of a byte-level BPE json file) and B (bytes of a SentencePiece BPE model)."""

    def __init__(self, byte_json: bytes, piece_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json.decode())
        self.a.encode_special_tokens = True
        of = byte_characters()
        size = self.a.get_vocab_size()
        added = set(self.a.get_added_tokens_decoder())
        self.a_bytes = [b"" if i in added else bytes(of[c] for c in self.a.id_to_token(i)) for i in range(size)]
        self.model = PieceModel(piece_model)  # refuses models with a normaliser
        if not self.model.by_segment or len(self.model.byte_id) != 256:
            raise ValueError("a piece reaches across white space, or bytes lack a piece")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.b_bytes = [p.replace(MARK, " ").encode() for p in self.model.pieces]
        for i, byte in self.model.byte_of.items():
            self.b_bytes[i] = bytes([byte])
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.width = len(self.b_bytes)
        named = lambda n, new: [x for i in range(n) for x in (f",{i}", f"{new}{i}")]
        self.names, self.b_names = np.array(named(size, ";") + named(self.width, "|"), dtype=object), 2 * size

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of chunks one after another, and the place of each chunk's first token in both (len + 1).

        Chunks are joined to texts of TOGETHER, which cuts in the same places as long as each ends with a solid
        character; a text begins with FIRST, whose tokens are left out, as B puts a mark in front.
        """
        texts, number = [], []
        held: list[str] = []
        for chunk in chunks:
            held.append(chunk)
            if len(held) >= TOGETHER or len(chunk) > 4096 or _OPEN.match(chunk[-1]):
                texts.append(FIRST + "".join(held))
                number.append(len(held))
                held = []
        if held:
            texts.append(FIRST + "".join(held))
            number.append(len(held))
        a = np.array([i for e in self.a.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int64)
        b = np.array([i for ids in self.b.encode([t[1:] for t in texts], num_threads=1) for i in ids], np.int64)
        said = "".join(texts).encode()
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != said or b"".join([self.b_bytes[i] for i in b.tolist()]) != said:
            raise ValueError("tokens don't give the text back")
        # On the axis of all bytes: chunks, and FIRST before the first one of each text.
        sizes = np.array([len(c) if c.isascii() else len(c.encode()) for c in chunks], np.int64)
        lead = np.zeros(len(chunks), np.int64)
        lead[np.concatenate(([0], np.cumsum(number)[:-1])).astype(np.int64)] = len(FIRST)
        ends = np.cumsum(sizes + lead)

        def own(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            start = np.cumsum(size[ids]) - size[ids]
            at = np.searchsorted(ends, start, "right")
            inside = start >= (ends - sizes)[at]
            return ids[inside], np.concatenate(([0], np.cumsum(np.bincount(at[inside], minlength=len(chunks))))).astype(np.int64)

        (a, a_first), (b, b_first) = own(a, self.a_size), own(b, self.b_size)
        return a, b, a_first, b_first


def pair_of(byte_json: bytes, piece_model: bytes) -> TokenizerPair:
    """One pair for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(f"pair {hashlib.sha256(byte_json).hexdigest()} {hashlib.sha256(piece_model).hexdigest()}", lambda: TokenizerPair(byte_json, piece_model))


def chunks_of(text: str | None) -> list[str]:
    """Chunks of a space and the text; none of a text that has no tokens (null, empty, or with a literal word mark, which B reads as a space)."""
    return [] if not text or MARK in text else _CUT.split(" " + text)


@dataclass
class Aligned:
    """Alignments of some chunks, one after another: ids, first token and group of each chunk, links as pairs of token places."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray
    link_first: np.ndarray


def overlaps(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of A, the first and the end of the B tokens that each overlaps; for tokens of both, their group's number.

    Sizes are bytes, all positive; both sequences cover the same bytes.
    """
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    first = np.searchsorted(b_end, a_end - a_size, "right")
    end = np.searchsorted(b_end - b_size, a_end, "left")
    # Gap i lies before B token i: an A token over first .. end - 1 spans the gaps first + 1 .. end - 1.
    spans = np.bincount(first + 1, minlength=len(b_size) + 1)[: len(b_size) + 1] - np.bincount(end, minlength=len(b_size) + 1)[: len(b_size) + 1]
    free = np.cumsum(spans)[: len(b_size)] == 0
    b_group = np.cumsum(free) - 1
    return first, end, b_group[first] if len(first) else first, b_group


def align(pair: TokenizerPair, chunks: list[str]) -> Aligned:
    a, b, a_first, b_first = pair.encode(chunks)
    first, end, a_group, b_group = overlaps(pair.a_size[a], pair.b_size[b])
    number = end - first
    links_a = np.repeat(np.arange(len(a)), number)
    before = np.concatenate(([0], np.cumsum(number))).astype(np.int64)
    links_b = first[links_a] + np.arange(len(links_a)) - before[:-1][links_a] if len(links_a) else links_a
    return Aligned(a, b, a_first, b_first, a_group, b_group, links_a, links_b, before[a_first])


class Slice:
    """Counts of some pairs, by key (A id * width + B id) in order, and whether each is its B id's highest."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, best: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts, self.best = keys[order], counts[order], best[order]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if it isn't in this slice) of each key, and 1 where that is the B id's highest."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        return np.where(here, self.counts[at], 0), (here & self.best[at]).astype(np.int64)


def measured(pair: TokenizerPair, table: Slice, chunks: list[str]) -> list[tuple[str, int, int, int, int, int, int]]:
    """(groups as text, n_a, n_b, n_groups, n_links, n_best, count_sum) of each chunk."""
    x = align(pair, chunks)
    count, best = table.of(x.a[x.links_a] * pair.width + x.b[x.links_b])
    total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[x.link_first]).tolist()
    # A group's tokens, A's before B's, each with what stands before it: ; for a new group, | before B's first, else a comma.
    names = np.concatenate((2 * x.a + (np.diff(x.a_group, prepend=-1) > 0), pair.b_names + 2 * x.b + (np.diff(x.b_group, prepend=-1) > 0)))
    order = np.argsort(np.concatenate((2 * x.a_group, 2 * x.b_group + 1)), kind="stable")
    names = pair.names[names[order]].tolist()
    bounds = (x.a_first + x.b_first).tolist()
    groups = np.diff(np.concatenate((x.b_group, [x.b_group[-1] + 1 if len(x.b_group) else 0]))[x.b_first]).tolist()
    texts = ["".join(names[i:j])[1:] for i, j in zip(bounds, bounds[1:], strict=False)]
    return list(zip(texts, np.diff(x.a_first).tolist(), np.diff(x.b_first).tolist(), groups, np.diff(x.link_first).tolist(), total(best), total(count), strict=True))


class Memo:
    """What is known of short chunks, in two generations of at most MEMO."""

    def __init__(self, pair: TokenizerPair, table: Slice):
        self.pair, self.table = pair, table
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def learn(self, lists: list[list[str]]) -> dict[str, tuple]:
        """Results of all chunks of some texts."""
        found, young, old, new = {}, self.young, self.old, []
        for chunk in set().union(*lists):
            known = young.get(chunk)
            if known is None:
                known = old.get(chunk)
                if known is None:
                    new.append(chunk)
                    continue
                self._keep(chunk, known)
                young = self.young
            found[chunk] = known
        for at in range(0, len(new), 20_000):
            for chunk, known in zip(new[at : at + 20_000], measured(self.pair, self.table, new[at : at + 20_000]), strict=True):
                found[chunk] = known
                if len(chunk) <= SHORT:
                    self._keep(chunk, known)
        return found

    def _keep(self, chunk: str, known: tuple) -> None:
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        self.young[chunk] = known


def _steps(texts: Iterable[str | None]) -> Iterator[list[list[str]]]:
    """Chunks of texts, STEP_CHARS of them at a time or one text."""
    held, size = [], 0
    for text in texts:
        held.append(chunks_of(text))
        size += len(text or "")
        if size >= STEP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


@guarded
def pair_counts(docs: DataFrame, byte_json: bytes, piece_model: bytes) -> DataFrame:
    """key (A id * number of B's pieces + B id), n: how many links of all texts have the pair; see alignment_digests for texts without tokens."""

    def pairs(pair: TokenizerPair, chunks: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = align(pair, chunks)
        keys, place = np.unique(x.a[x.links_a] * pair.width + x.b[x.links_b], return_inverse=True)
        weight = np.repeat(times, np.diff(x.link_first))
        out = np.zeros(len(keys), np.int64)
        np.add.at(out, place, weight)
        return keys, out

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(byte_json, piece_model)
        for batch in batches:
            counts: Counter[str] = Counter()
            for lists in _steps(t.as_py() for t in batch.column(0)):
                for chunks in lists:
                    counts.update(chunks)
                for chunk in [c for c in counts if len(c) > SHORT]:
                    keys, n = pairs(pair, [chunk], np.array([counts.pop(chunk)]))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys), pa.array(n)], ["chunk", "key", "n"])
                if len(counts) > 400_000:
                    yield from said(counts)
            yield from said(counts)

    def said(counts: Counter) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.nulls(len(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["chunk", "key", "n"])
        counts.clear()

    def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(byte_json, piece_model)
        for batch in batches:
            if batch.num_rows:
                keys, n = pairs(pair, batch.column(0).to_pylist(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    tables = Tables()
    counted = tables.write(docs.selectExpr("cast(text as string) text").mapInArrow(lean(count, "token_alignment"), "chunk string, key bigint, n bigint"))
    short = counted.where("chunk is not null").groupBy("chunk").agg(F.sum("n").alias("n")).mapInArrow(lean(resolve, "token_alignment"), "key bigint, n bigint")
    every = short.unionByName(counted.where("chunk is null").select("key", "n"))
    return tables.close(every.groupBy("key").agg(F.sum("n").alias("n")))


@guarded
def alignment_digests(docs: DataFrame, byte_json: bytes, piece_model: bytes, slice_pairs: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    groups_sha256 is the digest of `a1,a2|b1;a3|b2,b3`, the decimal ids of A and B in groups.
    Texts that are null, empty or hold a literal word mark (U+2581, which B reads as a space, so its
    bytes aren't the text's) have no tokens: zeros, and an empty string for the digest.
    Strings of special tokens in a text are plain text.  Rows that repeat count each time; other
    columns of docs are ignored; an empty table gives no rows.
    """
    tables = Tables()
    width = len(PieceModel(piece_model).pieces)
    counts = tables.own(pair_counts(docs, byte_json, piece_model)).withColumn("b", F.col("key") % width)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    pairs = tables.write(counts.join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best")))
    number = max(1, -(-pairs.count() // slice_pairs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"))
    for k in range(number):
        part = pairs.where(F.pmod(F.xxhash64("key"), F.lit(number)) == k).toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(Slice(part.column("key").to_numpy(), part.column("n").to_numpy(), part.column("best").to_numpy()))
        last = k == number - 1
        rows = rows.mapInArrow(lean(_add(byte_json, piece_model, shared, last), "token_alignment"), _RESULT if last else rows.schema)
        rows = rows if last else tables.write(rows)
    return tables.close(rows)


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _add(byte_json: bytes, piece_model: bytes, shared, last: bool):
    """For mapInArrow: n_best and count_sum of rows with what a slice knows of them; with the last one the rest of the result instead of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept("memo", dict)  # of this slice only; what another one left goes
        if held.get("run") != name:
            held.clear()
            held |= {"run": name, "memo": Memo(pair_of(byte_json, piece_model), shared.value)}
        memo = held["memo"]
        for batch in batches:
            out: list[tuple] = []
            for lists in _steps(t.as_py() for t in batch.column(1)):
                known = memo.learn(lists)
                for chunks in lists:
                    if not chunks:
                        out.append(("", 0, 0, 0, 0, 0, 0))
                        continue
                    texts, *numbers = zip(*[known[c] for c in chunks], strict=True)
                    out.append((hashlib.sha256(";".join(texts).encode()).hexdigest() if last else "", *map(sum, numbers)))
            digests, n_a, n_b, n_groups, n_links, n_best, count_sum = zip(*out, strict=True) if out else ((),) * 7
            longs = lambda v: pa.array(v, pa.int64())
            n_best = longs(np.array(n_best, np.int64) + batch.column(2).to_numpy())
            count_sum = longs(np.array(count_sum, np.int64) + batch.column(3).to_numpy())
            if last:
                columns = [batch.column(0), longs(n_a), longs(n_b), longs(n_groups), longs(n_links), n_best, count_sum, pa.array(digests, pa.string())]
            else:
                columns = [batch.column(0), batch.column(1), n_best, count_sum]
            yield pa.RecordBatch.from_arrays(columns, names)

    name = uuid.uuid4().hex
    names = [x.split()[0] for x in _RESULT.split(", ")] if last else ["doc_id", "text", "n_best", "count_sum"]
    return run


def align_documents(docs: DataFrame, byte_json: bytes, piece_model: bytes) -> DataFrame:
    """doc_id, groups array<struct<start bigint, a array<int>, b array<int>>>: the groups of each text, start in bytes of space+text; empty for texts without tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(pa.struct([("start", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(byte_json, piece_model)
        for batch in batches:
            for row in range(batch.num_rows):
                chunks = chunks_of(batch.column(1)[row].as_py())
                groups: list[dict] = []
                if chunks:
                    x = align(pair, chunks)
                    at = np.concatenate(([0], np.cumsum(pair.a_size[x.a])))
                    firsts = np.flatnonzero(np.diff(x.a_group, prepend=-1) > 0)
                    a_cuts, b_cuts = [*firsts.tolist(), len(x.a)], [*np.flatnonzero(np.diff(x.b_group, prepend=-1) > 0).tolist(), len(x.b)]
                    a, b = x.a.tolist(), x.b.tolist()
                    groups = [{"start": int(at[a_cuts[i]]), "a": a[a_cuts[i] : a_cuts[i + 1]], "b": b[b_cuts[i] : b_cuts[i + 1]]} for i in range(len(firsts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([groups], schema.field(1).type)], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(lean(run, "token_alignment"), "doc_id bigint, groups array<struct<start: bigint, a: array<int>, b: array<int>>>")
