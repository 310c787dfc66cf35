"""Benchmark decontamination by BM25 and block-max WAND.

Test items form an inverted index; passages of the documents are the queries.  A
posting's BM25 weight is divided by its item's total weight, so a score is the share of
an item's weight that a passage covers, and one threshold serves all items.

Items are classed by length: a class holds items of up to 16, 32, 64, ... words, and has
an index and passages of its own, windows of twice that length that overlap by half.  So
an item lies whole in a passage of its class, and whether it is found doesn't depend on
which other items there are.  For each passage a bound on its best score comes
first, for whole batches of text at once: terms so common that together they give no
item more than half the threshold count nothing, and the weights of the other terms
must reach the rest, at first summed over all words and then for one item.  Passages
that pass are run through block-max WAND, which returns every item at or above the
threshold.  Each hit is verified on n-grams: the passage must hold shares
of the item's question and of its answer (its last sentence).

The index is sent to the executors in shards of about SHARD_BYTES of item text (and at
most one item more); each shard is one pass over the documents.  Document frequencies are
those of all items.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.kernel import U, runs_of_sorted, shingle_hashes, words
from vendora.llm.store import lean
from vendora.plans.checkpoints import discard, materialize

K1, B = 1.2, 0.75
#: Share of an item's BM25 weight that a passage must cover to be verified.
THRESHOLD = 0.5
NGRAM = 5
#: Shares of the n-grams of question and answer that a leak must hold.
QUESTION_SHARE = ANSWER_SHARE = 0.5
SHARD_BYTES = 8 << 20
#: Words of the items of the first class; each further class has items of up to twice as many.
LEAST_CLASS = 16
BLOCK = 16
_LAST_SENTENCE = re.compile(r"^(.*[.!?]\s+)(\S.*)$", re.S)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; an item of one sentence is all question."""
    found = _LAST_SENTENCE.match(text.rstrip())
    return (found[1], found[2]) if found else (text, "")


def hashed_words(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for row, end, hashes, firsts, _, _ in words(pa.array(texts, pa.string())):
        out.extend(hashes[firsts[i] : firsts[i + 1]] for i in range(end - row))
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(hashes, np.array([0, len(hashes)]), k)[0])


class Index:
    """Inverted index of the items of one class and shard, with normalised BM25 weights and block maxima."""

    def __init__(self, items: list[tuple[int, str]], tokens: list[np.ndarray], step: int, frequency: dict[int, int], n_items: int, mean_size: float):
        self.ids = [i for i, _ in items]
        self.step = step
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, w in enumerate(tokens):
            terms, counts = np.unique(w, return_counts=True)
            weights = []
            for t, n in zip(terms.tolist(), counts.tolist(), strict=True):
                df = frequency.get(t, 1)
                idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
                weights.append(idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean_size)))
            total = sum(weights)
            for t, x in zip(terms.tolist(), weights, strict=True):
                postings[t].append((i, x / total))
        self.terms = np.array(sorted(postings), U)
        self.lists = [([i for i, _ in postings[t]], [x for _, x in postings[t]]) for t in self.terms.tolist()]
        self.bounds = np.array([max(x) for _, x in self.lists] + [0.0])
        self.blocks = [[max(x[b : b + BLOCK]) for b in range(0, len(x), BLOCK)] for _, x in self.lists]
        # Common terms, the longest lists first, as long as they give no item more than half the threshold.
        common = np.zeros(len(items))
        self.bound_of = self.bounds.copy()
        self.left_out = 0.0
        for t in sorted(range(len(self.lists)), key=lambda t: (-len(self.lists[t][0]), t)):
            ids, x = self.lists[t]
            after = common[ids] + x
            if after.max() <= THRESHOLD / 2:
                common[ids] = after
                self.bound_of[t] = 0.0
        self.left_out = float(common.max(initial=0.0))
        # Postings of the other terms, side by side.
        sizes = np.array([len(ids) if self.bound_of[t] else 0 for t, (ids, _) in enumerate(self.lists)] + [0], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        own = [x for t, x in enumerate(self.lists) if self.bound_of[t]]
        self.items = np.array([i for ids, _ in own for i in ids], np.int64)
        self.weights = np.array([w for _, x in own for w in x])
        parts = [question_and_answer(text) for _, text in items]
        self.questions = [self._grams(w) for w in hashed_words([q for q, _ in parts])]
        self.answers = [self._grams(w) for w in hashed_words([a for _, a in parts])]

    @staticmethod
    def _grams(w: np.ndarray) -> tuple[int, np.ndarray]:
        k = max(1, min(NGRAM, len(w)))
        return k, grams(w, k)

    def term_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's term; len(terms) for words of no item."""
        if not len(self.terms):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.terms, hashes)
        at[self.terms[np.minimum(at, len(self.terms) - 1)] != hashes] = len(self.terms)
        return at

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least `least` for distinct terms, by block-max WAND."""
        eps = 1e-9
        cursors = [[self.lists[t][0][0], t, 0] for t in terms]  # item, term, place in the list
        out: list[tuple[int, float]] = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for n, (_, t, _) in enumerate(cursors):
                total += self.bounds[t]
                if total >= least - eps:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # Block maxima around the pivot's item, and the first item beyond these blocks.
            total, beyond = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for _, t, at in cursors[: pivot + 1]:
                ids = self.lists[t][0]
                block = at // BLOCK
                while (block + 1) * BLOCK < len(ids) and ids[(block + 1) * BLOCK] <= item:
                    block += 1
                total += self.blocks[t][block]
                if (block + 1) * BLOCK < len(ids):
                    beyond = min(beyond, ids[(block + 1) * BLOCK])
            if total < least - eps:
                goal = max(beyond, item + 1)
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(self.lists[t][1][at] for _, t, at in cursors[: pivot + 1])
                if score >= least - eps:
                    out.append((item, score))
                goal, moved = item + 1, cursors[: pivot + 1]
            else:
                goal, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moved:
                ids, at = self.lists[c[1]][0], c[2]
                while at < len(ids) and ids[at] < goal:
                    at += 1
                c[2] = at
                c[0] = ids[at] if at < len(ids) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def promising(self, numbers: np.ndarray, window: np.ndarray, count: int) -> np.ndarray:
        """Which of the windows (0 .. count - 1) have terms outside the common ones that could bring an item to the threshold.

        numbers: terms of words; window: the window of each.
        """
        key = np.unique(window * (len(self.terms) + 1) + numbers)
        window, term = key // (len(self.terms) + 1), key % (len(self.terms) + 1)
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        pair, place = np.unique(np.repeat(window, n) * len(self.ids) + self.items[at], return_inverse=True)
        enough = np.bincount(place, self.weights[at], len(pair)) >= THRESHOLD - self.left_out - 1e-6
        out = np.zeros(count, bool)
        out[pair[enough] // len(self.ids)] = True
        return out

    def overlap(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question and answer n-grams that the passage's words hold; of an empty part, 1."""
        made: dict[int, np.ndarray] = {}
        out = []
        for k, own in (self.questions[item], self.answers[item]):
            if k not in made:
                made[k] = grams(passage, k)
            out.append(float(np.isin(own, made[k]).mean()) if len(own) else 1.0)
        return out[0], out[1]


def length_class(words: int) -> int:
    """Greatest number of words of an item's class."""
    return max(LEAST_CLASS, 1 << (words - 1).bit_length())


def indexes(items: list[tuple[int, str]], frequency: dict[int, int], n_items: int, mean_size: float) -> list[Index]:
    """An index for each class of the items that have words."""
    classes: dict[int, tuple[list, list]] = {}
    for item, tokens in zip(items, hashed_words([t for _, t in items]), strict=True):
        if len(tokens):
            own = classes.setdefault(length_class(len(tokens)), ([], []))
            own[0].append(item)
            own[1].append(tokens)
    return [Index(*own, step, frequency, n_items, mean_size) for step, own in sorted(classes.items())]


def leaks_of(index: Index, hashes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, score, question share, answer share) of the leaks in a chunk of texts; each item's best passage."""
    numbers = index.term_numbers(hashes)
    sums = np.concatenate(([0.0], np.cumsum(index.bound_of[numbers])))
    counts = np.diff(firsts)
    windows = np.where(counts > 0, np.maximum(1, -(-counts // index.step) - 1), 0)
    row = np.repeat(np.arange(len(counts)), windows)
    number = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(windows)[:-1])), windows) if len(row) else row
    start = firsts[:-1][row] + number * index.step
    end = np.minimum(start + 2 * index.step, firsts[1:][row])
    bound = sums[end] - sums[start]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    able = np.flatnonzero(bound >= THRESHOLD - index.left_out - 1e-6)
    if len(able):
        size = end[able] - start[able]
        of = np.repeat(np.arange(len(able)), size)
        word = numbers[np.repeat(start[able] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
        useful = index.bound_of[word] > 0
        able = able[index.promising(word[useful], of[useful], len(able))]
    for w in able:
        part = numbers[start[w] : end[w]]
        terms = np.unique(part[part < len(index.terms)]).tolist()
        for item, score in index.search(terms, THRESHOLD):
            q, a = index.overlap(item, hashes[start[w] : end[w]])
            if q >= QUESTION_SHARE and a >= ANSWER_SHARE:
                key = (int(row[w]), item)
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, a))
    for (r, item), (score, q, a) in sorted(best.items()):
        yield r, item, score, q, a


def _shards(items: DataFrame) -> Iterator[list[Index]]:
    """Indexes of about SHARD_BYTES of items at a time; the driver holds one shard."""
    rows = items.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").where("item_id is not null and text is not null")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = hashed_words(batch.column(0).to_pylist())
            each = np.sort(np.concatenate([np.unique(w) for w in found] or [np.empty(0, U)]))
            starts, lengths = runs_of_sorted(each)
            yield pa.RecordBatch.from_arrays([pa.array(each[starts].view(np.int64)), pa.array(lengths.astype(np.int64)), pa.array(np.zeros(len(starts), np.int64))], ["term", "n", "words"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([sum(len(w) > 0 for w in found)], pa.int64()), pa.array([sum(map(len, found))], pa.int64())], ["term", "n", "words"])

    # Counted once, however many shards read them.
    counts = materialize(rows.select("text").mapInArrow(lean(count), "term bigint, n bigint, words bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    try:
        yield from _made(rows, counts, count)
    finally:
        discard(counts)


def _made(rows: DataFrame, counts: DataFrame, count) -> Iterator[list[Index]]:
    whole = counts.where("term is null").first()
    if whole is None or not whole.n:
        return
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0]
    shards = -(-size // SHARD_BYTES)
    for k in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        held = [(r.item_id, r.text) for r in part.orderBy("item_id", "text").toLocalIterator()]
        if shards == 1:
            frequency = {r.term & (2**64 - 1): r.n for r in counts.where("term is not null").toLocalIterator()}
        else:
            own = part.select("text").mapInArrow(lean(count), "term bigint, n bigint, words bigint").where("term is not null").select("term").distinct()
            frequency = {r.term & (2**64 - 1): r.n for r in counts.join(own, "term").toLocalIterator()}
        made = indexes(held, frequency, whole.n, whole.words / whole.n)
        if made:
            yield made


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_share, answer_share: one row for each leaked item of a document.

    Only doc_id, text, item_id and text are read.  Null and empty texts, and items
    without words, match nothing; a row without doc_id is reported with a null id;
    repeated rows, of documents and of items, are reported each.  An item's shares and
    score are those of the passage that scores best.  Documents without leaks have no row.
    """
    schema = "doc_id bigint, item_id bigint, score double, question_share double, answer_share double"
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    out = None
    for shard in _shards(items):
        shipped = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[row + r], own.ids[item], score, q, a) for row, _, hashes, firsts, _, _ in words(batch.column(1)) for own in shipped.value for r, item, score, q, a in leaks_of(own, hashes, firsts)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64() if i < 2 else pa.float64()) for i in range(5)], ["doc_id", "item_id", "score", "question_share", "answer_share"])

        part = rows.mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, with all their columns; one narrow pass for each shard of items.

    Null and empty texts stay; repeated rows stay or go alike; without items all stay.
    """
    at = docs.columns.index("text")
    for shard in _shards(items):
        shipped = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _, hashes, firsts, _, _ in words(batch.column(at)):
                    for own in shipped.value:
                        for r, *_ in leaks_of(own, hashes, firsts):
                            clean[row + r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
