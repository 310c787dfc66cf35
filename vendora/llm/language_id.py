"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile lists the PROFILE_SIZE most frequent letter n-grams (1 to 3) of a language.
A document's own most frequent n-grams are compared to each profile by the
out-of-place distance: the sum of rank differences, and PROFILE_SIZE for an n-gram
that the profile lacks.  The nearest profile wins; the score is one less its
distance as a share of the greatest possible one.

Profiles are learned from a bounded sample of labelled rows, SAMPLE_DOCS of each
language at most in expectation (chosen by a hash of doc_id, at a rate that follows
from the language's row count).  Every whole text is predicted, in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.llm.kernel import chunks, runs_of_sorted
from vendora.llm.store import lean

PROFILE_SIZE = 300
SAMPLE_DOCS = 1000
#: A document is compared by as many n-grams as this, and at least as it has.
DOCUMENT_GRAMS = 300
UNKNOWN = "und"
#: Characters of text worked on at a time.
WINDOW = 1 << 20
#: A letter's code is its code point, below this; an n-gram's code holds up to three of them.
_CODES = 1 << 20


_tables: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0; made once in a process."""
    if not _tables:
        _tables.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(_CODES)), np.int64, _CODES))
    return _tables[0]


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the lower-cased texts as code points, 0 for other characters and after each text, and offsets.

    Code points from 2**20 on (a private plane) are no letters.
    """
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\x00".join(low) + "\x00").encode("utf-32-le", "replace"), np.uint32)
    out = _letter_table()[np.minimum(points, _CODES - 1)]
    return out, np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))))


def grams(letters: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 1- to 3-grams, with one mark (0) for the end or start of a word; other characters are left out.

    Letters a, b, c give a, a * 2**20 + b and (a * 2**20 + b) * 2**20 + c, where the mark can
    be a or c of three; 3-grams that begin with the mark are shifted out of the way of the
    2-grams.  before: what an earlier window of the same text left, the second result.
    """
    last = np.zeros(1, np.int64) if before is None else before
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0
    if len(keep) and last[-1]:
        keep[0] = True
    x = np.concatenate((last, letters[keep]))
    old = len(last)
    one = x[old:][x[old:] != 0]
    two = x[old - 1 : -1] * _CODES + x[old:]
    pairs = two[(x[old - 1 : -1] != 0) & (x[old:] != 0)]
    three = (x[:-2] * _CODES + x[1:-1]) * _CODES + x[2:]
    three[x[:-2] == 0] += np.int64(1) << 61
    return np.concatenate((one, pairs, three[x[1:-1] != 0])), x[-2:]


def _runs(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.sort(every)
    starts, lengths = runs_of_sorted(every)
    return every[starts], lengths


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order with the sums of their counts."""
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes, kind="stable")
    starts, _ = runs_of_sorted(codes[order])
    counts = np.concatenate([n for _, n in parts])[order]
    return codes[order][starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _long_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of a text of any length, WINDOW characters at a time."""
    low, before, parts = text.lower(), None, []
    for at in range(0, len(low), WINDOW):
        letters, _ = _letters([low[at : at + WINDOW]])
        found, before = grams(letters[:-1], before)
        parts = [_summed([*parts, _runs(found)])]
    found, _ = grams(np.zeros(1, np.int64), before)
    return _summed([*parts, _runs(found)])


def top_grams(codes: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """The most frequent n-grams of codes in order; ties go to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:limit]]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]]):
        self.languages = sorted(ranked)
        self.codes = np.array(sorted({g for v in ranked.values() for g in v}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int32)
        for j, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, ranked[language]), j] = np.arange(len(ranked[language]))

    def predict(self, codes: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """Without n-grams, or without profiles: UNKNOWN and 0.  Ties go to the first language in order."""
        if not self.languages or not len(codes):
            return UNKNOWN, 0.0
        top = top_grams(codes, counts, DOCUMENT_GRAMS)
        at = np.searchsorted(self.codes, top)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != top] = len(self.codes)
        ranks = self.ranks[at]
        gaps = np.abs(ranks - np.arange(len(top), dtype=np.int32)[:, None])
        gaps[ranks < 0] = PROFILE_SIZE
        far = np.minimum(gaps, PROFILE_SIZE).sum(axis=0)
        best = int(far.argmin())
        return self.languages[best], 1.0 - float(far[best]) / (PROFILE_SIZE * len(top))


def _gram_counts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, n-grams, counts) of each text, a bounded chunk at a time."""
    texts = batch.column(column).to_pylist()
    sizes = np.concatenate(([0], np.cumsum([len(t or "") for t in texts])))
    for row, end in chunks(sizes, WINDOW):
        if end == row + 1 and sizes[end] - sizes[row] > WINDOW:
            yield row, *_long_counts(texts[row])
            continue
        letters, offsets = _letters([t or "" for t in texts[row:end]])
        for i in range(end - row):
            yield row + i, *_runs(grams(letters[offsets[i] : offsets[i + 1]])[0])


def is_held_out():
    """crc32 of doc_id as text mod 5 is 0; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> Profiles:
    """Profiles from rows with a language that are not held out.

    Sampling rates, a row for each language, are broadcast, so
    texts aren't shuffled.  N-gram counts are summed before the shuffle and again after
    it; the driver gets PROFILE_SIZE n-grams of each language.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(lang as string) lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out())
    counted = rows.groupBy("lang").count()
    rates = F.broadcast(counted.select("lang", (F.lit(float(SAMPLE_DOCS)) / F.col("count")).alias("rate")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.join(rates, "lang").where(draw < F.col("rate")).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column(0).to_pylist()
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for row, codes, counts in _gram_counts(batch, 1):
                held.setdefault(languages[row], []).append((codes, counts))
            for language, found in held.items():
                codes, sums = _summed(found)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(sums.astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.mapInArrow(lean(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram")))
    ranked: dict[str, list[int]] = {}
    for r in sorted(counts.withColumn("place", place).where(F.col("place") <= PROFILE_SIZE).collect(), key=lambda r: (r.lang, r.place)):
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranked)


def predict_languages(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs; only doc_id and text are read.

    A null or empty text, or one without letters, is UNKNOWN with score 0, and so is any
    text if there are no profiles.  Repeated rows give repeated rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(codes, counts) for _, codes, counts in _gram_counts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(lean(run), "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of docs whose text has a language, with all their columns; one narrow pass.

    A text has one if it has letters: distances choose a language, they reject none, and
    where there are no profiles texts with letters stay too.  A null in a string column
    lang becomes the predicted language.  Null and empty texts and texts without letters
    go; repeated rows are kept or go alike; no column but text (and lang) is touched; an empty
    table gives an empty one.
    """
    at = docs.columns.index("text")
    label = docs.columns.index("lang") if dict(docs.dtypes).get("lang") == "string" else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, named = [], []
            for _, codes, counts in _gram_counts(batch, at):
                found = profiles.predict(codes, counts)[0]
                keep.append(len(codes) > 0)
                named.append(found if found != UNKNOWN else None)
            if label is not None:
                old = batch.column(label).to_pylist()
                columns = batch.columns
                columns[label] = pa.array([o if o is not None else n for o, n in zip(old, named, strict=True)], columns[label].type)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
