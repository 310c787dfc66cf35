"""Toxicity by class-conditional Kneser-Ney models.

Two character models of tokens (words, numbers, other marks), one of toxic and one of
ordinary documents, with interpolated Kneser-Ney smoothing.  Orders above SHARED_ORDERS
have counts of their class; below, both classes back off to the same continuation
counts, pooled over the classes, so rare expressions that neither class has shown score
alike.  A toxic document is ordinary text with a share BLEND of its tokens from the toxic
model, an ordinary one has none.  The evidence is the difference of the whole text's two
log-likelihoods for each token, every occurrence counted; PRIOR_TOKENS neutral tokens are
added to the length, so that a few words alone decide little.  A logistic curve, fitted
on sampled documents that didn't train the models it is fitted with, maps it to 0..1.

The models are fitted on a bounded sample of labelled rows: SAMPLE_DOCS of each label,
those with the smallest hash of doc_id, and of these the first whose whole texts fit into SAMPLE_BYTES.  Their n-grams are counted and their evidence is
measured on the executors; the driver gets n-gram counts and two numbers a document, no
text.  Scoring covers every document and its whole text in one narrow pass; token ratios
are memoised in a table of bounded size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.llm.store import lean
from vendora.plans.checkpoints import discard, guarded, materialize

#: Sampled labelled documents of each label: so many, and no more once their texts have so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 1600, 32 << 20
ORDER = 5
SHARED_ORDERS = 2
DISCOUNT = 0.75
#: Neutral tokens added to a document's length.
PRIOR_TOKENS = 50.0
#: Share of a toxic document's tokens that come from the toxic model; the rest come from the ordinary one.
BLEND = 0.005
MEMO_LIMIT = 400_000
THRESHOLD = 0.7
#: Characters of a text that are split into tokens at a time.
WINDOW = 1 << 20
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
START, STOP = "^" * (ORDER - 1), "$"


def token_windows(text: str | None) -> Iterator[list[str]]:
    """Tokens in lower case, a window of the text after another."""
    low, at = (text or "").lower(), 0
    while at < len(low):
        end = min(len(low), at + WINDOW)
        found = _TOKEN.findall(low, at, end)
        if found and low.endswith(found[-1], at, end):  # it may go on beyond the window
            start = end - len(found[-1])
            found[-1] = _TOKEN.match(low, start)[0]
            end = start + len(found[-1])
        yield found
        at = end


def grams_of(tokens: Counter | Iterable[str]) -> Counter:
    """Counts of the n-grams of ORDER characters of padded tokens; each ends with a character of a token or its stop."""
    out: Counter = Counter()
    for token, n in Counter(tokens).items():
        padded = START + token + STOP
        for i in range(len(token) + 1):
            out[padded[i : i + ORDER]] += n
    return out


class ClassModels:
    """Kneser-Ney character models of classes 0 and 1, from the counts of their n-grams of ORDER characters."""

    def __init__(self, counts: tuple[Counter, Counter]):
        # own[c] at a level: n-gram -> its count at the highest order, below it the number of different left neighbours.
        self.levels: list[tuple] = []
        own, seen = list(counts), [set(counts[0]), set(counts[1])]
        for k in range(ORDER, 0, -1):
            if k < ORDER:
                # Different (left neighbour, n-gram) pairs are the n-grams one longer that occur.
                longer = seen
                seen = [{g[1:] for g in x} for x in longer]
                if k > SHARED_ORDERS:
                    own = [Counter(g[1:] for g in x) for x in longer]
                else:
                    pooled = Counter(g[1:] for g in longer[0] | longer[1])
                    own = [pooled, pooled]
            total, kinds = [Counter(), Counter()], [Counter(), Counter()]
            for c in (0, 1):
                for g, n in own[c].items():
                    total[c][g[:-1]] += n
                    kinds[c][g[:-1]] += 1
            self.levels.append((own, total, kinds))
        self.letters = len(self.levels[-1][0][0]) + 1  # one more for characters never seen
        self.known: dict[str, float] = {}

    def probability(self, c: int, gram: str) -> float:
        """P of the last character of an n-gram after the others, by class c."""
        p = 1.0 / self.letters
        for k in range(1, ORDER + 1):
            own, total, kinds = self.levels[ORDER - k]
            g = gram[ORDER - k :]
            n = total[c].get(g[:-1], 0)
            if n:
                p = (max(own[c].get(g, 0) - DISCOUNT, 0.0) + DISCOUNT * kinds[c][g[:-1]] * p) / n
        return p

    def _step(self, gram: str) -> float:
        out = math.log(self.probability(1, gram)) - math.log(self.probability(0, gram))
        if len(self.known) >= MEMO_LIMIT:
            self.known.clear()
        self.known[gram] = out
        return out

    def ratio(self, token: str) -> float:
        """log P(token | toxic model) - log P(token | ordinary model)."""
        padded = START + token + STOP
        known = self.known
        out = 0.0
        for i in range(len(token) + 1):
            gram = padded[i : i + ORDER]
            step = known.get(gram)
            out += self._step(gram) if step is None else step
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state):
        self.__dict__.update(state, known={})


def blended(ratio: float) -> float:
    """log((1 - BLEND) + BLEND * exp(ratio)), whatever the ratio's size."""
    if ratio <= 0:
        return math.log1p(BLEND * math.expm1(ratio))
    return ratio + math.log(BLEND + (1 - BLEND) * math.exp(-ratio))


class _Memo(dict):
    """Token -> log P(token | toxic document) - log P(token | ordinary document)."""

    def __init__(self, models: ClassModels):
        super().__init__()
        self.models = models

    def __missing__(self, token: str) -> float:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        out = blended(self.models.ratio(token))
        if len(token) <= 40:
            self[token] = out
        return out


def evidence(memo: dict, text: str | None) -> float:
    """Difference of a text's log-likelihoods for each token."""
    n, total = 0, 0.0
    for tokens in token_windows(text):
        n += len(tokens)
        total += sum([memo[t] for t in tokens])
    return total / (n + PRIOR_TOKENS)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature by Newton steps with a small ridge; (intercept, slope)."""
    scale = float(x.std()) or 1.0
    a, b = 0.0, 0.0
    z = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        g = np.array([np.sum(weight * (y - p)), np.sum(weight * (y - p) * z) - 1e-2 * b])
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[w.sum(), (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step = np.clip(step, -5, 5)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b / scale)


class ToxicityModel:
    """Models and curve; without models every text scores the same."""

    def __init__(self, models: ClassModels | None, intercept: float, slope: float):
        self.models, self.intercept, self.slope = models, intercept, slope
        self.memo = _Memo(models) if models else None

    def score(self, text: str | None) -> float:
        x = self.intercept + (self.slope * evidence(self.memo, text) if self.models else 0.0)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))

    def __getstate__(self):
        return self.models, self.intercept, self.slope

    def __setstate__(self, state):
        self.__init__(*state)


@guarded
def sample_labelled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> tuple[DataFrame, float]:
    """(text, toxic, half) of at most size different rows of each label, whose texts have SAMPLE_BYTES together with at most one more, and the share of label 1.

    Rows whose crc32(doc_id) mod 3 is 1 are left out, and so are null labels and doc_ids
    labelled both ways.  Ids are chosen from labels alone and rows, where an id has
    several texts, by a hash of the text: both are bounded top-k without texts.
    """
    ids = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic").where("toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    ids = ids.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    n, ones = ids.agg(F.count("*"), F.sum("toxic")).first()

    def first(rows: DataFrame, *more: str) -> DataFrame:
        parts = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id", *more).limit(size) for c in (0, 1)]
        return parts[0].unionByName(parts[1])

    chosen = F.broadcast(first(ids))  # at most 2 * size narrow rows
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").withColumn("_t", F.xxhash64("text"))
    sized = rows.select("doc_id", "toxic", "_t", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_size")).distinct()
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "_t")  # at most size rows of each label
    taken = first(sized, "_t").withColumn("_before", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    keys = materialize(taken.where(F.col("_before") < SAMPLE_BYTES).drop("_size", "_before").withColumn("half", F.pmod(F.xxhash64("doc_id", "_t"), F.lit(2)).cast("int")))
    picked = rows.join(F.broadcast(keys.select("doc_id", "_t", "half")), ["doc_id", "_t"])
    sample = materialize(picked.groupBy("doc_id", "_t", "toxic", "half").agg(F.first("text").alias("text")).select("text", "toxic", "half"))
    discard(keys)
    return sample, float(ones or 0) / n if n else 0.0


def fit(sample: DataFrame, rate: float) -> ToxicityModel:
    """sample: text, toxic, half (0 or 1); rate: the score of every text if a label has no rows.

    Both labels weigh the same in the curve: 0.5 is where they are as likely at equal
    shares.  The curve is fitted on evidence by models of the other half, so no text
    scores itself.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(i) for i in range(3)), strict=True):
                for tokens in token_windows(text.as_py()):
                    held.setdefault((toxic.as_py(), half.as_py()), Counter()).update(tokens)
        for (toxic, half), tokens in held.items():
            found = grams_of(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), toxic, np.int32)), pa.array(np.full(len(found), half, np.int32)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["toxic", "half", "gram", "n"])

    rows = sample.mapInArrow(lean(count), "toxic int, half int, gram string, n bigint").groupBy("toxic", "half", "gram").agg(F.sum("n").alias("n"))
    parts = [[Counter(), Counter()], [Counter(), Counter()]]
    for r in rows.toLocalIterator():
        parts[r.half][r.toxic][r.gram] = r.n
    if not all(parts[0][c] or parts[1][c] for c in (0, 1)):
        return ToxicityModel(None, math.log((rate + 1e-6) / (1 - rate + 1e-6)), 0.0)
    halves = sample.sparkSession.sparkContext.broadcast([ClassModels((part[0], part[1])) for part in parts])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [_Memo(m) for m in halves.value]
        for batch in batches:
            x = [evidence(memos[1 - half.as_py()], text.as_py()) for text, half in zip(batch.column(0), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    found = sorted(map(tuple, sample.mapInArrow(lean(measure), "x double, toxic int").collect()))  # at most two rows a sampled document
    x, y = np.array([r[0] for r in found]), np.array([r[1] for r in found], float)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    a, b = fit_curve(x, y, weight)
    return ToxicityModel(ClassModels((parts[0][0] + parts[1][0], parts[0][1] + parts[1][1])), a, b)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text; null or empty texts score the curve at no evidence.

    Repeated rows score alike, each with a row of its own; texts with one score are no case of
    their own, as nothing is ranked; an empty table gives an empty one; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(lean(run), "doc_id bigint, score double")
