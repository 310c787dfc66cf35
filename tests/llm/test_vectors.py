"""Centroid clustering, alignment of two tokenizers and the projection forest against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vendora.llm import ann_forest, centroids, token_alignment
from vendora.llm.queries import byte_model, piece_model
from vendora.plans import checkpoints


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string, score string, cid string, x int")


def plain(rows):
    """Rows with columns of clashing names."""
    return [(i, v, "c", "s", "q", 1) for i, v in rows]


# Centroids


def lloyd(rows, k, rounds):
    """Plain rounds over Python integers."""
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))[:k]
    found = [list(rows[i][1]) for i in order]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda: [min(range(len(found)), key=lambda c: (far(v, found[c]), c)) for _, v in rows]
    for _ in range(rounds):
        of = near()
        for c in range(len(found)):
            own = [v for (_, v), x in zip(rows, of, strict=True) if x == c]
            if own:
                found[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = near()
    inertia = [far(v, found[c]) for (_, v), c in zip(rows, of, strict=True)]
    of_cluster = Counter()
    for c, x in zip(of, inertia, strict=True):
        of_cluster[c] += x
    return sorted((i, c, x, of_cluster[c], sum(inertia), hashlib.sha256(",".join(map(str, found[c])).encode()).hexdigest()) for (i, _), c, x in zip(rows, of, inertia, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_clusters_equal_plain_rounds(spark, seed):
    rnd = random.Random(seed)
    width, k, n = rnd.choice([(1, 3, 60), (2, 8, 90), (3, 5, 4), (64, 8, 70)])
    # Few different integers: many rows that repeat, equal distances and empty clusters.
    rows = [(rnd.randrange(n), [rnd.randint(-3, 3) * rnd.choice([1, 1, 100]) for _ in range(width)]) for _ in range(n)]
    rows += rows[:10]
    if seed == 5:
        rows = [(i, [x * 10**12 for x in v]) if width < 64 else (i, v) for i, v in rows]
        big = [x for _, v in rows for x in v]
        assert max(map(abs, big)) > 0
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>").repartition(3)
    if seed == 5 and max(x for r in lloyd(rows, k, 10) for x in r[2:5] if isinstance(x, int)) >= 2**63:
        with pytest.raises(Exception, match="overflow|too large|Overflow|int"):
            centroids.cluster_vectors(df, k, 10).collect()
        return
    before = checkpoints.live()
    found = centroids.cluster_vectors(df, k, 10)
    assert sorted(map(tuple, found.collect())) == lloyd(rows, k, 10)
    checkpoints.release(found)
    assert checkpoints.live() == before


def test_clusters_of_odd_vectors(spark):
    good = [(i, [float(i % 7) + j / 7 for j in range(64)]) for i in range(40)]
    odd = [(100, None), (101, [1.0] * 63), (102, [None] + [1.0] * 63), (103, [math.nan] * 64), (104, [math.inf] * 64), (None, [1.0] * 64), (105, [])]
    kept = centroids.integer_vectors(vectors(spark, plain(good + odd)))
    assert sorted(r.vec_id for r in kept.collect()) == list(range(40))
    assert centroids.integer_vectors(vectors(spark, plain([(1, [-0.0001] * 64)]))).first().v == [-1] * 64
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in good]
    assert sorted(map(tuple, centroids.cluster_vectors(kept).collect())) == lloyd(rows, 8, 10)
    assert centroids.cluster_vectors(kept.limit(0)).collect() == []
    with pytest.raises(Exception, match="53 bits"):
        centroids.integer_vectors(vectors(spark, plain([(1, [1e300] * 64)]))).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64), min_size=1, max_size=20))
def test_bounds_are_rounded_outwards(values):
    x = np.array(values, dtype=object)
    for v, low, high in zip(values, centroids.under(x), centroids.over(x), strict=True):
        assert int(low) ** 2 <= v or float(low) ** 2 <= v * (1 + 1e-15)
        assert math.isqrt(v) <= float(high) and float(low) <= math.sqrt(v) <= float(high)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32))
def test_bounds_skip_distances_and_keep_ties(seed):
    rnd = np.random.default_rng(seed)
    rows = rnd.integers(-4, 5, (60, 2))
    points = [list(map(int, x)) for x in rnd.integers(-4, 5, (5, 2))]
    cluster, upper, lower = np.zeros(60, np.int32), np.full(60, np.inf, np.float32), np.zeros((60, 5), np.float32)
    centroids.assign(rows, cluster, upper, lower, points)
    far = np.array([[int(((r - p) ** 2).sum()) for p in np.array(points)] for r in rows])
    assert (cluster == far.argmin(axis=1)).all()
    assert (upper.astype(float) ** 2 >= far.min(axis=1) * (1 - 1e-6)).all() and (lower.astype(float) ** 2 <= far * (1 + 1e-6)).all()
    again = centroids.assign(rows, cluster, upper, lower, points)
    assert again < 60 * 5 and (cluster == far.argmin(axis=1)).all()


# Alignment


def brute_alignments(texts):
    """Groups, links and counts from the two libraries and plain loops."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of = token_alignment.byte_characters()

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        parts = [[bytes(of[c] for c in a_lib.id_to_token(i)) for i in a], [b_bytes(i) for i in b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            docs.append(None)
            continue
        spans = []
        for p in parts:
            ends = np.cumsum([len(x) for x in p]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        borders = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in borders:
            inside = [",".join(str(i) for i, (s, _) in zip(ids, own, strict=True) if start <= s < end) for ids, own in zip((a, b), spans, strict=True)]
            groups.append("|".join(inside))
            start = end
        links = [(i, j) for i, (s, e) in zip(a, spans[0], strict=True) for j, (t, f) in zip(b, spans[1], strict=True) if s < f and t < e]
        docs.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(x for d in docs if d for x in d[3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(d[4].encode()).hexdigest()) for d in docs], docs


SCRAPS = [" ", "  ", "\n", "\t", " ", "　", "​", "\u0085", " ", "\x1c", "\r\n", "a", "b", "The", "ing", "é", "😀", "漢字", "ß", "1", "23", ".", "!!", "'s", "'", "<|endoftext|>", "</s>", "<s>", "<0x41>", "\x00", "ﬁ", "é", " 've", "ll", " x", "\n\n"]


def alignment_texts():
    rnd = random.Random(5)
    some = ["".join(rnd.choice(SCRAPS) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    odd = [None, "", " ", "\n", "  x  ", "a▁b", "▁", "a" * 3000, "漢" * 2000, "x " * 900, "\n" * 500, " " * 700, "word " * 30 + "\n", "<|endoftext|>"]
    return some + odd + some[:20]


@pytest.mark.parametrize("slice_pairs", [token_alignment.SLICE, 300])
def test_alignments_equal_plain_loops(spark, slice_pairs):
    texts = alignment_texts()
    docs = spark.createDataFrame([(i // 2, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_a string, count_sum string").repartition(4)
    found = token_alignment.alignment_digests(docs, byte_model(), piece_model(), slice_pairs)
    want, _ = brute_alignments(texts)
    assert sorted(map(tuple, found.collect())) == sorted((i // 2, *w) for i, w in enumerate(want))
    assert token_alignment.alignment_digests(docs.limit(0), byte_model(), piece_model()).collect() == []


def test_groups_of_documents(spark):
    texts = alignment_texts()[:120] + [None, "a▁b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, want = brute_alignments(texts)
    for row in token_alignment.align_documents(docs, byte_model(), piece_model()).collect():
        said = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in row.groups)
        assert said == (want[row.doc_id][4] if want[row.doc_id] else "")
        starts = [g.start for g in row.groups]
        assert starts == sorted(set(starts)) and (not starts or starts[0] == 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.randoms())
def test_overlaps_equal_plain_loops(a, rnd):
    b, left = [], sum(a)
    while left:
        b.append(min(rnd.randint(1, 4), left))
        left -= b[-1]
    first, end, a_group, b_group = token_alignment.overlaps(np.array(a), np.array(b))
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    for i in range(len(a)):
        assert list(range(first[i], end[i])) == [j for j in range(len(b)) if a_ends[i] - a[i] < b_ends[j] and b_ends[j] - b[j] < a_ends[i]]
    borders = sorted(set(a_ends) & set(b_ends))
    assert list(a_group) == [sum(x < e for x in borders) for e in a_ends] and list(b_group) == [sum(x < e for x in borders) for e in b_ends]


def test_very_long_texts_are_aligned(spark):
    long = ["word wörd, " * 200_000, "a" * 300_000, "漢字かな" * 100_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    for row in token_alignment.alignment_digests(docs, byte_model(), piece_model()).collect():
        assert row.n_links >= max(row.n_a, row.n_b) >= min(row.n_a, row.n_b) >= row.n_groups > 0


# Nearest neighbours


def brute_nearest(rows, asked, k):
    unit = {}
    for i, v in rows:
        unit.setdefault((i, tuple(v)), np.array(v, float) / np.linalg.norm(v))
    out = {}
    for q in asked:
        own = min(v for i, v in unit if i == q)
        scores = sorted((-round(float(x @ unit[q, own]), 12), i) for (i, v), x in unit.items() if i != q and len(v) == len(own))
        out[q] = scores[:k]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_small_tables_are_searched_in_full(spark, seed):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(60, 6)).round(2)
    # A third of all rows are copies, others are multiples, and some have another length.
    rows = [(i, base[0 if i % 3 == 0 else i % 60].tolist()) for i in range(150)] + [(200 + i, (2.0 * base[i]).tolist()) for i in range(10)] + [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (302, [1.0])]
    rows += rows[:20]
    df = vectors(spark, plain(rows)).repartition(3)
    clean = ann_forest.clean_vectors(df)
    found = ann_forest.nearest(clean, clean.where("vec_id % 50 = 0 or vec_id > 300"), 5, leaf_rows=16, recall=1.0)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
    want = brute_nearest(rows, [i for i, _ in dict(rows).items() if i % 50 == 0 or i > 300], 5)
    assert set(got) == {q for q, w in want.items() if w}
    for q, own in got.items():
        assert [s for s, _ in own] == pytest.approx([s for s, _ in want[q]])
        # Directions of multiples are equal up to rounding, so only ids of clearly different scores must agree.
        clear = [i for (s, i) in want[q] if abs(s - want[q][-1][0]) > 1e-9]
        assert set(clear) <= {i for _, i in own}


def test_copies_of_a_vector_are_ranked_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(500 + i, [3.0, float(i % 5), 1.0]) for i in range(50)]
    clean = ann_forest.clean_vectors(vectors(spark, plain(rows)).repartition(8))
    found = ann_forest.nearest(clean, clean.where("vec_id % 50 = 0"), 5)
    got = {q: [r.vec_id for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (0, 50, 450)}
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 450: [0, 1, 2, 3, 4]}


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, -0.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1e200, 1e200]), (8, [1e-300, 0.0])]
    clean = ann_forest.clean_vectors(vectors(spark, plain(rows)))
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann_forest.nearest(clean, clean.where("vec_id = 0"), 5).collect()]
    assert sorted(got) == [(0, 1, 8, 1.0), (0, 2, 7, round(math.sqrt(0.5), 9))]
    assert ann_forest.nearest(clean.limit(0), clean.limit(0), 5).collect() == []
    alone = clean.where("vec_id = 0")
    assert ann_forest.nearest(alone, alone, 5).collect() == []


def test_recall_against_brute_force(spark):
    rnd = np.random.default_rng(11)
    centres = rnd.normal(size=(30, 24))
    x = np.concatenate((centres[rnd.integers(0, 30, 2500)] + 0.4 * rnd.normal(size=(2500, 24)), rnd.normal(size=(500, 24)))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    clean = ann_forest.clean_vectors(df)
    found = ann_forest.nearest(clean, clean.where("vec_id % 50 = 0"), 5, leaf_rows=64)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = rows = 0
    for r in found.collect():
        scores = unit @ unit[r.query_id]
        assert abs(r.score - scores[r.vec_id]) < 1e-12
        scores[r.query_id] = -2
        hits += scores[r.vec_id] >= np.sort(scores)[-5]
        rows += 1
    assert rows == 60 * 5 and hits / rows >= 0.9
