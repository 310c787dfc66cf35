"""Operators on single texts, searches and formats."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vendora.llm import chat_format, decontaminate, language_id, piece_codec, queries, token_counts, topk_search, toxicity

DOC = "doc_id bigint, text string"
ODD_TEXTS = [None, "", " ", "  a", "a  b   c ", "a\nb\n\nc", "▁x", "\x00a", "日本語 のテキスト", "𝄞x", "<s>a</s>", "<0x41>", "\t x", "x" * 5000, "word " * 3000]


@pytest.fixture(scope="module")
def model():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path(queries.PIECE_MODEL), "rb") as f:
        return f.read()


# Search


def brute_top(rows, k):
    vec = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vec[i] = [math.floor(256 * x) for x in v]
    out = set()
    for q in vec:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vec[q], vec[i], strict=True)), i) for i in vec if i != q and len(vec[i]) == len(vec[q]))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def test_top_k_is_exact_with_ties_and_bad_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, rng.random()]) for _ in range(4)]) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(400, 520)]
    rows += [(600, None), (650, [1.0, None, 0.0, 0.0]), (700, [float("nan")] * 4), (750, [float("inf")] * 4), (None, [1.0] * 4), (800, [1.0, 2.0]), (801, [3.0, 4.0]), (850, [9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 score", "2 bin", "3 cell")
    vectors = topk_search.integer_vectors(df)
    found = {tuple(r) for r in topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()}
    assert found == brute_top(rows, 5)


def test_top_k_needs_several_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16) * 20]) for i in range(1500)]
    vectors = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    found = {tuple(r) for r in topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()}
    assert found == brute_top(rows, 5)


def test_top_k_keeps_vectors_with_large_components(spark):
    rng = random.Random(14)
    rows = [(i, [rng.choice([1.0, 300.25, -70_000.5, 1e6, rng.random()]) for _ in range(4)]) for i in range(120)]
    rows += [(150, [1e7, 1.0, 0.0, -2.0]), (151, [70_000.0]), (200, [1.0]), (250, [-65_536.0])]
    top = lambda rows: topk_search.top_k(v := topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")), v.where("vec_id % 50 = 0"), 5)
    assert {tuple(r) for r in top(rows).collect()} == brute_top(rows, 5)
    for x in (1e9, 1e300):
        with pytest.raises(Exception, match="64 bits"):
            top([(0, [x]), (1, [x])]).collect()


def test_top_k_of_repeated_ids_and_hot_vectors(spark):
    """A third of the rows are one vector; ids may repeat, and then each row of a candidate counts."""
    rng = random.Random(15)
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [rng.random(), rng.random()]) for i in range(600)] + [(601, [2.0, 2.0])] * 3
    vectors = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()}
    assert [found[0, r][0] for r in range(1, 6)] == [601, 601, 601, 3, 6]
    assert [found[3 * 50, r][0] for r in range(1, 6)] == [601, 601, 601, 0, 3]


def test_top_k_of_nothing(spark):
    vectors = topk_search.integer_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert topk_search.top_k(vectors, vectors, 5).collect() == []


def test_large_components_stay_exact():
    a = np.array([[2**23, 3], [5, -(2**23)]], np.int64)
    assert topk_search._products(a, a * 2).tolist() == [[int(x @ y) for y in (a * 2)] for x in a]


# Tokens


def test_token_counts_equal_greedy_word_piece(spark, model):
    models = pytest.importorskip("tokenizers.models")
    initial, later = token_counts.pieces_of_model(model)
    vocabulary = {}
    for piece in [*initial, *("##" + p for p in later), "[UNK]"]:
        vocabulary.setdefault(piece, len(vocabulary))
    greedy = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6)
    rng = random.Random(3)
    texts = ODD_TEXTS + ["".join(rng.choice("aeinrst hloxé日,.0") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), DOC)
    found = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(rows, initial, later).collect()}
    assert found == {i: (len((t or "").split()), sum(len(greedy.tokenize(w)) for w in (t or "").split())) for i, t in enumerate(texts)}


def test_pieces_equal_the_library(spark, model):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(4)
    alphabet = " \n\t▁aeéêçñß日の𝄞🙂ABCthering<>/s0123#*&.,-_=(){}\"'\\"
    texts = ODD_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), DOC).selectExpr("*", "1 ids", "2 n_tokens")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_eos=True)
        want[i] = (len(ids), digest(" ".join(map(str, ids))), digest(sp.decode(ids)))
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.round_trip_digests(rows, model).collect()}
    assert found == want
    encoded = piece_codec.encode_documents(rows, model)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {i: sp.encode(t or "", add_eos=True) for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in piece_codec.decode_documents(encoded, model).collect()}
    assert back == {i: sp.decode(sp.encode(t or "")) for i, t in enumerate(texts)}


def test_tokens_and_pieces_of_repeated_rows_and_empty_tables(spark, model):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "other"), (None, "x"), (2, None)], DOC).selectExpr("*", "1 n_words", "2 ids", "'y' word")
    pieces = token_counts.pieces_of_model(model)
    counted = token_counts.count_tokens(rows, *pieces).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in counted) == [("1", 1), ("1", 2), ("1", 2), ("2", 0), ("None", 1)]
    assert token_counts.count_tokens(rows.limit(0), *pieces).collect() == []
    assert sorted(r.n_tokens for r in piece_codec.round_trip_digests(rows, model).collect())[0] == 1
    assert piece_codec.round_trip_digests(rows, model).count() == 5
    for made in (piece_codec.round_trip_digests, piece_codec.encode_documents):
        assert made(rows.limit(0), model).collect() == []


def test_models_with_a_normaliser_are_refused(model, monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    plain = sentencepiece.SentencePieceProcessor

    class Folding:
        def __init__(self, **kw):
            self.sp = plain(**kw)

        def __getattr__(self, name):
            return getattr(self.sp, name)

        def encode(self, text):
            return self.sp.encode(text.replace("ﬁ", "fi"))

    piece_codec.PieceModel(model)
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="normaliser"):
        piece_codec.PieceModel(model)


# Classifiers


def test_languages(spark):
    rng = random.Random(5)
    letters = {"x1": "abcde", "x2": "éèêfg", "x3": "日本のlm"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(30)), lang) for i in range(300) for lang in [f"x{i % 3 + 1}"]]
    rows += [(1000, None, "x1"), (1001, "", None), (1002, " 12 !? ", "x2"), (None, "abc", "x1"), (1003, "abc cba", None), (1004, "é" * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 score", "2 gram")
    profiles = language_id.learn(docs)
    found = {r.doc_id: r for r in language_id.predict_languages(docs, profiles).collect()}
    assert len(found) == len(rows)
    assert np.mean([found[i].lang_pred == lang for i, _, lang in rows[:300]]) > 0.98
    assert [found[i].lang_pred for i in (1000, 1001, 1002, 1004)] == ["und", "und", "und", "x2"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.keep_identified(docs, profiles).count() == len(rows) - 3
    none = language_id.learn(docs.limit(0))
    assert language_id.predict_languages(docs, none).where("lang_pred <> 'und'").count() == 0


def plain_grams(text):
    """Counts of 1- to 3-grams of the lower-cased letters, with a mark at both ends of words."""
    out = {}
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    for w in low.split():
        padded = f" {w} "
        for g in [*w, *(w[i : i + 2] for i in range(len(w) - 1)), *(padded[i : i + 3] for i in range(len(padded) - 2))]:
            out[g] = out.get(g, 0) + 1
    return out


def plain_rank(counts, limit):
    """Ties by length, but 3-grams that start a word last, then by letters; the mark comes first."""
    return sorted(counts, key=lambda g: (-counts[g], len(g) + (len(g) == 3 and g[0] == " "), [0 if c == " " else ord(c) for c in g]))[:limit]


def test_predictions_are_the_nearest_out_of_place_profiles(spark):
    rng = random.Random(21)
    letters = {"x1": "abcdeé", "x2": "cdefgß", "x3": "日本の語文"}
    say = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(i, say(f"x{i % 3 + 1}", rng.randint(0, 60)) + rng.choice(["", " 1?", " MIX ß日"]), f"x{i % 3 + 1}") for i in range(240)]
    rows += [(300, "a", None), (301, "a", None), (302, say("x1", 40_000), "x1"), (302, say("x1", 40_000), "x1"), (303, "abc" * 400_000, "x1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sums = {}
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            for g, n in plain_grams(text).items():
                sums.setdefault(lang, {}).setdefault(g, 0)
                sums[lang][g] += n
    profiles = {lang: {g: r for r, g in enumerate(plain_rank(c, language_id.PROFILE_SIZE))} for lang, c in sums.items()}
    want = []
    for i, text, _ in rows:
        top = plain_rank(plain_grams(text), language_id.DOCUMENT_GRAMS)
        far = {lang: sum(min(abs(p[g] - r), language_id.PROFILE_SIZE) if g in p else language_id.PROFILE_SIZE for r, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want.append((i, best if top else "und", round(1 - far[best] / (language_id.PROFILE_SIZE * len(top)), 9) if top else 0.0))
    found = language_id.predict_languages(docs, language_id.learn(docs)).collect()
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in found) == sorted(want)


def test_ties_between_languages_go_to_the_first(spark):
    docs = spark.createDataFrame([(i, "ab ba", "y" if i % 2 else "x") for i in range(40)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in language_id.predict_languages(docs, language_id.learn(docs)).collect()} == {"x"}


def test_letters_pass_where_no_profile_exists(spark):
    rows = [(1, "abc", None), (2, " 12 !?", None), (3, None, None), (4, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in language_id.keep_identified(docs, language_id.learn(docs)).collect()) == [1, 4]


def test_every_language_is_learned(spark):
    rows = [(i, chr(0x4E00 + i % 230) * 9, f"x{i % 230:03}") for i in range(230 * 4)]
    profiles = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert profiles.languages == sorted({r[2] for r in rows})


def test_toxicity_separates_held_out_documents(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "lo", "sh", "e"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        said = [word() for _ in range(rng.randint(20, 80))]
        if i % 4 == 0:
            for _ in range(3):
                said.insert(rng.randrange(len(said)), rng.choice(["zukvor", "zukmed", "bragzu"]))
        rows.append((i, " ".join(said)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (None, "an re")]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 score")
    marks = spark.createDataFrame([*labels, (None, 1), (3000, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(*toxicity.sample_labelled(docs, marks))
    found = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(found[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held]) > 0.97
    assert found[1000] < 0.5 and found[1001] < 0.5
    assert abs(toxicity.fit(spark.createDataFrame([], "text string, toxic int, half int"), 0.25).score("x") - 0.25) < 1e-3


def plain_kneser_ney(counts, c, gram):
    """Interpolated Kneser-Ney by its definition, over the n-grams of both classes."""
    longest = [set(x) for x in counts]
    ends = lambda x, k: {g[-k:] for g in x}

    def left(k, c):
        # Different n-grams one longer that end with each n-gram of k.
        from_ = ends(longest[0], k + 1) | ends(longest[1], k + 1) if k <= toxicity.SHARED_ORDERS else ends(longest[c], k + 1)
        out = {}
        for g in from_:
            out[g[1:]] = out.get(g[1:], 0) + 1
        return out

    p = 1 / (len(left(1, c)) + 1)
    for k in range(1, toxicity.ORDER + 1):
        own = dict(counts[c]) if k == toxicity.ORDER else left(k, c)
        g = gram[-k:]
        same = {x: n for x, n in own.items() if x[:-1] == g[:-1]}
        if same:
            p = (max(same.get(g, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(same) * p) / sum(same.values())
    return p


def test_kneser_ney_by_its_definition():
    rng = random.Random(22)
    counts = tuple(toxicity.grams_of("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(60)) for letters in ("abc", "bcd"))
    models = toxicity.ClassModels(counts)
    seen = sorted({g for x in counts for g in x})
    letters = sorted({g[-1] for g in seen})
    for gram in rng.sample(seen, 30) + ["zzzzz", "^^^^z", "abcdz"]:
        for c in (0, 1):
            assert math.isclose(models.probability(c, gram), plain_kneser_ney(counts, c, gram), rel_tol=1e-12)
            # Of all characters and one never seen: the probabilities after a context sum to 1.
            assert math.isclose(sum(models.probability(c, gram[:-1] + x) for x in [*letters, "\u2603"]), 1, rel_tol=1e-9)
    text = "ab bcd, aabb 12 bcd zz"
    tokens = ["ab", "bcd", ",", "aabb", "12", "bcd", "zz"]
    total = 0.0
    for t in tokens:
        padded = toxicity.START + t + toxicity.STOP
        p = [math.prod(plain_kneser_ney(counts, c, padded[i : i + toxicity.ORDER]) for i in range(len(t) + 1)) for c in (0, 1)]
        total += math.log((1 - toxicity.BLEND) * p[0] + toxicity.BLEND * p[1]) - math.log(p[0])
    assert math.isclose(toxicity.evidence(toxicity._Memo(models), text), total / (len(tokens) + toxicity.PRIOR_TOKENS), rel_tol=1e-9)


def test_tokens_of_long_texts_show_no_cut(monkeypatch):
    rng = random.Random(23)
    text = "".join(rng.choice("ab1 ,_é") for _ in range(3000)) + "x" * 300
    tokens = lambda: [t for part in toxicity.token_windows(text) for t in part]
    whole = tokens()
    monkeypatch.setattr(toxicity, "WINDOW", 101)
    assert "".join(whole) == "".join(text.split()) == "".join(tokens())
    assert tokens()[: len(whole) - 1] == whole[:-1]


def test_toxicity_edges(spark):
    rows = [(i, f"w{i} calm day" if i % 2 else f"w{i} vile rot") for i in range(60)]
    rows += [(1, "calm " * 30), (100, "calm " * 1_000_000), (100, "calm " * 1_000_000), (5, None)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 toxic", "2 half", "3 _t")
    # 3 is labelled both ways and 5 repeats; neither stops the fit.
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)] + [(3, 1), (5, 0), (None, 1), (7, None)], "doc_id bigint, toxic int").selectExpr("*", "'x' text", "0 quality")
    sample, rate = toxicity.sample_labelled(docs, labels)
    assert sample.count() <= 64 and 0 < rate < 1
    assert sample.where("toxic = 1 and text like '%w3 calm%'").count() == 0
    few, _ = toxicity.sample_labelled(docs, labels, 3)
    assert few.groupBy("toxic").count().where("count <> 3").count() == 0
    scores = toxicity.score_documents(docs, toxicity.fit(sample, rate)).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    same = [r.score for r in scores if r.doc_id == 100]
    assert same[0] == same[1] < 0.5
    assert toxicity.score_documents(docs.limit(0), toxicity.fit(sample, rate)).collect() == []


# Decontamination


def test_leaks_match_brute_force(spark):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(12)]
    rare = [f"r{i}" for i in range(800)]
    say = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))
    items = [(i, f"{say(rng.randint(8, 40))}. Answer {say(rng.randint(2, 8))}") for i in range(40)] + [(90, None), (91, ""), (92, "single")]
    rows = []
    for i in range(120):
        text = say(rng.randint(0, 300))
        if i % 3 == 0:
            cut = text.split()
            at = rng.randint(0, len(cut))
            text = " ".join([*cut[:at], items[i % 40][1].upper() if i % 2 else items[i % 40][1], *cut[at:]])
        rows.append((i, text))
    rows += [(200, None), (201, ""), (None, items[0][1])]
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    gram = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, text in rows:
        w = (text or "").lower().split()
        for j, item in items:
            if item and w:
                parts = [p.lower().split() for p in decontaminate.question_and_answer(item)]
                shares = []
                for p in parts:
                    k = max(1, min(5, len(p)))
                    shares.append(len(gram(p, k) & gram(w, k)) / len(gram(p, k)) if p else 1.0)
                if shares[0] == 1 and shares[1] == 1 and len(item.split()) > 5:
                    want.add((i, j))
    assert {x for x in found if x[1] != 92} == want
    assert decontaminate.find_leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def plain_leaks(rows, items):
    """BM25 shares over windows of an item's own class, and shares of the n-grams of question and answer, by their definitions."""
    split = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    every = [(i, t, split(t)) for i, t in items if split(t)]
    n, mean = len(every), sum(len(w) for *_, w in every) / max(len(every), 1)
    df = {}
    for *_, w in every:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    gram = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = []
    for i, item, w in every:
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in set(w)}
        weight = {t: idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(w)}
        step = 16
        while step < len(w):
            step *= 2
        parts = [split(p) for p in decontaminate.question_and_answer(item)]
        for d, text in rows:
            words, best = split(text), None
            for at in range(0, max(len(words) - step, 1), step) if words else ():
                passage = words[at : at + 2 * step]
                score = sum(x for t, x in weight.items() if t in set(passage)) / sum(weight.values())
                shares = [len(gram(p, k := max(1, min(5, len(p)))) & gram(passage, k)) / len(gram(p, k)) if p else 1.0 for p in parts]
                if score >= 0.5 - 1e-9 and min(shares) >= 0.5:
                    best = max(best or (0, 0, 0), (score, *shares))
            if best:
                out.append((d, i, *(round(x, 6) for x in best)))
    return sorted(out, key=str)


def test_leaks_match_brute_force_at_all_shares(spark, monkeypatch):
    rng = random.Random(24)
    vocabulary = [f"c{i}" for i in range(10)] * 20 + [f"r{i}" for i in range(500)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([5, 12, 20, 40, 90, 150]))) + ". " + " ".join(say(rng.randint(1, 9)))) for i in range(40)]
    items += [(50, items[0][1]), (50, items[0][1]), (51, None), (52, ""), (53, "single"), (54, "Q? A")]
    rows = []
    for i in range(160):
        said = items[i % 40][1].split()
        # Parts of items, with words changed: shares from 0 to 1.
        low, high = sorted((rng.randint(0, len(said)), rng.randint(0, len(said))))
        said = said[low // 4 : len(said) - (len(said) - high) // 6]
        for _ in range(rng.randint(0, 1 + len(said) // 14)):
            if said:
                said[rng.randrange(len(said))] = rng.choice(vocabulary)
        rows.append((i, " ".join(say(rng.randint(0, 200)) + said + say(rng.randint(0, 200)))))
    rows += [(300, rows[3][1]), (301, None), (302, ""), (None, items[1][1]), (303, items[2][1] + " x" * 60_000)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 item_id", "2 score")
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "3 doc_id")
    want = plain_leaks(rows, items)
    shares = [x for r in want for x in r[3:]]
    assert len(want) > 50 and min(shares) < 0.7
    result = lambda: sorted(((r.doc_id, r.item_id, round(r.score, 6), round(r.question_share, 6), round(r.answer_share, 6)) for r in decontaminate.find_leaks(docs, bench).collect()), key=str)
    assert result() == want
    # Neither shards nor other items decide: several shards give the same.
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    assert result() == want
    kept = decontaminate.drop_leaks(docs, bench)
    gone = {r[0] for r in want}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in rows if i not in gone), key=str)
    assert kept.columns == docs.columns
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == []


def test_a_long_item_hides_no_short_one(spark):
    item = " ".join(f"q{i}" for i in range(20)) + ". " + " ".join(f"a{i}" for i in range(6))
    docs = spark.createDataFrame([(1, "x " * 3000 + item + " y" * 3000)], DOC)
    for more in ([], [(2, " ".join(f"z{i}" for i in range(1000)))]):
        found = decontaminate.find_leaks(docs, spark.createDataFrame([(1, item), *more], "item_id bigint, text string"))
        assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 1)]


def test_block_max_wand_returns_all_above_threshold():
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 30)))) for i in range(300)]
    tokens = decontaminate.hashed_words([t for _, t in items])
    frequency = {}
    for w in tokens:
        for t in np.unique(w).tolist():
            frequency[t] = frequency.get(t, 0) + 1
    index = decontaminate.Index(items, tokens, 32, frequency, len(items), sum(map(len, tokens)) / len(tokens))
    for _ in range(100):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 40)))
        scores = {}
        for t in terms:
            for i, x in zip(*index.lists[t], strict=True):
                scores[i] = scores.get(i, 0) + x
        for least in (0.2, 0.5, 0.8):
            found = dict(index.search(terms, least))
            want = {i: s for i, s in scores.items() if s >= least}
            assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-9 for i in want)


# Chat


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\b<|turn|>", "\\<|", "<\\|end|>", "", "[[INST]", "<<s>", "\\\\", None, "é\n<|text|>x", "[/INST]</s><s>"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(odd)] + [(2, None, None, "x"), (2, 5, "assistant", "y"), (2, 5, "assistant", "y"), (None, 0, "user<|text|>", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 piece", "2 at")
    formatted = chat_format.format_turn_rows(df)
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in formatted.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert read[1] == [(["user", "assistant"][i % 2], t or "") for i, t in enumerate(odd)]
    assert read[2] == [("", "x"), ("assistant", "y"), ("assistant", "y")] and read[None] == [("user<|text|>", "z")]
    loss = {r.conv_id: "".join(r.loss) for r in formatted.select("conv_id", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert loss == {1: "".join(t or "" for t in odd[1::2]), 2: "yy", None: ""}
    digests = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert digests[1].loss_sha256 == hashlib.sha256(loss[1].encode()).hexdigest() and digests[1].n_turns == len(odd)
    assert chat_format.digests(chat_format.format_turn_rows(df.limit(0))).collect() == []


def test_a_very_long_turn(spark):
    long = "a\\<|b " * 400_000
    df = spark.createDataFrame([(1, 0, "assistant", long), (1, 0, "assistant", long), (2, 0, "user", "")], "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r for r in chat_format.digests(chat_format.format_table(df)).collect()}
    assert found[1].loss_chars == 2 * len(long) and found[1].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()
    assert found[2].loss_chars == 0 and found[2].n_turns == 1


def test_layouts_give_the_same_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    typed = [
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id bigint, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id bigint, conversations array<struct<from:string,value:string>>"),
        spark.createDataFrame([(1, "q", "a")], "conv_id bigint, prompt string, response string"),
        spark.createDataFrame([(1, "q", "", "a")], "conv_id bigint, instruction string, input string, output string"),
    ]
    for df in typed:
        assert [tuple(t) for t in chat_format.turns_by_row(df).first().turns] == want
    with pytest.raises(ValueError):
        chat_format.turns_by_row(spark.createDataFrame([(1, "x")], "conv_id bigint, other string"))


def test_json_records_of_mixed_layouts(spark):
    records = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"question":"q","answer":"a"}', '{"prompt":"q","completion":"a"}', '{"x":1}', "no json", None, "[]"]
    found = {r.conv_id: r for r in chat_format.turns_of_json(spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string")).collect()}
    assert all([tuple(t) for t in found[i].turns] == [("user", "q"), ("assistant", "a")] for i in range(4))
    assert all(found[i].turns is None for i in range(4, 8))
    turns = spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string").transform(chat_format.turns_of_json)
    assert [r.n_turns for r in chat_format.format_turns(turns).collect()] == [2, 2, 2, 2]
    assert sorted(r.conv_id for r in chat_format.unmapped(turns).collect()) == [4, 5, 6, 7]


def test_extra_fields_change_no_layout(spark):
    records = ['{"id":1,"messages":[{"role":"user","content":"q","at":3},{"role":"assistant","content":"a"}],"meta":{"x":[1]}}', '{"prompt":"q","response":"a","score":0.5}', '{"messages":[]}', '{"prompt":"q","answer":"a"}']
    turns = chat_format.turns_of_json(spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string"))
    found = {r.conv_id: r for r in turns.collect()}
    assert all([tuple(t) for t in found[i].turns] == [("user", "q"), ("assistant", "a")] for i in (0, 1))
    assert {r.conv_id: r.paths for r in chat_format.unmapped(turns).collect()} == {2: [], 3: ["answer", "prompt"]}
    typed = spark.createDataFrame([(1, "x", "q", "a")], "conv_id bigint, id string, prompt string, response string")
    assert [tuple(t) for t in chat_format.turns_by_row(typed).first().turns] == [("user", "q"), ("assistant", "a")]


def test_the_fingerprint_selects_the_mapping_of_the_query(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    before = {r.conv_id: r.loss_chars for r in queries.op7_chat_format(spark, str(tmp_path)).collect()}
    monkeypatch.setitem(chat_format.BY_TURN, ("role", "text", "turn"), {"turn": "turn", "role": "role", "text": "concat(text, '!')"})
    after = {r.conv_id: r.loss_chars for r in queries.op7_chat_format(spark, str(tmp_path)).collect()}
    assert before == {1: 1, -7: 21} and after == {1: 2, -7: 22}
    for df in (rows.withColumnRenamed("text", "content"), rows.withColumn("more", F.lit(1))):
        assert sorted((r.turn, r.role) for r in chat_format.canonical_turns(df).collect()) == [(0, "user"), (1, "assistant")]
    monkeypatch.delitem(chat_format.BY_TURN, ("role", "text", "turn"))
    with pytest.raises(ValueError, match="turn"):
        queries.op7_chat_format(spark, str(tmp_path))


def test_further_known_fields_lose_no_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    rows = spark.createDataFrame([(1, 0, "user", "q", "p", "r", "c"), (1, 1, "assistant", "a", "p", "r", "c")], "conv_id bigint, turn bigint, role string, text string, prompt string, response string, content string")
    for df in (rows, rows.drop("content"), rows.drop("prompt")):
        assert [(r.role, r.text) for r in chat_format.canonical_turns(df).orderBy("turn").collect()] == want
    records = ['{"prompt":"q","response":"a","input":""}', '{"instruction":"q","output":"a","prompt":"x"}', '{"prompt":"q","response":"a","completion":"b"}', '{"messages":[{"role":"user","content":"q","text":"t"}]}', '{"prompt":"q","response":"a","system":null}']
    turns = chat_format.turns_of_json(spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string"))
    found = {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in turns.collect()}
    assert found == {0: want, 1: want, 2: None, 3: None, 4: [("system", None), *want]}
    assert {r.conv_id for r in chat_format.unmapped(turns).collect()} == {2, 3}
    with pytest.raises(ValueError, match="completion"):
        chat_format.canonical_turns(spark.createDataFrame([(1, "q", "a", "b")], "conv_id bigint, prompt string, response string, completion string"))


def test_toxicity_ratios_of_any_size_and_tokens_of_any_length(spark, monkeypatch):
    for ratio in (-800.0, -3.0, -1e-9, 0.0, 1e-9, 2.0, 29.0, 31.0, 5000.0):
        plain = math.log((1 - toxicity.BLEND) + toxicity.BLEND * math.exp(ratio)) if ratio < 700 else ratio + math.log(toxicity.BLEND)
        assert math.isclose(toxicity.blended(ratio), plain, rel_tol=1e-9, abs_tol=1e-12)
    tokens = lambda text: [t for part in toxicity.token_windows(text) for t in part]
    text = "a" * 2500 + " b" + "7" * 1500 + "_c.. " + "d" * 300
    monkeypatch.setattr(toxicity, "WINDOW", 100)
    assert tokens(text) == ["a" * 2500, "b", "7" * 1500, "_", "c", ".", ".", "d" * 300]
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(40)], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2500)
    assert toxicity.sample_labelled(docs, labels)[0].groupBy("toxic").count().where("count <> 3").isEmpty()


# Pipeline


def test_pipeline_keeps_clean_documents(spark, tmp_path, model):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice(["an", "re", "ti", "lo", "sh", "e"]) for _ in range(rng.randint(2, 5))) for _ in range(n))
    clean = [say(120) for _ in range(30)]
    item = say(40)
    near = clean[0].split()
    near[60] = "changed"
    texts = clean + [" ".join(near), clean[1], f"{say(50)} {item} {say(50)}", None, "123", f"{say(60)}\n{clean[2]}"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "xx", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = os.path.join(tmp_path, "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    assert sorted(rows) == [*range(30), 35]
    assert all(r.round_trip and r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in rows.values())
    empty = os.path.join(tmp_path, "none")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert pipeline.run(spark, empty).collect() == []
