"""The pipeline against plain stages one after another, and very long texts of the operators on texts."""

import random

import pytest
from test_joins import brute_lines, brute_ngram, mutate
from test_texts import plain_leaks

from vendora.llm import decontaminate, line_dedup, piece_codec, queries, token_counts

DOC = "doc_id bigint, text string"


def plain_pipeline(docs, items, library):
    """doc_id -> ids, by brute force: letters, near lines, near copies, leaks, the library's pieces."""
    rows = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    gone = brute_lines(rows, line_dedup.MAX_EDITS, line_dedup.MIN_CHARS)
    cut = []
    for i, t in rows:
        kept = [line for n, line in enumerate(t.split("\n")) if (i, n) not in gone]
        if kept:
            cut.append((i, "\n".join(kept)))
    of = brute_ngram(cut)
    first = [(i, t) for i, t in cut if of[i][1] == i]
    leaked = {d for d, *_ in plain_leaks(first, items)}
    return {i: [*library.encode(t), library.eos_id()] for i, t in first if i not in leaked}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_pipeline_equals_plain_stages(spark, tmp_path, seed):
    import public_tokenizers
    import sentencepiece

    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choice(["an", "re", "ti", "lo", "é", "sh", "e"]) for _ in range(rng.randint(1, 5))) for _ in range(n))
    lines = [say(rng.randint(5, 14)) for _ in range(12)]
    items = [(i, f"{say(rng.randint(10, 30))}. {say(rng.randint(2, 8))}") for i in range(5)]
    texts = []
    for i in range(70):
        parts = [say(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), mutate(rng, rng.choice(lines), rng.randint(0, 3)))
        if i % 7 == 0:
            parts.append(rng.choice(items)[1])
        if i % 5 == 0 and texts:
            words = (rng.choice(texts) or "x").replace("\n", " ").split(" ")
            words[rng.randrange(len(words))] = "other"
            parts = [" ".join(words)]
        texts.append("\n".join(parts))
    texts += [None, "", "12 34", texts[1], texts[2] + "\n\n", "\n".join(lines), items[0][1], "a"]
    docs = list(enumerate(texts))
    rows = [(i, t, [None, "en", "xx"][i % 3], "s", len(t or ""), "clash") for i, t in docs]
    spark.createDataFrame(rows, DOC + ", lang string, source string, n_chars bigint, line string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = plain_pipeline(docs, items, library)
    assert 20 < len(want) < len(docs) - 10
    assert {r.doc_id: list(r.ids) for r in pipeline.run(spark, str(tmp_path)).collect()} == want


@pytest.fixture(scope="module")
def long_texts():
    """20 MB in one text: of many lines, of one line, and without any space."""
    rng = random.Random(6)
    said = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(20_000))
    many = "\n".join(f"{said[i % 90_000 :][:90]} {i}" for i in range(0, 6_600_000, 30))
    assert len(many) > 2e7
    return [(1, many), (2, said * 160), (3, said.replace(" ", "") * 180)]


def test_lines_of_very_long_texts(spark, long_texts):
    docs = spark.createDataFrame([long_texts[0], long_texts[2], (4, long_texts[2][1] + "x"), (5, long_texts[0][1][-1000:])], DOC)
    found = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped").collect()}
    n = long_texts[0][1].count("\n") + 1
    assert found[1][0] == n and found[3] == (1, 0)
    assert found[4] == (1, 1)  # one letter more than an earlier line
    assert found[5][1] >= found[5][0] - 1  # its first line is cut


def test_pieces_and_counts_of_very_long_texts(spark, long_texts):
    docs = spark.createDataFrame(long_texts, DOC)
    for r in piece_codec.encode_documents(docs, queries.piece_model()).selectExpr("doc_id", "n_tokens", "round_trip").collect():
        assert r.round_trip and r.n_tokens > 1_000_000
    counted = token_counts.count_tokens(docs, *token_counts.pieces_of_model(queries.piece_model()))
    assert counted.count() == 3 and counted.where("n_words < 1").isEmpty()


def test_leaks_in_very_long_texts(spark, long_texts):
    item = "zq " + " ".join(f"k{i} v{i}" for i in range(20)) + ". the answer is here"
    half = len(long_texts[1][1]) // 2
    docs = spark.createDataFrame([*long_texts[:2], (7, f"{long_texts[1][1][:half]} {item} {long_texts[1][1][half:]}")], DOC)
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(7, 1)]
