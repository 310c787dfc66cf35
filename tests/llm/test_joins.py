"""Joins and deduplication against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vendora.llm import chunk_dedup, line_dedup, ngram_join, queries
from vendora.plans.graph import components

DOC = "doc_id bigint, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least_reachable(ids, links):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


def near_copies(rng, n_groups, size, length, edits):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*length))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(*edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def brute_ngram(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = least_reachable(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("short_list", [64, 3])
def test_ngram_join_is_exact(spark, short_list):
    """With short_list 3 nearly every group goes through the long lists."""
    rng = random.Random(short_list)
    texts = near_copies(rng, 6, 12, (30, 120), (0, 6)) + near_copies(rng, 20, 3, (6, 40), (0, 2)) + near_copies(rng, 1, 40, (140, 150), (0, 12))
    shared = " ".join(f"common{i}" for i in range(20))
    texts += [f"{shared} " + " ".join(f"own{i}x{j}" for j in range(60)) for i in range(12)]
    texts += ["", None, "one", "ONE", "a b c d", "A\tb  c\nd", "a b c d e", " \n ", "one"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, DOC), short_list).collect()}
    assert found == brute_ngram(rows)


@pytest.mark.parametrize("short_list", [64, 3])
def test_ngram_join_links_sets_of_unequal_size(spark, short_list):
    """Words appended or deleted at either end: links at exactly 80/100, and pairs just below."""
    rng = random.Random(13)
    texts = []
    for i in range(60):
        n = rng.choice([8, 20, 40, 60])
        base = [f"g{i}w{j}" for j in range(n + 4)]
        more = lambda k: [f"g{i}n{rng.randrange(10**9)}" for _ in range(k)]
        texts.append(base)
        # With five copies the shingles of base are long lists where short_list is 3.
        for _ in range(1 if i % 2 else 5):
            texts.append(base + more(n // 4 + rng.randrange(2)) if i % 3 else more(n // 4) + base)
        if i % 4 == 0:
            texts.append(base[n // 5 + rng.randrange(2) :])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, DOC), short_list).collect()}
    assert found == brute_ngram(rows)


def test_block_keeps_the_links_that_join_components():
    """Two groups of 40 near copies, each set a component: a link less than the sets of a group."""
    rng = np.random.default_rng(8)
    sets = [np.sort(np.concatenate((rng.choice(base, 95, replace=False), rng.integers(2**62, 2**63, 5, dtype=np.uint64)))) for base in (np.arange(i, i + 100, dtype=np.uint64) for i in (0, 10**6)) for _ in range(40)]
    n = len(sets)
    columns = {"cls": pa.array(range(n), pa.int64()), "chk": pa.array(range(n), pa.int64()), "comp": pa.array([7 * i for i in range(n)], pa.int64()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())}
    found = ngram_join._block_search(None, pa.table(columns), pa.table(columns).rename_columns(["q", "qk", "q_comp", "q_shingles"])).to_pylist()
    assert all(ngram_join.reaches(sets[r["a"]], sets[r["b"]]) for r in found)
    every = [(a, b) for a, b in itertools.combinations(range(n), 2) if ngram_join.reaches(sets[a], sets[b])]
    want = least_reachable(range(n), every)
    assert len(every) > 500 and least_reachable(range(n), [(r["a"], r["b"]) for r in found]) == want
    assert len(found) == n - len(set(want.values()))


def test_links_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """A group that its pivots leave in parts, in one block and in several: links of one block are fewer than the copies."""
    rows = list(enumerate(near_copies(random.Random(1), 1, 200, (120, 120), (1, 4))))
    want, made = brute_ngram(rows), []
    before = ngram_join._rest_links
    monkeypatch.setattr(ngram_join, "_rest_links", lambda *x: made.append((out := before(*x)).count()) or out)
    for block in (500_000, 5_000):
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, DOC)).collect()}
        assert found == want
    assert 0 < made[0] < len(rows)


def test_prefixes_of_linked_sets_share_what_is_needed():
    rng = np.random.default_rng(3)
    for a in range(1, 120):
        for b in range(a, a * 5 // 4 + 1):
            shared = -(-4 * (a + b) // 9)
            if shared > a:
                continue
            assert ngram_join.needed(np.int64(a), np.int64(b)) >= max(ngram_join.slack(a), ngram_join.slack(b))
            for _ in range(5):
                order = rng.permutation(a + b - shared)
                x, y = np.sort(order[:a]), np.sort(order[a - shared :])
                both = np.intersect1d(x[: ngram_join.prefix_size(a)], y[: ngram_join.prefix_size(b)])
                assert len(both) >= ngram_join.needed(np.int64(a), np.int64(b))


def test_ngram_join_edges(spark):
    empty = spark.createDataFrame([], DOC)
    assert ngram_join.ngram_components(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, None)], DOC).selectExpr("*", "1 n_shingles", "'x' bucket", "2 cls")
    found = sorted(map(tuple, ngram_join.ngram_components(rows).collect()), key=str)
    assert found == sorted([(None, 2, None), (2, 2, 2), (2, 2, 2), (1, 0, 1)], key=str)


def test_divide_skip_counts():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, len(lists))
        counts = {v: sum(v in x for x in lists) for v in range(30)}
        assert ngram_join.divide_skip(lists, least) == {v: c for v, c in counts.items() if c >= least}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(400, 440)]
    want = least_reachable({x for p in links for x in p}, links)
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def mutate(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("abcé"))
        elif out and kind == 1:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice("abcé")
    return "".join(out)


@pytest.mark.parametrize("most", [0, 1, 2, 4])
def test_banded_edit_distance(most):
    rng = random.Random(most)
    pairs = [(a := "".join(rng.choice("abé") for _ in range(rng.randint(0, 30))), mutate(rng, a, rng.randint(0, most + 2))) for _ in range(300)]
    code = lambda t: np.array([ord(c) for c in t], np.uint32)
    found = line_dedup.edit_distances([code(a) for a, _ in pairs], [code(b) for _, b in pairs], most)
    assert found.tolist() == [min(edit_distance(a, b), most + 1) for a, b in pairs]


def brute_lines(rows, edits, least):
    places = [(i, n, line) for i, t in rows for n, line in enumerate((t or "").split("\n")) if t and len(line) >= least]
    kinds = sorted({p[2] for p in places})
    links = [(a, b) for a, b in itertools.combinations(kinds, 2) if abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits]
    comp = least_reachable(kinds, links)
    first = {}
    for i, n, line in sorted(places):
        first.setdefault(comp[line], (i, n))
    return {(i, n) for i, n, line in places if first[comp[line]] != (i, n)}


@pytest.mark.parametrize("short_list,block", [(64, 2048), (2, 2048), (2, 3)])
def test_line_dedup_is_exact(spark, short_list, block, monkeypatch):
    """With short_list 2 most pairs go through the long lists, with blocks of 3 these are spread over cells."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    rng = random.Random(11)
    bases = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(8, 40))) for _ in range(30)]
    rows = [(i, "\n".join(mutate(rng, rng.choice(bases), rng.randint(0, 4)) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 3000 + "\n" + "x" * 2999 + "y"), (104, rows[3][1])]
    found = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, DOC), 2, 8, short_list).collect()}
    assert found == brute_lines(rows, 2, 8)


@pytest.mark.parametrize("owners,asking", [(1, 0), (3, 0), (4, 9), (10, 1), (7, 30), (12, 12)])
def test_every_pair_with_an_owner_meets_in_one_cell(monkeypatch, owners, asking):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 3)
    x = np.zeros(owners + asking, line_dedup.LISTED)
    x["h"] = x["place"] = np.arange(len(x))
    x["key"], x["owners"], x["lines"] = 77, owners, len(x)
    cells = np.concatenate(list(line_dedup._cells(x)))
    met = []
    for c in np.unique(cells["cell"]):
        mine = cells[cells["cell"] == c]
        assert len(mine) <= 6
        met += {tuple(sorted((int(a), int(b)))) for a in mine["h"][mine["role"] & 1 == 1] for b in mine["h"][mine["role"] & 2 == 2] if a != b}
    assert sorted(met) == [(a, b) for a in range(owners) for b in range(a + 1, len(x))]


def test_line_dedup_edges(spark):
    line = "a line that is long enough"
    rows = [(1, f"{line}\nshort\n{line}"), (1, f"{line}\nshort\n{line}"), (2, f"short\n{line}!"), (None, line), (3, None)]
    found = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC).selectExpr("*", "0 line", "'' h")).collect()}
    assert found == {(1, f"{line}\nshort", 3, 1), (2, "short", 2, 1), (None, line, 1, 0), (3, None, 0, 0)}
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).collect() == []


def plain_chunks(raw):
    """(start, end) of the chunks of one text, byte by byte."""
    gear, cuts, mark = 0, [], -chunk_dedup.MIN_CHUNK
    for i, x in enumerate(raw):
        gear = (gear << 1 & 0xFFFF) + int(chunk_dedup._GEAR[x]) & 0xFFFF
        if gear >> 16 - chunk_dedup.CUT_BITS == 0:
            if i + 1 - mark >= chunk_dedup.MIN_CHUNK:
                cuts.append(i + 1)
            mark = i + 1

    def whole(at):
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    bounds = sorted({0, len(raw), *map(whole, cuts)})
    for s, e in list(zip(bounds, bounds[1:], strict=False)):
        bounds += [whole(x) for x in range(s + chunk_dedup.MAX_CHUNK, e, chunk_dedup.MAX_CHUNK)]
    bounds = sorted(set(bounds))
    return list(zip(bounds, bounds[1:], strict=False))


def brute_spans(rows, least, within=True):
    """Runs of repeated units with one source at one distance; rows of one doc_id must have one text."""
    first, marked = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        own = plain_chunks(raw) if raw else []
        units = [(own[j][0], own[j + 1][1]) for j in range(len(own) - 1)] + [c for c in own if len(own) == 1 or c[1] - c[0] >= least]
        for s, e in sorted(units):
            lead = first.setdefault(raw[s:e], (i, s))
            if lead != (i, s) and (within or lead[0] != i):
                marked.setdefault(i, {})[s, e] = lead
    out = set()
    for i, found in marked.items():
        groups, last = [], -1
        for s, e in sorted(found):
            if s > last:
                groups.append([])
            groups[-1].append((s, e))
            last = max(last, e)
        for units in groups:
            if max(e for _, e in units) - units[0][0] < least:
                continue
            source = [(found[u][0], u[0] - found[u][1]) for u in units]
            tally = Counter(source)
            most = sorted(tally, key=lambda d: (-tally[d], d))[:2]
            sources = {}
            for k, (u, d) in enumerate(zip(units, source, strict=True)):
                before = next((x for x in reversed(source[:k]) if x != d), d)
                after = next((x for x in source[k:] if x != d), d)
                for doc, shift in {d, before, after, *most}:
                    if (doc, shift) == d or marked.get(doc, {}).get((u[0] - shift, u[1] - shift)) == found[u]:
                        sources.setdefault((doc, shift), []).append(u)
            spans = []
            for (doc, shift), own in sorted(sources.items()):
                for s, e in sorted(own):
                    if spans and spans[-1][2:] == (doc, shift) and s <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(e, spans[-1][1]), doc, shift)
                    else:
                        spans.append((s, e, doc, shift))
            end = -1
            for s, e, doc, shift in sorted((x for x in spans if x[1] - x[0] >= least), key=lambda x: (x[0], -x[1], x[2], x[0] - x[3])):
                if e > end:
                    out.add((i, s, e - s, doc))
                    end = e
    return out


def assert_sources(df, rows):
    """Every span stands at its source."""
    raw = {i: (t or "").encode() for i, t in rows}
    for r in df.collect():
        assert raw[r.doc_id][r.start : r.start + r.n_bytes] == raw[r.first_doc_id][r.first_start : r.first_start + r.n_bytes]
        assert (r.first_doc_id, r.first_start) != (r.doc_id, r.start)


def spans_of(df):
    return {tuple(r)[:4] for r in df.collect()}


@pytest.mark.parametrize("within", [True, False])
def test_substring_dedup_matches_brute_force(spark, within):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(5)]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 80))) + " " + rng.choice(passages) + " " + word()) for i in range(40)]
    rows += [(50, None), (51, ""), (52, rows[0][1]), (53, "ab" * 20_000), (54, "é" * 2000), (55, "short"), (56, "short"), (57, rows[3][1] + " " + rows[3][1])]
    spans = chunk_dedup.repeated_spans(spark.createDataFrame(rows, DOC).selectExpr("*", "1 text_hash", "2 first_doc_id"), within=within)
    found = spans_of(spans)
    assert_sources(spans, rows)
    assert found == brute_spans(rows, chunk_dedup.MIN_SPAN, within)
    repeated = {i for i, t in rows if t and any(p in t for p in passages)}
    assert len(repeated - {r[0] for r in found}) <= len(passages)  # each passage's first document keeps it


def test_chunks_of_long_texts_and_of_neighbours(monkeypatch):
    """Cuts depend on a text alone, not on what lies beside it or on the windows it is worked off in."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefg é\n") for _ in range(n)).encode() for n in (3000, 7, 900, 1, 40, 2500)]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    start, end, row = chunk_dedup.cut_points(np.frombuffer(b"".join(texts), np.uint8), bounds)
    for i, raw in enumerate(texts):
        want = plain_chunks(raw)
        assert [(int(s - bounds[i]), int(e - bounds[i])) for s, e, r in zip(start, end, row, strict=True) if r == i] == want
        with monkeypatch.context() as m:
            m.setattr(chunk_dedup, "CHUNK_BYTES", 100)
            s, e, _ = chunk_dedup.cut_points(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            assert list(zip(s.tolist(), e.tolist(), strict=True)) == want


def test_insertions_move_no_later_cut():
    rng = random.Random(3)
    raw = "".join(rng.choice("abcdefghij ") for _ in range(20_000)).encode()
    moved = raw[:5000] + b"inserted" + raw[5000:]
    ends = lambda x, low, high: [e for _, e in plain_chunks(x) if low <= e < high]
    assert ends(raw, 0, 5000) == ends(moved, 0, 5000)
    assert [e + 8 for e in ends(raw, 5024, 30_000)] == ends(moved, 5032, 30_000)


def test_registered_substring_dedup_reports_repeats_within_a_document(spark, tmp_path):
    rng = random.Random(17)
    say = lambda n: " ".join("".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 9))) for _ in range(n))
    body, shared = say(200), say(60)
    rows = [(1, f"{say(20)} {shared}"), (2, f"{say(10)} {body} {say(15)} {body} {say(5)}"), (3, f"{body} {shared} {say(9)} {shared}"), (4, say(80))]
    # Chunks that come first in the document and in an earlier one take turns in its second half.
    mixed = " ".join(x for i in range(0, 60, 6) for x in (" ".join(shared.split()[i : i + 6]), say(6)))
    rows += [(5, f"{mixed} {say(9)} {mixed}")]
    # Two passages that have never stood side by side are two spans.
    rows += [(6, f"{shared} {body}")]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spans = queries.op10_substring_dedup(spark, str(tmp_path))
    found = spans_of(spans)
    assert_sources(spans, rows)
    assert found == brute_spans(rows, chunk_dedup.MIN_SPAN)
    own = [r for r in found if r[0] == 2]
    assert [r[3] for r in own] == [2] and own[0][2] > 0.8 * len(body.encode())
    last = max(r for r in found if r[0] == 5)
    assert last[2] > 0.8 * len(mixed.encode())
    assert len([r for r in found if r[0] == 6]) == 2


def test_rows_of_one_doc_id_keep_their_own_substrings(spark):
    """(0, A), (1, A), (1, B): B is nowhere else, so nothing of it may go, whatever A's places are."""
    rng = random.Random(18)
    say = lambda n: " ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randint(1, 9))) for _ in range(n))
    a, b = say(90), say(90)
    rows = spark.createDataFrame([(0, a), (1, a), (1, b), (1, b), (None, a)], DOC)
    left = sorted((r.doc_id is None, r.doc_id, r.text == b, len(r.text)) for r in chunk_dedup.dedup_substrings(rows).collect())
    assert [x[3] for x in left if x[2]] == [len(b)] * 2
    assert [x[3] for x in left if x[1] == 0] == [len(a)] and [x[3] for x in left if x[0]] == [len(a)]
    assert [x[3] for x in left if x[1] == 1 and not x[2]][0] < 80


def test_rows_of_one_doc_id_keep_their_own_lines(spark):
    a, b = "an ordinary line of A, thirty!", "something else that B has only"
    assert len(a) == len(b) == 30
    rows = spark.createDataFrame([(0, a), (1, a), (1, b)], DOC)
    assert sorted(r.text for r in line_dedup.drop_repeated_lines(rows).collect()) == [a, b]
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(rows).collect()) == [(0, a), (1, ""), (1, b)]


def test_lines_with_equal_polynomials_differ(spark):
    """The Thue-Morse word and its complement have equal polynomials modulo 2**64, for any odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = spark.createDataFrame([(0, word), (1, other), (2, word)], DOC)
    assert {(r.doc_id, r.line) for r in line_dedup.repeated_lines(rows).collect()} == {(2, 0)}


def test_rows_of_one_doc_id_and_identical_rows_in_the_join_stage(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog today", "a wholly different text of some nine or ten words", "one two three four five six seven eight nine ten")
    rows = [(0, a, 0), (1, a, 1), (1, b, 2), (2, c, 3), (2, c, 4), (2, c, 5), (5, None, 6), (5, None, 7), (None, a, 8), (None, a, 9), (6, "", 10), (3, b, 11)]
    docs = spark.createDataFrame(rows, DOC + ", n bigint").selectExpr("*", "1 vertex", "2 stays", "3 count", "4 _gone_from", "5 first")
    kept = ngram_join.keep_first_of_components(docs)
    assert kept.columns == docs.columns
    found = [r.n for r in kept.collect()]
    assert len(found) == len(set(found)) and len({3, 4, 5} & set(found)) == 1
    assert set(found) - {3, 4, 5} == {0, 2, 6, 7, 8, 9, 10}
    comps = sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_components(docs.where("doc_id < 4")).collect())
    assert comps == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 2), (2, 2), (3, 1)]


def test_columns_of_the_line_stage_may_have_any_names(spark):
    line = "a line that is long enough"
    docs = spark.createDataFrame([(1, line, 26), (2, f"{line}\nand another one of its own", 53), (3, line, 26), (4, None, 0)], DOC + ", n_chars int").selectExpr("*", "1 _gone", "2 _gone_from", "3 _gone_text", "4 line", "5 h", "6 text_hash")
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect() if r.text) == [(1, line, 26), (2, "and another one of its own", 26)]


def test_very_long_texts(spark):
    """20 MB in one text: of many lines, of one line, and without any space."""
    rng = random.Random(6)
    said = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(20_000))
    many = "\n".join(f"{said[i % 90_000 :][:90]} {i}" for i in range(0, 6_600_000, 30))
    assert len(many) > 2e7
    rows = [(1, many), (2, many), (3, said.replace(" ", "") * 180), (4, said * 150), (5, said.replace(" ", "") * 180)]
    docs = spark.createDataFrame(rows[:2], DOC).unionByName(spark.createDataFrame(rows[2:], DOC)).repartition(5)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}
    spans = chunk_dedup.repeated_spans(docs).groupBy("doc_id").sum("n_bytes").collect()
    assert all(r[1] > 0.9 * len(rows[r.doc_id - 1][1]) for r in spans if r.doc_id in (2, 5))


def test_substring_dedup_edges(spark):
    assert chunk_dedup.repeated_spans(spark.createDataFrame([], DOC)).collect() == []
    text = " ".join(f"word{i}" for i in range(100))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "x " + text)], DOC)
    found = chunk_dedup.repeated_spans(rows).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(2, 1)}
    assert chunk_dedup.dedup_substrings(spark.createDataFrame([], DOC)).collect() == []
    left = {r.doc_id: r.text for r in chunk_dedup.dedup_substrings(rows).collect()}
    assert left[1] == left[None] == text and left[2].startswith("x ") and len(left[2]) < 60
