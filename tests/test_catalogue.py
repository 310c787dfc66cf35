"""Catalogue operators on small fixtures."""

import csv
import json
import random
import re
import tracemalloc
import zipfile
from collections import Counter
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vendora.functions import columns as C
from vendora.operators import analytics, enrich, ingest, lifecycle, reading, templates, writes
from vendora.plans import checkpoints, registry
from vendora.sources import catalogue, delimited, html, pages, workbook

NO_PRODUCTS = "tenant bigint, id bigint, sku string, ean string, nome_base string, marca string"


def imported(spark, header, rows, products=None, mapping=None):
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row bigint, " + ", ".join(f"`{h}` string" for h in header))
    before = spark.createDataFrame(products or [], NO_PRODUCTS)
    return ingest.import_rows(raw, header, before, 1, "row", mapping, product_type=3)


def test_import_valid_and_empty_row(spark):
    state, errors, audit = imported(spark, ["nome", "sku"], [("Produto Válido", "123"), ("", " nan ")])
    assert [(r.sku, r.nome_base, r.change) for r in state.collect()] == [("123", "Produto Válido", "created")]
    assert [(r.error, r.duplicado, r.linha_original, r.product_type_id) for r in errors.collect()] == [(ingest.REASON, False, {"nome": "", "sku": " nan "}, 3)]
    assert sorted((r.log, r.action) for r in audit.collect()) == [("history", "CRIACAO"), ("usage", "CRIACAO_PRODUTO")]


def test_import_duplicates(spark):
    state, errors, _ = imported(spark, ["nome", "sku", "ean"], [("ProdA", "111", "999"), ("ProdB", "111", "888"), ("ProdC", "222", "999")])
    assert [r.nome_base for r in state.collect()] == ["ProdA"]
    assert sorted((r.row, r.duplicado, r.linha_original["sku_original"]) for r in errors.collect()) == [(1, True, "111"), (2, True, "222")]


def test_import_updates_by_sku(spark):
    result = imported(spark, ["nome", "sku"], [("Novo", "999")], [(1, 5, "999", None, "Antigo", None), (2, 6, "999", None, "Outro", None)])
    state, _, audit = result
    assert [(r.id, r.before.nome_base, r.after.nome_base) for r in result.updates().collect()] == [(5, "Antigo", "Novo")]
    assert sorted((r.tenant, r.id, r.nome_base, r.change) for r in state.collect()) == [(1, 5, "Novo", "updated"), (2, 6, "Outro", "unchanged")]
    assert audit.count() == 0


def test_import_keeps_every_field_and_reader_errors(spark):
    header = ["nome", "sku", "categoria", "descricao", "erro_processamento_csv", "Cor"]
    raw = spark.createDataFrame([(1, "P", "1", "Cat", "Desc", None, "x"), (2, "Q", "2", None, None, "bad line", None), (3, None, None, None, None, None, "só a cor")], "row bigint, " + ", ".join(f"`{h}` string" for h in header))
    products = spark.createDataFrame([], "tenant bigint, id bigint, sku string, ean string, nome_base string, descricao_original string, marca string, categoria_original string, fornecedor_id int, product_type_id int, preco_venda double")
    state, errors, _ = ingest.import_rows(raw, header, products, 1, "row", supplier=7)
    found = sorted((r.nome_base, r.descricao_original, r.categoria_original, r.fornecedor_id, r.product_type_id) for r in state.collect())
    assert found == [("P", "Desc", "Cat", 7, None), ("só a cor", None, None, 7, None)]
    assert [(r.row, r.error) for r in errors.collect()] == [(2, "bad line")]


def plain_greedy(rows):
    taken, out = {}, set()
    for t, o, *keys in sorted(rows, key=lambda r: r[:2]):
        own = [(t, i, k) for i, k in enumerate(keys) if k is not None]
        if not any(taken.get(k) for k in own):
            taken |= dict.fromkeys(own, True)
            out.add((t, o))
    return out


@pytest.mark.parametrize("most", [500_000, 20])
def test_greedy_dedup_is_the_sequential_rule(spark, most):
    """With most = 20 the larger tenants are split into groups that share no key."""
    rng = random.Random(1)
    rows = [(t, o, str(rng.randrange(n)) if rng.random() < 0.8 else None, str(rng.randrange(n)) if rng.random() < 0.8 else None) for t, n in ((1, 400), (2, 30), (3, 5)) for o in range(n // 2 + 10)]
    rows += [(4, o, f"s{o // 2}", f"e{(o + 1) // 2}") for o in range(60)]  # one long chain
    df = spark.createDataFrame(rows, "t int, o int, sku string, ean string")
    marked = ingest.greedy_dedup(df, "t", "o", ["sku", "ean"], most).collect()
    assert len(marked) == len(rows) and {(r.t, r.o) for r in marked if r.accepted} == plain_greedy(rows)


def plain_one_by_one(products, rows):
    """products: (tenant, id, sku, ean, x); rows: (tenant, row_no, sku, ean, x, given)."""
    state = [dict(zip(("t", "id", "sku", "ean", "x"), p, strict=True)) | {"c": "unchanged"} for p in sorted(products, key=lambda p: p[1])]
    new = []
    for t, n, *values, given in sorted(rows, key=lambda r: r[:2]):
        row = dict(zip(("sku", "ean", "x"), values, strict=True))
        key = "sku" if row["sku"] else "ean" if row["ean"] else None
        hit = next((p for p in state + new if key and p["t"] == t and p[key] == row[key]), None)
        if hit is None:
            new.append({c: row[c] if c in given else None for c in row} | {"t": t, "n": n, "c": "created"})
        else:
            hit |= {c: row[c] for c in given}
            hit["c"] = "updated" if hit["c"] == "unchanged" else hit["c"]
    top = max((p["id"] for p in state), default=0)
    for i, p in enumerate(sorted(new, key=lambda p: (p["t"], p["n"])), 1):
        p["id"] = top + i
    return sorted(((p["t"], p["id"], p["sku"], p["ean"], p["x"], p["c"]) for p in state + new), key=str)


@pytest.mark.parametrize("most", [500_000, 15])
def test_get_or_create_is_one_after_another(spark, most):
    rng = random.Random(2)
    pick = lambda n: rng.choice([None, "", *map(str, range(n))])
    products = [(t, t * 100 + i, str(i) if i % 3 else None, str(i % 5) if i % 2 else None, "old") for t in (1, 2) for i in range(12)]
    rows = [(t, n, pick(14), pick(9), f"x{n}", rng.sample(["sku", "ean", "x"], rng.randint(1, 3))) for t in (1, 2, 3) for n in range(50)]
    # A row finds by its keys, whether it sets them or not.
    found = ingest.get_or_create(spark.createDataFrame(products, "tenant bigint, id bigint, sku string, ean string, x string"), spark.createDataFrame(rows, "tenant bigint, row_no bigint, sku string, ean string, x string, given array<string>"), ["x"], most)
    assert sorted(map(tuple, found.select("tenant", "id", "sku", "ean", "x", "change").collect()), key=str) == plain_one_by_one(products, rows)


def test_two_rows_of_a_new_sku_are_one_product(spark):
    products = spark.createDataFrame([], "tenant bigint, id bigint, sku string, ean string, x string")
    rows = spark.createDataFrame([(1, 0, "A", None, "first"), (1, 1, "A", None, "second")], "tenant bigint, row_no bigint, sku string, ean string, x string")
    assert [(r.id, r.x, r.change) for r in ingest.get_or_create(products, rows, ["x"]).collect()] == [(1, "second", "created")]


def test_greedy_dedup_depends_on_order(spark):
    rows = spark.createDataFrame([(1, 1, "111", "999"), (1, 2, "111", "888"), (1, 3, "222", "999"), (1, 4, "333", "888"), (2, 1, "111", None), (2, 2, None, None), (2, 3, None, None)], "t int, o int, sku string, ean string")
    found = {(r.t, r.o) for r in ingest.greedy_dedup(rows, "t", "o", ["sku", "ean"]).where("accepted").collect()}
    assert found == {(1, 1), (1, 4), (2, 1), (2, 2), (2, 3)}


def test_standardise_headers_and_rescue(spark):
    raw = spark.createDataFrame([("  A ", None, "x"), (None, None, "y"), (None, "S", None)], "` Nome ` string, codigo string, `Cor ` string")
    rows = ingest.standardise(raw, raw.columns).collect()
    assert [(r.nome_base, r.sku_original, r.leftovers, r.reason) for r in rows] == [("A", None, {"Cor": "x"}, None), ("y", None, {"Cor": "y"}, None), (None, "S", {}, None)]


def test_mapping_overrides_synonyms(spark):
    raw = spark.createDataFrame([("A", "B")], "sku string, marca string")
    row = ingest.standardise(raw, raw.columns, {"SKU": "nome_base", "marca": "ean_original"}).first()
    assert (row.nome_base, row.sku_original, row.ean_original, row.marca) == ("A", None, "B", None)


@pytest.mark.parametrize("skip,number", [(0, 1), (5, 1), (10, 2)])
def test_page_numbers(spark, skip, number):
    assert reading.page_number(skip, 10) == number


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        reading.page(spark.range(3), [F.asc("id")], 0, 0)
    with pytest.raises(ValueError):
        reading.page(spark.range(3), [F.asc("id")], -1, 10)


def test_tenant_scope(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "id int, user_id int")
    assert reading.tenant(df, "user_id", None).count() == 0
    assert reading.tenant(df, "user_id", None, open_without_user=True).count() == 2
    assert reading.tenant(df, "user_id", 2).first().id == 2
    assert reading.tenant(df, "user_id", 2, admin=True).count() == 2


def test_credit_check(spark):
    usage = spark.sql("select 1 user_id, timestamp_ntz '2024-01-10 00:00:00' ts from range(4) union all select 2, timestamp_ntz '2024-01-31 00:00:00' from range(5)")
    users = spark.createDataFrame([(1, "p", 5), (2, "p", 5)], "user_id int, plan string, user_limit int")
    limits = spark.createDataFrame([("p", 100)], "plan string, plan_limit int")
    found = {r.user_id: r.enough for r in analytics.credit_check(users, limits, usage, 1, "2024-01-31").collect()}
    assert found == {1: True, 2: False}


def test_partial_update_keeps_unset_and_writes_null(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    patch = spark.createDataFrame([(1, None, 9, True, False)], "id int, x string, y int, set_x boolean, set_y boolean")
    assert sorted(map(tuple, ingest.patched(df, patch, "id", ["x", "y"]).collect())) == [(1, None, 1), (2, "b", 2)]


def test_seed_twice(spark):
    df, seeds = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a",), ("b",)], "k string")
    once = ingest.seeded(df, seeds, "k")
    assert sorted(r.k for r in ingest.seeded(once, seeds, "k").collect()) == ["a", "b"]


def test_log_progress_and_summary(spark):
    df = spark.createDataFrame([(1, None)], "id int, log array<struct<timestamp:string,actor:string,action:string>>")
    twice = lifecycle.with_log_entry(lifecycle.with_log_entry(df, "log", "u", "a", "t0"), "log", "u", "b", "t1").first()
    assert [x.action for x in twice.log] == ["a", "b"]
    files = spark.createDataFrame([("IMPORTED", 3, 3), ("PROCESSING", 3, 1)], "status string, total_pages int, pages_processed int")
    assert [(r.left, r.done) for r in lifecycle.progress(files).collect()] == [(0, True), (2, False)]
    changes, errors = spark.createDataFrame([("created",), ("updated",), ("created",)], "change string"), spark.range(4)
    assert tuple(lifecycle.result_summary(changes, errors).first()) == (2, 1, 4)


@pytest.mark.parametrize("encoding,sep,row", [("utf-8", ",", "A,Bé"), ("latin-1", ";", "C;Dé"), ("cp1252", "\t", "E\tFé")])
def test_delimited_files(spark, tmp_path, encoding, sep, row):
    path = tmp_path / "f.csv"
    path.write_bytes(f"nome_base{sep}marca\n{row}\n".encode(encoding))
    rows = delimited.read_delimited(spark, str(path))
    headers, head = delimited.preview(rows)
    assert headers == ["nome_base", "marca"]
    assert tuple(head.first()) == tuple(row.split(sep))


def test_delimited_rows_of_other_widths_and_files_of_other_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('nome,sku,nome\nA,1,last\nB\n\nC,3,z,more,"x, ""y"""\n"two\nlines",4,w\n'.encode())
    (tmp_path / "b.csv").write_bytes("\ufeffnome;cor\nD;azulão\n".encode())
    (tmp_path / "c.csv").write_bytes("nome\tcor\nE€\tpreço\n".encode("cp1252"))
    rows = delimited.read_delimited(spark, str(tmp_path), surplus=True)
    found = {r.nome: r for r in rows.collect()}
    assert set(found) == {"last", None, "z", "w", "D", "E€"}
    assert found["z"].sku == "3" and delimited.surplus_cells(found["z"]["None"]) == ["more", 'x, "y"']
    assert found["last"]["None"] is None and (found["D"].cor, found["E€"].cor, found["D"].sku) == ("azulão", "preço", None)
    assert found[None].sku is None
    order = [r.sku for r in rows.where("sku is not null").orderBy("_file", "_row").collect()]
    assert order == ["1", "3", "4"]
    plain = delimited.read_delimited(spark, str(tmp_path / "b.csv"), multi_line=False)
    assert [tuple(r) for r in plain.select("nome", "cor").collect()] == [("D", "azulão")]
    with pytest.raises(FileNotFoundError):
        delimited.read_delimited(spark, str(tmp_path / "none*.csv"))


def test_the_head_of_a_large_file_is_enough(spark, tmp_path):
    path = tmp_path / "large.csv"
    path.write_bytes(b"nome;sku\n" + b"abc;1\n" * 100_000)
    assert delimited.head_of(spark, str(path)) == path.read_bytes()[: delimited.SAMPLE_BYTES]
    rows = delimited.read_delimited(spark, str(path), multi_line=False)
    assert rows.count() == 100_000 and rows.columns == ["nome", "sku", "_file", "_row"]


def workbook_file(path, sheets):
    """A minimal xlsx: shared strings for the first sheet, inline ones and numbers for the others."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        shared = []
        for i, rows in enumerate(sheets.values()):
            body = ""
            for y, row in enumerate(rows, 1):
                cells = ""
                for x, value in enumerate(row):
                    at = f'{"ABCDEFGH"[x]}{y}'
                    if isinstance(value, int):
                        cells += f'<c r="{at}"><v>{value}</v></c>'
                    elif value and i == 0:
                        cells += f'<c r="{at}" t="s"><v>{len(shared)}</v></c>'
                        shared.append(value)
                    elif value:
                        cells += f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>'
                body += f'<row r="{y}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")


def test_workbooks_and_dispatch(spark, tmp_path):
    path = str(tmp_path / "f.xlsx")
    workbook_file(path, {"Primeira": [["nome", "sku"], ["A", "A1"], [None, None], ["B", 7]], "Segunda": [["sku", "nome"], ["C1", "C"]]})
    rows = workbook.read_workbook(spark, path)
    assert sorted((r.sheet, r.row, r.cells["nome"], r.cells["sku"]) for r in rows.collect()) == [("Primeira", 0, "A", "A1"), ("Primeira", 2, "B", "7"), ("Segunda", 0, "C", "C1")]
    assert [r.cells["nome"] for r in workbook.read_workbook(spark, path, "Segunda").collect()] == ["C"]
    table = catalogue.read_file(spark, path)
    assert [r.nome for r in table.orderBy("_row").collect()] == ["A", "B", "C"]
    headers, head = catalogue.preview_file(spark, path)
    assert set(headers) == {"nome", "sku"} and sorted(r.nome for r in head.collect()) == ["A", "B"]
    (tmp_path / "g.csv").write_text("nome,sku\nX,1\n")
    assert catalogue.preview_file(spark, str(tmp_path / "g.csv"))[1].first().nome == "X"
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    assert list(workbook.read_workbook(spark, str(tmp_path / "bad.xlsx")).first().cells) == ["erro_processamento_excel"]
    assert "erro_processamento_excel" in catalogue.read_file(spark, str(tmp_path / "bad.xlsx")).columns
    for other in ("a.txt", "a.pdf"):
        with pytest.raises(ValueError):
            catalogue.read_file(spark, other)


def test_pages_without_tables_and_regions(spark):
    kind = "page int, text string, tables array<array<array<string>>>"
    rows = spark.createDataFrame([(1, "A", None), (2, "B", []), (3, "C", None), (4, " ", None)], kind)
    assert sorted((r.page, *r.leftovers.items()) for r in pages.page_texts(rows, [1, 3, 4]).collect()) == [(1, ("texto_completo_pagina_1", "A")), (3, ("texto_completo_pagina_3", "C"))]
    grid = spark.createDataFrame([(2, "x", [[["A", "B"], ["1", "2"]]])], kind)
    full = pages.full_page(grid).first()
    assert full.table == [["1", "2"]] and full.text == "x"
    assert [(r.headers, r.rows) for r in pages.single_page(grid).collect()] == [(["A", "B"], [["1", "2"]])]
    empty = spark.createDataFrame([(1, "", None)], kind)
    assert pages.region_pairs(empty).count() == 0
    assert [(r.headers, r.rows) for r in pages.region_rows(empty).collect()] == [([], [])]
    regions = spark.createDataFrame([(i, f"Nome: P{i}\nMarca: M{i}", None) for i in range(2)], kind)
    assert sorted((r.page, r.pairs["Nome"], r.pairs["Marca"]) for r in pages.region_pairs(regions).collect()) == [(0, "P0", "M0"), (1, "P1", "M1")]


def test_page_filters_and_previews(spark):
    kind = "doc int, page int, text string, tables array<array<array<string>>>"
    table = [["A", " "], ["1", "2"], ["only one"]]
    rows = spark.createDataFrame([(1, 1, "one\ntwo\nthree\nfour", [table]), (1, 2, None, [table, [["A", "A"], ["x", "y"]]]), (2, 1, "text", [[["head"]]]), (2, 2, "", None)], kind)
    assert sorted((r.page, r.table, r.row, *sorted(r.cells.items())) for r in pages.table_rows(rows.where("doc = 1"), [2]).collect()) == [(2, 0, 0, ("A", "1"), ("coluna_vazia_1", "2")), (2, 1, 0, ("A", "y"))]
    found = sorted((r.doc, r.page, r.table is None) for r in pages.document_rows(rows, "doc").collect())
    assert found == [(1, 1, False), (1, 2, False), (1, 2, False), (2, 1, True)]
    first = pages.preview(rows.where("doc = 1"), 1, 1).collect()
    assert [(r.page, r.has_table, r.snippet) for r in first] == [(1, True, "one\ntwo\nthree")]
    assert pages.preview(rows.where("doc = 1"), 2, 0).first().snippet == ""


def test_moves_of_siblings(spark):
    rows = spark.createDataFrame([(1, 9, None), (2, 9, None), (3, 9, 0), (4, 8, 5), (5, 8, 5), (6, 8, 7)], "id int, type int, position int")
    place = lambda df: {r.id: r.position for r in df.collect()}
    # A type without all numbers is numbered by its order first: 3, 1, 2.
    assert place(lifecycle.moved(rows, "type", "id", 1, True)) == {3: 1, 1: 0, 2: 2, 4: 0, 5: 1, 6: 2}
    assert place(lifecycle.moved(rows, "type", "id", 2, False)) == {3: 0, 1: 1, 2: 2, 4: 0, 5: 1, 6: 2}
    # Equal numbers swap without effect; the key decides.
    assert place(lifecycle.moved(rows, "type", "id", 5, True))[5] == 1
    assert place(lifecycle.moved(rows, "type", "id", 5, False)) == {3: 0, 1: 1, 2: 2, 4: 0, 6: 1, 5: 2}


def test_quotas_logins_and_defaults(spark):
    plans = spark.createDataFrame([("pro", 1, None, 3)], "plan string, limite_produtos int, limite_enriquecimento_web int, limite_geracao_ia int")
    users = spark.createDataFrame([(1, "pro"), (2, None), (3, "gone")], "id int, plan string")
    assert sorted((r.id, r.limite_produtos, r.limite_enriquecimento_web, r.limite_geracao_ia) for r in ingest.with_quotas(users, plans).collect()) == [(1, 1, None, 3), (2, 50, 10, 20), (3, 50, 10, 20)]
    known = spark.createDataFrame([("a@x", "", None, None, True), ("b@x", "B", "google", "1", True), ("c@x", None, None, None, False)], "email string, name string, provider string, provider_user_id string, is_active boolean")
    logins = spark.createDataFrame([(e, n, "facebook", "9") for e, n in (("a@x", "A"), ("b@x", "N"), ("c@x", "C"), ("dora@x", None))], "email string, name string, provider string, provider_user_id string")
    after, refused = ingest.social_logins(known, logins)
    assert sorted((r.email, r.name, r.provider, r.provider_user_id) for r in after.collect()) == [("a@x", "A", "facebook", "9"), ("b@x", "B", "google", "1"), ("c@x", None, None, None), ("dora@x", "dora", "facebook", "9")]
    assert [r.email for r in refused.collect()] == ["c@x"]


def test_states_of_an_import_job(spark):
    files = spark.createDataFrame([(1, "UPLOADED", None, 0, None, None), (2, "UPLOADED", None, 0, None, None)], "id int, status string, total_pages int, pages_processed int, fornecedor_id int, result_summary string")
    started = ingest.page_done(ingest.started_import(files, 1, 7, 3), 1)
    assert sorted((r.id, r.status, r.total_pages, r.pages_processed, r.fornecedor_id) for r in started.collect()) == [(1, "PROCESSING", 3, 1, 7), (2, "UPLOADED", None, 0, None)]
    result = imported(spark, ["nome", "sku"], [("A", "1"), ("", ""), ("B", "1")])
    done = {r.id: r for r in ingest.finished_import(started, 1, result, 3).collect()}
    assert (done[1].status, done[1].pages_processed, done[1].result_summary) == ("IMPORTED", 3, '{"created":1,"updated":0,"errors":2}') and done[2].status == "UPLOADED"
    assert {r.id: r.status for r in ingest.finished_import(files, 2, None).collect()} == {1: "UPLOADED", 2: "FAILED"}


def test_open_graph_in_any_order_of_attributes(spark):
    html = "<meta name='x' content='no'><meta content='it\"s' property='og:title'><META property=\"og:image\" class=y content=\"a'b\">"
    row = spark.range(1).select(enrich.open_graph(F.lit(html), "og:title").alias("t"), enrich.open_graph(F.lit(html), "og:image").alias("i"), enrich.open_graph(F.lit(html), "og:url").alias("u")).first()
    assert (row.t, row.i, row.u) == ('it"s', "a'b", None)


def test_a_fault_in_the_subpackage_is_not_hidden(monkeypatch, tmp_path):
    import importlib
    import sys

    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_here\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    for name in ("corpus_pipeline", "__spark_entry__"):
        monkeypatch.delitem(sys.modules, name, raising=False)
    if importlib.util.find_spec("vendora.llm") is None:
        pytest.skip("the subpackage is absent")
    with pytest.raises(ModuleNotFoundError, match="no_such_module_here"):
        importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)


def test_tables_are_deleted_and_need_a_shared_folder(spark, monkeypatch):
    before = checkpoints.live()
    tables = checkpoints.Tables()
    made = tables.write(spark.range(3))
    out = tables.close(made.where("id > 0"))
    assert checkpoints.live() - before == {out._vendora_path} and out.count() == 2
    other = checkpoints.materialize(spark.range(2))
    checkpoints.release(out.where("id > 1"))
    assert checkpoints.live() - before == {other._vendora_path} and other.count() == 2  # tables of others stay
    checkpoints.discard(other)

    @checkpoints.guarded
    def fails():
        checkpoints.materialize(spark.range(1))
        raise KeyError("x")

    with pytest.raises(KeyError):
        fails()
    assert checkpoints.live() == before

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        checkpoints.shared_folder(Cluster)


def test_grid_rows(spark):
    grid = spark.createDataFrame([([["A", ""], ["1", "2"], ["only one"]],)], "grid array<array<string>>")
    assert [r.cells for r in delimited.grid_rows(grid).collect()] == [{"A": "1", "coluna_vazia_1": "2"}]


def test_region_without_text_has_no_pairs(spark):
    assert delimited.key_values(spark.createDataFrame([("",)], "text string")).first().pairs == {}


def test_merged_maps_and_first_text(spark):
    row = spark.range(1).select(
        enrich.merged_maps(F.from_json(F.lit('{"a":"1","b":"2"}'), "map<string,string>"), F.from_json(F.lit('{"a":null,"b":"3","c":null}'), "map<string,string>")).alias("m"),
        C.first_text(F.array(F.lit(None).cast("string"), F.lit(" "), F.lit("x"))).alias("x"),
        C.split_list(F.lit(" a, ,b ")).alias("l"),
    ).first()
    assert row.m == {"a": "1", "b": "3", "c": None} and row.x == "x" and row.l == ["a", "b"]


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "usage_by_plan" in entry.queries() and not any(re.match(r"op\d+_", k) for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)


def test_commit_of_a_staged_job(spark):
    staged = '[{"sku":"1","ean":null,"nome_base":"New"},{"sku":null,"ean":"12345678901234567","nome_base":"Bad"},{"sku":"2","ean":null,"nome_base":"Two"}]'
    jobs = spark.createDataFrame([(7, 1, "REVIEW", staged)], "id int, user_id int, status string, result_summary string")
    products = spark.createDataFrame([(1, 3, "1", None, "Old")], "tenant bigint, id bigint, sku string, ean string, nome_base string")
    nobody = ingest.commit_job(jobs, 7, 2, products, "sku string, ean string, nome_base string", ["nome_base"])
    assert [r.change for r in nobody[0].collect()] == ["unchanged"] and nobody[1].first().status == "REVIEW"
    state, jobs = ingest.commit_job(jobs, 7, 1, products, "sku string, ean string, nome_base string", ["nome_base"])
    assert sorted((r.id, r.nome_base, r.change) for r in state.collect()) == [(3, "New", "updated"), (4, "Two", "created")]
    assert jobs.first().status == "COMPLETED"


def test_reset_token_and_login(spark):
    users = spark.sql("select 1 id, true is_active, 'h' hashed_password, sha2('tok', 256) reset_password_token, timestamp '2024-02-01 00:00:00' reset_password_token_expires_at")
    assert reading.valid_reset(users, "tok", "2024-01-31").count() == 1
    assert reading.valid_reset(users, "tok", "2024-03-01").count() == 0
    assert reading.can_log_in(users).count() == 1


def test_default_mapping(spark):
    suppliers = spark.createDataFrame([(1, {"cod": "sku_original"})], "id int, default_column_mapping map<string,string>")
    assert ingest.mapping_or_default(None, suppliers, 1) == {"cod": "sku_original"}
    assert ingest.mapping_or_default({"a": "b"}, suppliers, 1) == {"a": "b"}
    assert ingest.mapping_or_default(None, suppliers, 2) is None


# Import faults, greedy rounds, pages


def test_blank_keys_never_clash_and_match_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "", None), (1, 2, "", "5"), (1, 3, "a", ""), (1, 4, "a", "6"), (1, 5, None, "5")], "t long, o long, sku string, ean string")
    got = {r.o: r.accepted for r in ingest.greedy_dedup(rows, "t", "o", ["sku", "ean"]).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}
    products = spark.createDataFrame([(1, 7, "", "", "old")], "tenant long, id long, sku string, ean string, nome string")
    incoming = spark.createDataFrame([(1, 1, "", "", "new")], "tenant long, row_no long, sku string, ean string, nome string")
    assert {(r.nome, r.change) for r in ingest.upsert(products, incoming, ["nome"]).collect()} == {("old", "unchanged"), ("new", "created")}


def _sequential(rows):
    out, seen = {}, {}
    for t, o, *keys in sorted(rows, key=lambda r: r[:2]):
        held = seen.setdefault(t, [set() for _ in keys])
        out[t, o] = not any(k and k in h for k, h in zip(keys, held, strict=True))
        if out[t, o]:
            for k, h in zip(keys, held, strict=True):
                h.add(k)
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "hot"])
def test_greedy_rounds_equal_the_sequential_rule(spark, kind):
    rnd = random.Random(7)
    keys = [None, "", *map(str, range(60))]
    make = {
        "random": lambda i: (i % 2, i, rnd.choice(keys), rnd.choice(keys)),
        "chain": lambda i: (0, i, str(i // 2), str((i + 1) // 2)),
        "hot": lambda i: (0, i, "hot" if rnd.random() < 0.4 else str(i % 90), str(rnd.randrange(100))),
    }[kind]
    rows = [make(i) for i in range(400)]
    before = checkpoints.live()
    found = ingest.greedy_dedup(spark.createDataFrame(rows, "t long, o long, a string, b string"), "t", "o", ["a", "b"], most=60)
    assert {(r.t, r.o): r.accepted for r in found.collect()} == _sequential(rows)
    checkpoints.release(found)
    assert checkpoints.live() == before


def test_headers_that_differ_in_white_space_are_one_leftover(spark):
    rows = spark.createDataFrame([("n", "a", "b"), ("m", "a", "")], "nome string, Obs string, `Obs ` string")
    got = {r.nome_base: r.leftovers for r in ingest.standardise(rows, ["nome", "Obs", "Obs "]).collect()}
    assert got == {"n": {"Obs": "b"}, "m": {"Obs": "a"}}


class _Plain(HTMLParser):
    """Microdata of well-formed pages, by the standard library's parser: an independent reading."""

    void = {"meta", "link", "img", "br"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        has = dict(attrs)
        owner = next((x["item"] for x in reversed(self.stack) if x["item"] is not None), None)
        entry = {"tag": tag, "item": None, "slots": [], "text": []}
        value = has.get("content", {"link": has.get("href"), "a": has.get("href"), "img": has.get("src")}.get(tag))
        if "itemscope" in has:
            entry["item"] = len(self.items)
            self.items.append([owner if has.get("itemprop") and owner is not None else None, []])
            value = None
        if owner is not None:
            for name in (has.get("itemprop") or "").split():
                self.items[owner][1].append([name, value, entry["item"]])
                if entry["item"] is None and value is None:
                    entry["slots"].append(self.items[owner][1][-1])
        if tag not in self.void:
            self.stack.append(entry)

    def handle_data(self, data):
        for x in self.stack:
            x["text"].append(data)

    def handle_endtag(self, tag):
        entry = self.stack.pop()
        for slot in entry["slots"]:
            slot[1] = "".join(entry["text"])


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32))
def test_items_equal_a_plain_parser_on_well_formed_pages(seed):
    rnd = random.Random(seed)

    def element(depth):
        tag = rnd.choice(["div", "span", "a", "b", "section", "meta", "link", "img"])
        scope = " itemscope" if tag in ("div", "span", "section") and rnd.random() < 0.4 else ""
        prop = f' itemprop="{rnd.choice(["name", "brand", "offers name", "x"])}"' if rnd.random() < 0.6 else ""
        more = rnd.choice(["", ' content="c&amp;d"', " href='/u'", " src=i.png", ' class="q"'])
        inner = "" if tag in _Plain.void else "".join(element(depth + 1) if rnd.random() < 0.6 and depth < 5 else rnd.choice(["t ", "x &lt;y", "\n"]) for _ in range(rnd.randint(0, 3)))
        return f"<{tag}{scope}{prop}{more}>" + (inner if tag in _Plain.void else f"{inner}</{tag}>")

    page = "".join(element(0) for _ in range(3))
    plain = _Plain()
    plain.feed(page)
    got = [[i["parent"], [[p["name"], p["value"], p["child"]] for p in i["properties"]]] for i in html.items_of(page)]
    void_values = [[parent, [[n, "" if v is None and c is None else v, c] for n, v, c in props]] for parent, props in plain.items]
    assert got == void_values


def test_items_of_nested_unclosed_and_void_tags(spark):
    page = (
        '<div itemscope itemtype="https://schema.org/Product"><div itemprop="brand" itemscope><span itemprop="name">Acme</span></div><h1 itemprop="name">Drill <b>500</h1>'
        "<p itemprop=description>one<p>two<ul><li itemprop=f>1<li itemprop=f>2</ul><img itemprop=image src=u.png><br>"
        '<div itemprop=offers itemscope><meta itemprop=price content="9.5"><meta itemprop=priceCurrency content=BRL></div><script>"<b itemprop=no>"</script></div><i itemprop=name>out</i>'
    )
    row = enrich.metadata(spark.createDataFrame([(page,), (None,), ("",), ("<div itemscope",)], "html string")).collect()
    assert (row[0].name, row[0].brand, row[0].short_description, row[0].image, row[0].price, row[0].currency) == ("Drill 500", "Acme", "one", "u.png", "9.5", "BRL")
    assert all(r.name is None for r in row[1:])
    assert [p["value"] for p in html.items_of(page)[0]["properties"] if p["name"] == "f"] == ["1", "2"]
    assert html.items_of("<a itemscope itemprop='x" + "<b itemprop=y" * 3000) is not None  # quotes never closed


def test_main_text_keeps_the_article_and_loses_menus_without_nav(spark):
    long = " ".join(["word"] * 30)
    menu = "".join(f"<div><a href=/{i}>Entry {i} of menu</a></div>" for i in range(9))
    page = f"<body><div>{menu}</div><h2>Title</h2><p>{long} <a href=x>link</a><p>{long}<table><tr><th>Size<td>5<tr><td>Mass<td>7</table><div>Short.</div><p>{long}</p><div>{menu}</div><aside>{long}</aside></body>"
    (got,) = enrich.main_text(spark.createDataFrame([(page,)], "html string")).collect()
    assert got.main_text.split("\n") == ["Title", f"{long} link", long, "Size | 5", "Mass | 7", "Short.", long]
    assert enrich.main_text(spark.createDataFrame([(None,), (" ",)], "html string")).where("main_text is not null").isEmpty()


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-8", "cp1252"])
def test_charsets_are_told_from_bytes(spark, tmp_path, encoding):
    path = tmp_path / "f.csv"
    path.write_bytes('nome;preço\nÁgua, com gás;"1\n2"\n'.encode(encoding))
    rows = delimited.read_delimited(spark, str(path))
    assert [tuple(r)[:2] for r in rows.collect()] == [("Água, com gás", "1\n2")] and rows.columns[:2] == ["nome", "preço"]


def test_bytes_beyond_the_head_decide_as_well(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes(b"nome,sku\n" + b"abc,1\n" * 20_000 + "€uro,2\n".encode("cp1252"))
    rows = delimited.read_delimited(spark, str(path))
    assert [r.nome for r in rows.where("sku = '2'").collect()] == ["€uro"] and rows.count() == 20_001


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "256b", "spark.sql.files.openCostInBytes": "0b"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_feeds_across_splits_equal_the_csv_module(spark, tmp_path, small_splits, seed):
    rnd = random.Random(seed)
    cell = lambda: rnd.choice(["", "a", "é b", 'q"q', "x\ny", "long " * 40, "n\n" * 150, '"', "a,b", "\n"])
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="", encoding="utf-8-sig" if f else "utf-8") as out:
            writer = csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"]))
            writer.writerow(["nome", "sku", "obs"])
            for i in range(60):
                writer.writerow([cell(), i, cell(), *([cell()] if i % 9 == 0 else [])])
    want = []
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", newline="", encoding="utf-8-sig") as read:
            want += [tuple(c or None for c in r[:3]) + (str(r[3:]) if len(r) > 3 else None,) for r in list(csv.reader(read))[1:]]
    splits = delimited.splits_of(spark, delimited.files_of(spark, str(tmp_path)), ",")
    assert len(splits) > 20 and any(x.within != x.without for x in splits) and any(not x.closes for x in splits)
    rows = delimited.read_delimited(spark, str(tmp_path), surplus=True)
    assert [tuple(r)[:4] for r in rows.orderBy("_file", "_row").collect()] == want


def test_lines_and_quotes():
    for line, inside, outcome in [(b'a,"b', False, True), (b'c",d', True, False), (b'a"b,c', False, False), (b'"a""', False, True), (b'x""y', True, True), (b'","', True, True), (b"", True, True), (b'"a"b",c', False, False)]:
        assert delimited.after_line(line, inside, b",") is outcome


def test_dates_repeated_headers_and_errors_of_workbooks(spark, tmp_path):
    path = tmp_path / "f.xlsx"
    workbook_file(path, {"S": [["Nome", "Nome", "SKU", None, "Nome"], ["a", "b", "1", "x", None]]})
    (row,) = workbook.read_workbook(spark, str(path)).collect()
    assert row.cells == {"Nome": "a", "Nome.1": "b", "SKU": "1", "Unnamed: 3": "x"}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<c r="A2" s="1"><v>45322</v></c><c r="B2" s="2"><v>45322.5</v></c><c r="C2" s="3"><v>45322</v></c><c r="D2" s="1"><v>0.75</v></c><c r="E2" t="e"><v>#N/A</v></c><c r="F2" t="b"><v>1</v></c><c r="H2"><v>7</v></c>'
    header = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{c}</t></is></c>' for c in "ABCDEF")
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("xl/worksheets/s0.xml", f'<worksheet {main}><sheetData><row r="1">{header}</row><row r="2">{cells}</row></sheetData></worksheet>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy&quot; h&quot;"/><numFmt numFmtId="171" formatCode="0.00&quot; dias&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
    (row,) = workbook.read_workbook(spark, str(path)).collect()
    assert row.cells == {"A": "2024-01-31 00:00:00", "B": "2024-01-31 12:00:00", "C": "45322", "D": "18:00:00", "F": "True", "Unnamed: 7": "7"}
    assert workbook.date_text(1) == "1900-01-01 00:00:00" and workbook.date_text(61) == "1900-03-01 00:00:00" and workbook.date_text(1, True) == "1904-01-02 00:00:00"
    assert [workbook.is_date_format(x) for x in ("General", "[$-409]d-mmm", "[Red]0.0", "[h]:mm", "0\\d")] == [False, True, False, True, False]


def test_a_workbook_of_many_rows_comes_in_batches(tmp_path):
    path = tmp_path / "f.xlsx"
    workbook_file(path, {"S": [["nome", "n"], *([f"p{i}", i] for i in range(12_000))]})
    book = workbook.Book(path.read_bytes())
    rows = book.rows(book.sheets[0][1])
    assert next(rows) == ["nome", "n"] and next(rows) == ["p0", "0"]
    tracemalloc.start()
    n = sum(1 for _ in rows)
    assert n == 11_999 and tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()


def test_previews_read_the_head(spark, tmp_path, monkeypatch):
    path = tmp_path / "f.csv"
    path.write_bytes(b'nome;sku;nome\n"a\nb";1;x\n' + b"c;2\n" * 200_000)
    headers, rows = catalogue.preview_file(spark, str(path), 3)
    assert headers == ["nome", "sku"] and [tuple(r) for r in rows.collect()] == [("x", "1"), (None, "2"), (None, "2")]
    path.write_bytes(b"nome\n" + b"y" * 300_000 + b"\nz\n")
    assert [len(r.nome) for r in catalogue.preview_file(spark, str(path), 2)[1].collect()] == [300_000, 1]
    path.write_bytes(b"")
    assert catalogue.preview_file(spark, str(path))[0] == []


# Deep pages and searches by postings


@pytest.mark.parametrize("seed", range(6))
def test_deep_pages_equal_a_full_sort(spark, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice([None, "", "a", "ab", "abc", "é", "zz", "a%b", "漢字"]) if rnd.random() < 0.5 else "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 6)))
    rows = [(i, word(), rnd.choice([None, 0, 1, 2**60, 2**60 + 1, -5, rnd.randrange(1000)]), rnd.choice([None, rnd.random(), 0.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, w string, n long, x double")
    columns = [(c, rnd.random() < 0.5) for c in rnd.sample(["w", "n", "x"], rnd.randint(0, 2))] + [("id", rnd.random() < 0.5)]
    order = [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in columns]
    every = [tuple(r) for r in df.orderBy(*order).collect()]
    for skip in (0, 3, 199, rnd.randrange(400), 395, 400, 1000):
        limit = rnd.choice([1, 10, 50])
        got = reading.deep_page(df, columns, skip, limit, enough=rnd.choice([1, 20, 10_000]))
        assert [tuple(r) for r in got.collect()] == every[skip : skip + limit], (columns, skip, limit)
    for bad in ((-1, 10), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            reading.deep_page(df, columns, *bad)
    assert reading.deep_page(df.limit(0), columns, 5).collect() == []


def test_searches_by_postings_read_few_rows_and_equal_the_scan(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abcdé %_\\") for _ in range(rnd.randint(0, 40))), rnd.choice([None, "", "AbC", "xyz"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    path = str(tmp_path / "index")
    reading.trigram_index(df, "id", ["a", "b"]).write.partitionBy("gram_bucket").parquet(path)
    index = spark.read.parquet(path)
    for term in ("abc", "ABC", "bcd%a", "a_cd", "b\\c", "é d", "xyz", "q", "ab", "", None, "%", "nothing here"):
        got = sorted(r.id for r in reading.search_indexed(df, index, "id", ["a", "b"], term).collect())
        assert got == sorted(r.id for r in reading.search(df, ["a", "b"], term).collect()), term
    # Only files of the grams' buckets are read, and only few keys are left to verify.
    searched = reading.search_indexed(df, index, "id", ["a", "b"], "bcda")
    parts = [f for f in searched.inputFiles() if "gram_bucket" in f]
    assert "PartitionFilters: [" in searched._jdf.queryExecution().toString() and "gram_bucket" in searched._jdf.queryExecution().toString() and len(parts) > 2
    wanted = reading.grams_of_term("bcda")
    keys = index.where(F.col("gram").isin(wanted)).groupBy("id").count().where(F.col("count") == len(wanted)).count()
    assert keys < 25


# Written tables, templates, roll-ups


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_writes_touch_only_their_partitions(spark, tmp_path, monkeypatch):
    path = tmp_path / "products"
    where = f"file://{path}"
    rows = spark.range(1000).selectExpr("1L tenant", "id", "cast(id as string) sku", "'old' nome")
    writes.create(rows, where, ["tenant", "id"], 50)
    before = _files(path)
    changed = spark.createDataFrame([(1, i, f"{i}", "new") for i in (3, 500)] + [(2, 9000, "x", "made")], "tenant long, id long, sku string, nome string")
    touched = writes.apply_changes(spark, where, changed, ["tenant", "id"])
    after = _files(path)
    same = {f for f, t in before.items() if after.get(f) == t}
    assert 1 <= len(touched) <= 3 and len(same) == 50 - len(touched) and all(f"bucket_of_50={b}/" not in f for f in same for b in touched)
    found = {(r.tenant, r.id): r.nome for r in writes.read(spark, where).collect()}
    assert len(found) == 1001 and [found[k] for k in ((1, 3), (1, 500), (2, 9000), (1, 4))] == ["new", "new", "made", "old"]
    assert writes.apply_changes(spark, where, changed.limit(0), ["tenant", "id"]) == [] and _files(path) == after

    # A writer that ends before the change is marked leaves the old state.
    again = changed.withColumn("nome", F.lit("newer"))
    with monkeypatch.context() as m:
        m.setattr(writes, "_put_mark", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            writes.apply_changes(spark, where, again, ["tenant", "id"])
    assert {r.nome for r in writes.read(spark, where).collect()} == {"old", "new", "made"}
    # One that ends after the mark leaves a change that the next reader completes.
    with monkeypatch.context() as m:
        m.setattr(writes, "complete", lambda *a: False)
        writes.apply_changes(spark, where, again, ["tenant", "id"])
    assert {r.nome for r in spark.read.parquet(where).collect()} == {"old", "new", "made"}
    assert {r.nome for r in writes.read(spark, where).collect()} == {"old", "newer"}
    assert not writes.complete(spark, where)
    writes.apply_changes(spark, where, again, ["tenant", "id"])
    assert not list(path.glob("_staged-*")) and not (path / "_pending").exists()


def test_deletes_empty_partitions_too(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    rows = spark.range(30).selectExpr("id", "'x' v")
    writes.create(rows, where, ["id"], 8)
    writes.delete_rows(spark, where, rows.where("id <> 7").select("id").union(spark.range(100, 102)), ["id"])
    assert [tuple(r) for r in writes.read(spark, where).collect()] == [(7, "x")]
    writes.delete_rows(spark, where, spark.range(8), ["id"])
    writes.apply_changes(spark, where, spark.createDataFrame([(1, "y")], "id long, v string"), ["id"])
    assert [tuple(r) for r in writes.read(spark, where).collect()] == [(1, "y")]
    with pytest.raises(Exception, match="exist"):
        writes.create(rows, where, ["id"], 8)


def test_attributes_by_template(spark):
    templates_ = spark.createDataFrame(
        [("t", "cor", "select", ["azul", "verde"], True, None), ("t", "peso", "number", None, False, None), ("t", "ok", "boolean", None, True, "true"), ("t", "dia", "date", None, None, None), ("t", "tags", "multiselect", ["a", "b"], False, None), ("u", "x", "text", None, True, None)],
        "type_id string, attribute_key string, field_type string, options array<string>, is_required boolean, default_value string",
    )
    good = {"cor": " azul ", "peso": "-1,50", "dia": "2024-02-29", "tags": "a, b,"}
    bad = {"cor": "roxo", "peso": "1.2.3", "ok": "maybe", "dia": "2024-02-30", "tags": "a,c", "y": "1"}
    products = spark.createDataFrame([(1, "t", good), (2, "t", bad), (3, "t", {"cor": " "}), (4, "u", {}), (5, None, {"x": "1"}), (6, "u", None)], "id long, type_id string, attributes map<string,string>")
    checked = templates.checked_attributes(products, templates_)
    assert {r.id: r.reasons for r in templates.rejected(checked).collect()} == {
        2: ["cor: not an option", "dia: not a date", "ok: not a boolean", "peso: not a number", "tags: not an option", "y: unknown"],
        3: ["cor: missing"], 4: ["x: missing"], 5: ["x: unknown"], 6: ["x: missing"],
    }
    assert {r.attribute_key: r.value for r in checked.where("id = 1").collect()} == {**good, "cor": "azul", "tags": "a, b,", "ok": "true"}


@pytest.mark.parametrize("seed", range(3))
def test_roll_ups_equal_recounts_after_late_events(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(5), rnd.choice(["a", "b", None]), f"2024-0{rnd.randint(1, 3)}-{rnd.randint(10, 28)} 10:00:00") for i in range(300)]
    usage = spark.createDataFrame(rows, "event_id long, user_id long, action string, t string").selectExpr("event_id", "user_id", "action", "cast(t as timestamp_ntz) ts")
    roll_up = analytics.month_counts(usage.where("event_id < 100"))
    for upto in (101, 250, 250, 300):
        roll_up = analytics.extended(roll_up, usage.where(F.col("event_id") < upto))
        roll_up = analytics.compacted(roll_up) if rnd.random() < 0.5 else roll_up
    for as_of in ("2024-01-05", "2024-02-01", "2024-03-31", "2024-04-01"):
        want = sorted(map(str, analytics.usage_by_action(usage, as_of).collect()))
        assert sorted(map(str, analytics.rolled_usage_by_action(roll_up, as_of).collect())) == want
    empty = analytics.extended(analytics.month_counts(usage.limit(0)), usage)
    assert empty.agg(F.sum("n")).first()[0] == 300


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12), st.sampled_from([None, 1, ", ", "]", "x"]))
def test_lists_are_cut_where_their_elements_end(value, broken):
    text = json.dumps(value, ensure_ascii=False, indent=broken if broken == 1 else None)
    bounds = ingest.element_bounds(f" {text}\n")
    assert (bounds is None) == (not isinstance(value, list))
    if bounds is not None:
        assert [json.loads(f" {text}\n"[a:b]) for a, b in bounds] == value
        assert ingest.element_bounds(text[:-1]) is None and ingest.element_bounds(text + "]") is None
        if value:
            assert ingest.element_bounds(text[:-1] + ",]") is None


def test_rows_of_a_long_list_are_dealt_over_tasks(spark):
    text = json.dumps([{"sku": f"S{i}", "nome_base": 'a "b", [c]'} for i in range(9_000)])
    df = spark.createDataFrame([(1, text), (2, None), (3, "{}"), (4, "[1, 2"), (5, "[]"), (6, '["x", 2]')], "id long, t string")
    rows = ingest.list_rows(df, "id", "t")
    assert sorted((r.id, r.row_no, r.j) for r in rows.where("id <> 1").collect()) == [(6, 0, '"x"'), (6, 1, "2")]
    first = rows.where("id = 1")
    assert [r.row_no for r in first.orderBy("row_no").collect()] == list(range(9_000)) and json.loads(first.where("row_no = 8999").first().j)["sku"] == "S8999"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the few rows here would be put together again
    sizes = [r[1] for r in ingest.list_rows(df, "id", "t").where("id = 1").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 9_000


def test_kept_texts_of_any_number_of_repeats(spark, tmp_path):
    names = ["n", "", "Customer#000000001", "ação 😀", "x" * 15, "y" * 14_999, "z" * 15_000, "ü" * 20_000]
    keys = [0, 1, 2, 3, 4, 6, 8, 10, 998, 1000, 1002, 14_998, 15_000, 15_002, 900_000, 2_000_000_002, 2_147_483_646, -4]
    rows = [(k, n) for k in keys for n in names]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = registry.QUERIES["status_by_parts"](spark, str(tmp_path)).collect()
    full, some, none = "CONCLUIDO_SUCESSO", "CONCLUIDO_COM_DADOS_PARCIAIS", "NENHUMA_FONTE_ENCONTRADA"
    status = lambda k: full if k % 5 == 0 else some if k % 2 == 0 else full if k % 3 == 0 else none
    text = lambda k, n: (n * min(k, 15_000))[:15_000] if k % 2 == 0 else None
    order = lambda r: (r[0], r[1], r[2] or "")
    assert sorted((tuple(r) for r in got), key=order) == sorted(((k, status(k), text(k, n)) for k, n in rows), key=order)


def _differences_from_sql(spark, folder, name, **tables):
    """Rows that a registered query gives and its SQL doesn't, and the other way round."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    wanted = db.execute(registry.SQL[name])
    columns = [c[0] for c in wanted.description]
    want = Counter(wanted.fetchall())
    got = Counter(map(tuple, registry.QUERIES[name](spark, str(folder)).select(*columns).collect()))
    assert want
    return got - want, want - got


def _pages_cut_in_references(spark):
    """Pages whose heading and paragraphs end anywhere within character references."""
    text = "a &lt;&amp;lt; b&quot;&#39; &amp;amp;&gt; c &amp;&amp; d"
    long = " ".join(["word"] * 45)
    page = lambda t: f"<html><body><div><a href=/x>Menu</a></div><article><h1>{t}</h1><p>{t}<p>{long} {t}</article></body></html>"
    return spark.createDataFrame([(i, page(text[:i])) for i in range(1, len(text) + 1)], "page_id long, html string").coalesce(1)


def test_items_keep_references_cut_short(spark, tmp_path):
    pages = _pages_cut_in_references(spark)
    parts = pages.select((F.col("page_id") + 1).alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit("T").alias("p_type"), F.lit(9.5).alias("p_retailprice"))
    assert _differences_from_sql(spark, tmp_path, "microdata_products", pages=pages, part=parts) == (Counter(), Counter())
    (item,) = html.items_of('<div itemscope><a itemprop=u href="/?a=1&copy=2&amp;b=&eacute;&#233;&#xE9;">x</a><b itemprop=n>&notit; &nosuch; &#39 &eacute;</b></div>')
    assert [p["value"] for p in item["properties"]] == ["/?a=1&copy=2&b=ééé", "&notit; &nosuch; &#39 é"]


def test_main_text_keeps_references_cut_short(spark, tmp_path):
    assert _differences_from_sql(spark, tmp_path, "page_article_text", pages=_pages_cut_in_references(spark)) == (Counter(), Counter())
    assert [b["text"] for b in html.blocks_of("<h1>a &eacute &amp</h1><p>b &eacute; &notit; &#39<p><a href=x>c&amp;</a>")] == ["a &eacute &amp", "b é &notit; &#39", "c&"]
