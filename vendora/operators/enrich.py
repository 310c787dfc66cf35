"""Metadata and text of web pages, and how pages and statuses combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendora.functions.columns import squeeze
from vendora.sources.html import microdata_items, text_blocks

#: End of a search phrase, most pages read for a product, and lengths of text kept.
PHRASE_END = "especificações técnicas detalhadas"
PAGES_READ, TEXT_KEPT, PROMPT_TEXT, SHORT_PROMPT_TEXT, FIELD_TEXT = 2, 15_000, 10_000, 1_000, 200


def _json(value: Column, path: str) -> Column:
    return squeeze(F.try_variant_get(value, path, "string"))


def json_ld_product(html: Column) -> Column:
    """The first JSON-LD item (also within a list or @graph) whose type contains Product, as VARIANT."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.try_parse_json(b))
    many = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))
    items = F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), many))
    kind = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "string"), F.to_json(F.try_variant_get(v, "$['@type']", "variant")))
    return F.try_element_at(F.filter(items, lambda v: F.coalesce(F.contains(kind(v), F.lit("Product")), F.lit(False))), F.lit(1))


def open_graph(html: Column, name: str) -> Column:
    """Content of the first meta element with this property, in whatever order its attributes stand."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b(?=[^>]*\bproperty\s*=\s*[\"']{name}[\"'])[^>]*>", 0)
    quoted = lambda q: F.nullif(F.regexp_extract(tag, rf"(?is)\bcontent\s*=\s*{q}(.*?){q}", 1), F.lit(""))
    return squeeze(F.coalesce(quoted('"'), quoted("'")))


def item_value(item: Column, name: str) -> Column:
    """First value of a microdata item's property that isn't blank."""
    values = F.transform(F.filter(item["properties"], lambda p: p["name"] == name), lambda p: squeeze(p["value"]))
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))


def item_child(items: Column, item: Column, name: str) -> Column:
    """First item that is a property of another one."""
    nested = F.filter(item["properties"], lambda p: (p["name"] == name) & p["child"].isNotNull())
    return F.get(items, F.get(nested, F.lit(0))["child"])


def microdata(items: Column) -> Column:
    """The metadata fields of a page's first item: its own properties, then those of its nested Brand, Offer and image."""

    def of_item(item: Column) -> Column:
        one = lambda *names: F.coalesce(*(item_value(item, n) for n in names))
        nested = lambda name, *names: F.coalesce(*(item_value(item_child(items, item, name), n) for n in names))
        return F.struct(
            one("name").alias("name"), one("description").alias("short_description"), F.coalesce(one("image"), nested("image", "url", "contentUrl")).alias("image"),
            F.coalesce(one("brand"), nested("brand", "name")).alias("brand"), one("sku", "mpn").alias("sku"),
            F.coalesce(one("price"), nested("offers", "price", "lowPrice", "highPrice")).alias("price"), F.coalesce(one("priceCurrency"), nested("offers", "priceCurrency")).alias("currency"),
            F.coalesce(one("availability"), nested("offers", "availability")).alias("availability"),
        )

    return F.get(F.transform(F.slice(items, 1, 1), of_item), F.lit(0))


def metadata_of(html: str, items: str) -> Column:
    """name, short_description, image, brand, sku, price, currency, availability: JSON-LD before microdata (the column items) before OpenGraph."""
    h = F.col(html)
    tail = lambda c: F.when(F.contains(c, F.lit("schema.org")), F.element_at(F.split(c, "/"), -1)).otherwise(c)

    def of_json(v: Column) -> Column:
        one = lambda *paths: F.coalesce(*(_json(v, p) for p in paths))
        offer = lambda key: one(f"$.offers[0].{key}", f"$.offers.{key}")
        return F.struct(
            one("$.name").alias("name"), one("$.description").alias("short_description"), one("$.image[0]", "$.image.url", "$.image").alias("image"),
            one("$.brand.name", "$.brand[0].name", "$.brand").alias("brand"), one("$.sku", "$.mpn").alias("sku"),
            F.coalesce(offer("price"), offer("lowPrice"), offer("highPrice")).alias("price"), offer("priceCurrency").alias("currency"), offer("availability").alias("availability"),
        )

    # A one-element array binds the parsed item once; else each field would parse it again.
    ld = F.element_at(F.transform(F.array(json_ld_product(h)), of_json), 1)
    micro = microdata(F.col(items))
    product_graph = F.when(open_graph(h, "og:type") == "product", F.coalesce(open_graph(h, "product:brand"), open_graph(h, "og:brand")))
    others = {
        "name": (open_graph(h, "og:title"),),
        "short_description": (open_graph(h, "og:description"),),
        "image": (open_graph(h, "og:image"),),
        "brand": (product_graph, open_graph(h, "og:site_name")),
        "sku": (),
        "price": (open_graph(h, "product:price:amount"),),
        "currency": (open_graph(h, "product:price:currency"),),
        "availability": (open_graph(h, "product:availability"),),
    }
    said = lambda v, n: F.coalesce(v["ld"][n], v["micro"][n], *others[n])
    both = F.array(F.struct(ld.alias("ld"), micro.alias("micro")))
    return F.transform(both, lambda v: F.struct(*((tail if n == "availability" else lambda c: c)(said(v, n)).alias(n) for n in others)))[0]


def metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the metadata fields of each page; one pass over its tags finds the microdata."""
    found = pages.withColumn("_items", microdata_items(F.col(html)))
    return found.select(*pages.columns, metadata_of(html, "_items").alias("_m")).select(*pages.columns, "_m.*")


def items(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, item, parent, types, place, name, value, child: every property of every microdata item of each page; an item without properties has one row without a name."""
    each = pages.select(key, F.explode(microdata_items(F.col(html))).alias("i"))
    return each.select(key, "i.item", "i.parent", "i.types", F.posexplode_outer("i.properties").alias("place", "p")).select(key, "item", "parent", "types", "place", "p.name", "p.value", "p.child")


#: Fixed values of the published decision tree for blocks (densities of links, numbers of words).
LINKED, LINKED_BEFORE = 1 / 3, 5 / 9
SHORT, SHORT_NEXT, SHORT_BEFORE, SHORT_AFTER_LINKS, NEXT_AFTER_LINKS = 16, 15, 4, 40, 17


def is_content(block: Column, before: Column, after: Column) -> Column:
    """Whether a block is main text, by its own words and links and those of its neighbours (Kohlschütter, Fankhauser and Nejdl, 2010)."""
    words = lambda b: F.coalesce(b["words"], F.lit(0))
    density = lambda b: F.coalesce(b["linked"] / F.greatest(b["words"], F.lit(1)), F.lit(0.0))
    alone = (words(block) <= SHORT) & (words(after) <= SHORT_NEXT) & (words(before) <= SHORT_BEFORE)
    after_links = (words(block) <= SHORT_AFTER_LINKS) & (words(after) <= NEXT_AFTER_LINKS)
    return (density(block) <= LINKED) & F.when(density(before) <= LINKED_BEFORE, ~alone).otherwise(~after_links)


def article(blocks: Column) -> Column:
    """The blocks of a page's main text: content, headings right before content, and rows of tables that aren't link lists."""

    def judged(block: Column, i: Column) -> Column:
        content = is_content(block, F.when(i > 0, F.get(blocks, i - 1)), F.get(blocks, i + 1))
        table = block["table_linked"] <= LINKED * block["table_words"]
        return F.struct(block["text"].alias("text"), block["kind"].alias("kind"), F.when(block["kind"] == "row", table).otherwise(content).alias("good"))

    def kept(marks: Column) -> Column:
        follows = lambda i: F.coalesce(F.get(marks, i + 1)["good"], F.lit(False))
        return F.filter(marks, lambda m, i: m["good"] | ((m["kind"] == "heading") & follows(i)))

    return F.transform(F.array(F.transform(blocks, judged)), kept)[0]


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with main_text: the main blocks of each page, a line each; null for a page without any."""
    found = pages.withColumn("_blocks", text_blocks(F.col(html)))
    return found.select(*pages.columns, F.nullif(F.array_join(F.transform(article(F.col("_blocks")), lambda b: b["text"]), "\n"), F.lit("")).alias("main_text"))


def folded(pages: DataFrame, product: str, place: str, fields: list[str], text: str) -> DataFrame:
    """One row a product from its pages in order: a later page's fields overwrite, the first page's text stays.

    At most PAGES_READ pages count, and none after one with name and description.
    """
    w = Window.partitionBy(product).orderBy(place)
    enough = (F.col("name").isNotNull() & F.col("short_description").isNotNull()).cast("int")
    before = F.coalesce(F.max(enough).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = pages.withColumn("_n", F.row_number().over(w)).withColumn("_stop", before).where((F.col("_n") <= PAGES_READ) & (F.col("_stop") == 0))
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_n"))).alias(f) for f in fields]
    first = F.min_by(text, F.when(F.col(text).isNotNull(), F.col("_n"))).alias(text)
    return used.groupBy(product).agg(*last, first, F.count("*").alias("n_pages"))


def status(collected: Column, llm: Column, tried: Column, search_api: Column, llm_error: Column, stuck: Column | None = None) -> Column:
    """Outcome of an enrichment: what was collected decides first, then whether pages were tried, then what is configured; one that never came to an end failed."""
    return (
        F.when(F.lit(False) if stuck is None else stuck, "FALHOU")
        .when(llm_error & ~collected, "FALHA_API_EXTERNA")
        .when(collected, F.when(llm, "CONCLUIDO_SUCESSO").otherwise("CONCLUIDO_COM_DADOS_PARCIAIS"))
        .when(tried, "NENHUMA_FONTE_ENCONTRADA")
        .when(~search_api, F.when(llm, "NENHUMA_FONTE_ENCONTRADA").otherwise("FALHA_CONFIGURACAO_API_EXTERNA"))
        .otherwise("FALHOU")
    )


def status_by_parts(text: Column, meta: Column) -> Column:
    """Outcome from text and metadata alone: neither, text alone, else success."""
    return F.when(~text & ~meta, "NENHUMA_FONTE_ENCONTRADA").when(text & ~meta, "CONCLUIDO_COM_DADOS_PARCIAIS").otherwise("CONCLUIDO_SUCESSO")


def kept_text(text: Column) -> Column:
    """The part of a page's text that is stored with its status."""
    return F.substring(text, 1, TEXT_KEPT)


def merged_maps(old: Column, new: Column) -> Column:
    """new over old; a null in new leaves an existing key as it is."""
    keep = F.map_filter(new, lambda k, v: v.isNotNull() | ~F.map_contains_key(old, k))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(keep, k)), keep)


def search_phrase(name: Column, brand: Column, code: Column, override: Column) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), F.concat_ws(" ", name, brand, code, F.lit(PHRASE_END)))


def prompt_context(pairs: dict[str, Column], text: Column, most: int = PROMPT_TEXT) -> Column:
    """Labelled lines of the fields that have a value, then the text; both cut to their lengths (SHORT_PROMPT_TEXT for suggestions)."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), F.substring(c, 1, FIELD_TEXT))) for label, c in pairs.items()]
    return F.concat_ws("\n", *lines, F.substring(text, 1, most))


def kept_suggestions(suggestions: Column, known: Column) -> Column:
    """Suggestions (key, value) with a known key and a value that isn't blank."""
    return F.filter(suggestions, lambda s: F.array_contains(known, s["key"]) & (F.coalesce(F.trim(s["value"]), F.lit("")) != ""))
