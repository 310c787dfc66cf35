"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.llm import ann_forest, centroids, chat_format, chunk_dedup, decontaminate, language_id, line_dedup, ngram_join, piece_codec, token_alignment, token_counts, topk_search, toxicity
from vendora.plans.checkpoints import discard

QUERY_STEP = 50
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(path: str | None, name: str) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


def piece_model(path: str | None = None) -> bytes:
    """Bytes of a tokenizer file, read on the driver and sent to the executors."""
    return _tokenizer(path, PIECE_MODEL)


def byte_model(path: str | None = None) -> bytes:
    """As piece_model, of the byte-level tokenizer."""
    return _tokenizer(path, BYTE_MODEL)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0), 5)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), *token_counts.pieces_of_model(piece_model()))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict_languages(docs, language_id.learn(docs))
    return found.select("doc_id", language_id.is_held_out().alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip_digests(table(spark, sf_dir, "documents"), piece_model())


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).selectExpr("-7L conv_id", f"explode(array(struct(0L as turn, 'user' as role, '{said}' as text), struct(1L as turn, 'assistant' as role, '{said}' as text))) x").select("conv_id", "x.*")
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "cast(role as string) role", "cast(text as string) text").unionByName(extra)
    return chat_format.digests(chat_format.format_table(rows))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample, rate = toxicity.sample_labelled(docs, labels)
    model = toxicity.fit(sample, rate)
    discard(sample)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(centroids.integer_vectors(table(spark, sf_dir, "embeddings")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digests(table(spark, sf_dir, "documents"), byte_model(), piece_model())


def op13_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann_forest.clean_vectors(table(spark, sf_dir, "embeddings"))
    return ann_forest.nearest(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0), 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_join": op3_ngram_join,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_centroids": op11_centroids,
    "op12_token_alignment": op12_token_alignment,
    "op13_ann_forest": op13_ann_forest,
}


def _rounds_in_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds one after another: c0 are the first centroids, a_i the rows with their cluster, c_i the centroids after round i."""
    nearest = """a{i} as materialized (
            select vec_id, p, near.num as cluster, near.d as distance from (
                select vec_id, p, (select min({{'d': list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'num': num}}) from c{i}) near from points))"""
    # Integer division rounds down here as well below zero.
    moved = """s{i} as (select cluster, j, sum(p[j]) s, count(*) n from a{i}, unnest(range(1, 65)) u(j) group by 1, 2),
        m{i} as (select cluster, list(((s - ((s % n) + n) % n)::hugeint // n)::bigint order by j) mean from s{i} group by 1),
        c{j} as materialized (select num, coalesce(mean, q) q from c{i} left join m{i} on cluster = num)"""
    parts = [x for i in range(rounds) for x in (nearest.format(i=i), moved.format(i=i, j=i + 1))] + [nearest.format(i=rounds)]
    return f"""
        with points as materialized (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) p from embeddings
            where vec_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c0 as materialized (select row_number() over (order by h, p) - 1 num, p q from (select sha256('3:' || vec_id) h, p from points order by h, p limit {k})),
        {", ".join(parts)}
        select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
               sha256(array_to_string(q, ',')) as centroid_sha256
        from a{rounds} join c{rounds} on num = cluster"""

SQL: dict[str, str] = {
    "op1_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
        select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
    "op3_ngram_join": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
        s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                                  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) sh from w),
        n as (select doc_id, count(*) n from s group by doc_id),
        p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on l.a = r.b)
        select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id
        from documents d left join n using (doc_id) join (select a, min(b) c from r group by a) m on m.a = d.doc_id""",
    "op7_chat_format": r"""
        with c as (
            select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e as (select *, length(role || text) + length(regexp_replace(role || chr(10) || text, '[^\\]', '', 'g'))
                + len(regexp_extract_all(role || chr(10) || text, '<\||</?s>|\[/?INST\]')) + 23 as chars from c)
        select conv_id, count(*)::bigint as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               sum(chars)::bigint as formatted_chars
        from e group by conv_id""",
    # DuckDB counts edits in bytes: letters of two bytes that the tables use become single ones first.
    "op9_line_dedup": r"""
        with recursive l as (
            select doc_id, n, lines[n + 1] line, len(lines) n_lines from (select doc_id, string_split(text, chr(10)) lines from documents where text <> ''), unnest(range(len(lines))) u(n)),
        k as (select line, translate(line, 'éèçêÉäüößÈóñíÑÇÄÊÜÍÓÖáúâî', (select string_agg(chr(c::int), '' order by c) from (select unnest(range(1, 33)) c) where c not in (9, 10, 13, 32))) as plain, length(line) n from l where length(line) >= 20 group by line),
        own as (select line, plain, n, i, substr(plain, i * (n // 3) + greatest(i - 3 + n % 3, 0) + 1, n // 3 + (i >= 3 - n % 3)::int) seg from k, unnest(range(3)) u(i)),
        probe as (
            select line, plain, m, i, substr(plain, i * (m // 3) + greatest(i - 3 + m % 3, 0) + 1 + s, m // 3 + (i >= 3 - m % 3)::int) seg
            from (select line, plain, n, n - g as m from k, unnest(range(3)) u(g)), unnest(range(3)) v(i), unnest(range(-2, 3)) w(s)
            where i * (m // 3) + greatest(i - 3 + m % 3, 0) + s >= 0 and i * (m // 3) + greatest(i - 3 + m % 3, 0) + s + m // 3 + (i >= 3 - m % 3)::int <= n),
        c as (select distinct own.line a, own.plain pa, probe.line b, probe.plain pb from own join probe on own.n = probe.m and own.i = probe.i and own.seg = probe.seg and own.line <> probe.line),
        e as (select a, b from c where levenshtein(pa, pb) <= 2 union select b, a from c where levenshtein(pa, pb) <= 2),
        r as (select line a, line b from k union select r.a, e.b from r join e on e.a = r.b),
        cls as (select a line, min(b) comp from r group by a),
        p as (select doc_id, n, row_number() over (partition by comp order by doc_id, n) > 1 as gone from l join cls using (line))
        select d.doc_id, coalesce(len(string_split(nullif(d.text, ''), chr(10))), 0)::bigint as n_lines, coalesce(x.n_dropped, 0)::bigint as n_dropped,
               case when d.text is null then null when d.text = '' then sha256('') else sha256(coalesce(x.kept, '')) end as kept_sha256
        from documents d left join (
            select l.doc_id, string_agg(line, chr(10) order by l.n) filter (not coalesce(gone, false)) kept, count(*) filter (gone) n_dropped from l left join p on p.doc_id = l.doc_id and p.n = l.n group by 1) x on x.doc_id = d.doc_id""",
    "op11_centroids": _rounds_in_sql(centroids.K, centroids.ROUNDS),
}
