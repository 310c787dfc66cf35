"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents; the last returns the token ids.  Every stage takes null and empty texts, texts
of any length, rows without doc_id, repeated rows and doc_ids, columns of any other name
and an empty table; what becomes of them is said at each stage and its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vendora.llm import decontaminate, language_id, line_dedup, ngram_join, piece_codec
from vendora.llm.queries import piece_model, table
from vendora.plans.checkpoints import discard, materialize, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (null texts, texts without letters) go; a null lang becomes the one found."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier one go, and documents of which nothing is left; n_chars follows the text."""
    return line_dedup.drop_repeated_lines(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays; of identical rows one."""
    return ngram_join.keep_first_of_components(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text; of a null or empty text the end id alone."""
    return piece_codec.encode_documents(docs, piece_model())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding", encode_pieces),
]

#: SQL can't express language profiles or BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables that stages wrote on the way are deleted as soon as the next stage has been written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, result = docs, stage(spark, docs, sf_dir)
        docs = materialize(result)
        release(result)  # what the stage's plan reads, the stage before included
        discard(before)
    return docs
