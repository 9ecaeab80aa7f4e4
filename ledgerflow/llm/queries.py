"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from ledgerflow.llm import bpe_matrix, centroid_clustering, embedding_dedup, fingerprints, hard_negatives, lm_scoring, minhash_dedup, oracle, packing, paragraph_dedup, sentencepiece_codec, suffix_dedup, token_output, toxicity
from ledgerflow.llm.runtime import table, table_path

#: The vocabulary of the token queries; operators take any path.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

#: The rank file of the matrix encoder.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=["doc_id"])
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trips(table(spark, sf_dir, "documents"), PIECE_BPE)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_BPE, end=0)
    return token_output.with_crc32(token_output.read_tokens(spark, path))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans_by_document(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.duplicate_passages(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` with their places in sequences of 1024 tokens: the pieces' ids are written once and read once, for
    their digests; lengths are counted without them, and only lengths and digests travel."""
    path = table_path(spark, "pieces")
    packing.cut_pieces(docs, BYTE_BPE, end=2).write.options(**token_output.FILE_OPTIONS).parquet(path)
    files = spark.read.schema(packing.PIECES).parquet(path)
    return packing.pack(token_output.with_crc32(files), lengths=files.select("doc_id", "piece", "length"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dimension=64, seed=3)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_matrix.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe_matrix.digests(encoded, RANKS, public_tokenizers.PATTERN)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_token_output,
        op3_toxicity,
        op4_minhash_dedup,
        op5_suffix_dedup,
        op6_substring_dedup,
        op7_best_fit_packing,
        op8_lm_scoring,
        op9_embedding_dedup,
        op10_fingerprints,
        op11_hard_negatives,
        op12_centroid_clustering,
        op13_byte_bpe,
    )
}

ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": oracle.hard_negatives(), "op12_centroid_clustering": oracle.clustering()}
