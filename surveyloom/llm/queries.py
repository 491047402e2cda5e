"""Registered queries of the training-data operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.jump_shards import shard_documents
from surveyloom.llm import sql
from surveyloom.llm.importance import resample
from surveyloom.llm.line_templates import drop_recurring_lines
from surveyloom.llm.multi_index import near_duplicate_vectors
from surveyloom.llm.neighbour_votes import in_fold_zero, vote_quality
from surveyloom.llm.ordinal import grade_toxicity
from surveyloom.llm.pfair import mix_sources
from surveyloom.llm.phrases import collocations
from surveyloom.llm.piece_trie import encode_documents
from surveyloom.llm.ppm import in_fold_one, predict_languages
from surveyloom.llm.repair import read_shards, write_shards
from surveyloom.llm.risk_rules import apply_quality_rules
from surveyloom.llm.simhash import near_duplicates
from surveyloom.sources.staging import new_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), similarity=0.93)


def op2_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "repair-shards")
    files = write_shards(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_shards(spark, folder, files)


def op3_piece_trie_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text (marks read as spaces)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op4_simhash_segment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("n_bytes"))
    return mix_sources(docs, F.col("n_bytes")).drop("n_bytes")


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("failed_rules")


def op8_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), 24)


def op9_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold_one(F.col("doc_id"))
    found = predict_languages(_table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_overlapped_scan_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), sizes=range(1, 2))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold_zero(F.col("doc_id"))
    found = vote_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out, cutoff=0.3)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_multi_index_vectors": op1_multi_index_vectors,
    "op2_repair_token_files": op2_repair_token_files,
    "op3_piece_trie_round_trip": op3_piece_trie_round_trip,
    "op4_simhash_segment_grid": op4_simhash_segment_grid,
    "op5_pfair_mixture": op5_pfair_mixture,
    "op6_ordinal_toxicity": op6_ordinal_toxicity,
    "op7_risk_controlled_rules": op7_risk_controlled_rules,
    "op8_jump_hash_shards": op8_jump_hash_shards,
    "op9_ppm_language_id": op9_ppm_language_id,
    "op10_line_templates": op10_line_templates,
    "op11_overlapped_scan_resampling": op11_overlapped_scan_resampling,
    "op12_neighbour_votes": op12_neighbour_votes,
    "op13_phrase_streams": op13_phrase_streams,
}

# The others write files, hash, train or count bits in ways that SQL cannot follow; see tests/llm.
SQL: dict[str, str] = {
    "op1_multi_index_vectors": sql.OP1,
    "op7_risk_controlled_rules": sql.OP7,
    "op11_overlapped_scan_resampling": sql.OP11,
    "op13_phrase_streams": sql.OP13,
}
