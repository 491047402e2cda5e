"""Training-data pipeline over documents: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.line_templates import drop_recurring_lines
from surveyloom.llm.pfair import mix_sources
from surveyloom.llm.piece_trie import encode_documents
from surveyloom.llm.ppm import in_fold_one, predict_languages
from surveyloom.llm.simhash import near_duplicates
from surveyloom.sources.staging import new_folder

# Languages whose share of the posterior is below this are not recognised.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; text without a letter is not."""
    found = predict_languages(docs, ~in_fold_one(F.col("doc_id")))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier document; a document of nothing else goes."""
    cleaned = drop_recurring_lines(docs)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")
    return cleaned.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Rows that repeat a kept id and its text stay as one; other texts under a kept id, and
    documents without an id, stay.
    """
    kept = near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    rows = whole.join(kept, F.col("_row.doc_id") == F.col("_kept"), "left_semi")
    keyed = rows.select("_row", F.col("_row.doc_id").alias("_id"), F.xxhash64("_row.text").alias("_hash"))
    once = keyed.dropDuplicates(["_id", "_hash"]).select("_row.*")
    return once.unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture, sources below their target repeated."""
    mixed = mix_sources(docs, F.octet_length("text"))
    return mixed.repartitionByRange("slot", "doc_id").sortWithinPartitions("slot", "doc_id").select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(docs.select("doc_id", "lang", "source", "text"), model, decoded=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing", mix),
    ("SentencePiece", sentence_pieces),
]

# Byte context trees, block schedules and merges have no SQL form; see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is staged as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
