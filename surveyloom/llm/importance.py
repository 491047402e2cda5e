"""Importance resampling towards the n-gram distribution of a target corpus.

A text is lower-cased (A-Z only), every run of separators becomes one space, and an
overlapped regular expression scan with look-arounds at the word boundaries emits the
span of every n-gram in place; its UTF-8 bytes go through CRC-32 into one of ``buckets``
counters. A bucket's gain is the smoothed log ratio of its share in the target and in
all documents, in thousandths, rounded down; the weight of a document is the mean gain of
its n-grams, rounded down. A Gumbel key drawn from the seed and the id makes the highest
scores a sample without replacement in proportion to exp(weight / 1000).

The regular expression runs once over each whole text; what it finds is staged as bucket
numbers, from which counts and weights follow. Only the two tables of ``buckets`` counters
reach the driver. Ranks come from a range partition of ``(score, id)``: a row's
place in its own partition plus the rows of the partitions before it, so that no task sees
them all and ties or repeated ids cannot gather in one.

Rules for odd input: NULL and empty texts have no n-gram, weight 0 and no rank; texts with
fewer words than an n-gram needs have none of that length; a NULL id has the key of an empty id and ranks behind equal scores;
repeated rows are ranked each; an empty target gives all buckets nearly the same gain; empty documents
give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.sources.staging import stage

# What separates words once A-Z are lower-cased; bytes of other scripts are parts of words.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TO_SPACES = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
# N-grams and documents that leave a worker at a time.
GRAMS_AT_ONCE = 1 << 19
ROWS_AT_ONCE = 4096
PLACE_BITS = 33


def collapsed(text: bytes) -> bytes:
    """Words of a text with single spaces between them."""
    return b" ".join(text.lower().translate(TO_SPACES).split())


def scanner(words: int) -> regex.Pattern:
    """Pattern of a run of ``words`` whole words; look-arounds keep overlapped matches at word boundaries."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (words - 1))


def bucketed(docs: DataFrame, sizes: range, buckets: int) -> DataFrame:
    """``doc_id, n_words, found``: the bucket of every n-gram of every text, repeats included."""
    patterns = [scanner(n) for n in sizes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, ids, words, lengths, found, at_hand = zlib.crc32, [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), lists], names=["doc_id", "n_words", "found"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                line = collapsed(text.as_py() or b"")
                here = [crc(m[0]) % buckets for p in patterns for m in p.finditer(line, overlapped=True)]
                ids.append(doc_id)
                words.append(line.count(b" ") + 1 if line else 0)
                lengths.append(len(here))
                found.append(np.array(here, np.int32))
                at_hand += len(here)
                if at_hand >= GRAMS_AT_ONCE or len(ids) >= ROWS_AT_ONCE:
                    yield flush()
                    ids, words, lengths, found, at_hand = [], [], [], [], 0
        yield flush()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_words long, found array<int>")


def bucket_counts(grams: DataFrame, buckets: int) -> np.ndarray:
    """Count of every bucket over all documents; ``buckets`` rows at most reach the driver."""
    rows = grams.select(F.explode("found").alias("bucket")).groupBy("bucket").count().collect()
    counts = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        counts[bucket] = n
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of the shares in target and source, in thousandths, rounded down."""
    buckets, whole, wanted = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((float(t) + 1) * (whole + buckets) / ((float(s) + 1) * (wanted + buckets)))) for s, t in zip(source, target)],
        np.int64,
    )


def weighed(grams: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the mean gain of a document's n-grams, rounded down."""
    shared = grams.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            lists = batch["found"]
            ends = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            stops = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()]))
            n = np.diff(stops)
            sums = ends[stops[1:]] - ends[stops[:-1]]
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_words"], pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return grams.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel_key(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Staged rows with their place (from 1) in the order of the whole table, which must be total."""
    sorted_parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_parts.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    # One row for each partition of the staged table, whatever its rows.
    part = F.shiftrightunsigned("_place", PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + inside + 1).drop("_place", "_part", "_start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    sizes: range = range(1, 3),
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document.

    ``rank`` counts the drawn documents from 1 by falling score and rising id and is NULL
    for the others: ``percent`` of the documents with ``least_words`` words are drawn,
    rounded down. ``sizes`` are the lengths of the n-grams.
    """
    grams = stage(bucketed(docs.select("doc_id", "text"), sizes, buckets), "grams")
    wanted = bucketed(target.select(F.lit(None).alias("doc_id"), "text"), sizes, buckets)
    gains = gains_of(bucket_counts(grams, buckets), bucket_counts(wanted, buckets))
    # The number tells repeated rows apart, so that they spread over partitions; staging keeps it.
    numbered = weighed(grams, gains).withColumn("_row", F.monotonically_increasing_id())
    scored = stage(numbered.withColumn("score", F.col("weight") + gumbel_key(F.col("doc_id"), seed)), "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), F.col("_row").asc()]
    placed = ranked(eligible, order, "rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    chosen = placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    short = scored.where(F.col("n_words") < least_words)
    return chosen.unionByName(short.select(*columns, F.lit(None).cast("long").alias("rank")))
