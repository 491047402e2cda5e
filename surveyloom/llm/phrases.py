"""Phrases that occur far more often than their parts, from sorted streams of counts.

A text is cut into pieces at punctuation and line ends and pieces into words; a phrase is
2 to ``longest`` consecutive words of one piece, counted per language. Counts are built one
length after the other, as streams ``(lang, phrase, count)``. A phrase that occurs
``least`` times has parts that do so too, so the scan for n words counts only the places
where both runs of n - 1 words may be frequent: a bitmap of hashed frequent runs says
so. The bitmap has a fixed size (``FILTER_BITS``) and errs on one side only: what it lets
through by chance is counted exactly and then dropped. A task sorts the words of some
megabytes of text into counts before anything is shuffled.

The streams are then read in two orders. In prefix order a phrase stands behind its first
words, in suffix order behind its last words, so one lockstep merge over each order (a
sort-merge join, no hash table) gives every cut its left and right count, and every
phrase the largest count of its extensions by one word on either side. Longer
extensions need no look: the run between a phrase and a longer one is a candidate itself,
with a count at least as high. Arithmetic is in integers and decimals of 38 digits.

Rules for odd input: NULL text is empty, a NULL lang is ``und``; repeated rows are counted
each; ids are not read, nor are other columns; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.sources.staging import stage

# Characters that end a piece, and white space between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
MARK = b"."  # in no word
TO_MARKS = bytes.maketrans(PIECE_ENDS + b"\x09", MARK * len(PIECE_ENDS) + b" ")
# Bytes of text that a task counts at a time.
TEXT_AT_ONCE = 4 << 20
ROWS_AT_ONCE = 1 << 16
# Bits of the bitmap of frequent runs (8 MB); two of them for each run.
FILTER_BITS = 1 << 26
BITMAP_BITS = 32768  # Spark's own bitmaps
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def run_hashes(words: list[np.ndarray], langs: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs, from the hashes of their words (one array a place) and of their languages."""
    with np.errstate(over="ignore"):
        mixed = langs.copy()
        for place, word in enumerate(words):
            mixed = (mixed ^ word) * ODD[place % len(ODD)]
            mixed ^= mixed >> np.uint64(29)
    return mixed


def filter_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each run in the bitmap."""
    return (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64), (hashes >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def may_be_frequent(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for place in filter_places(hashes):
        ok &= (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return ok


def _hash_all(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, values), np.uint64, len(values))


def count_runs(texts: list[tuple[bytes, bytes]], n: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, f``: counts of the runs of ``n`` words in ``(lang, text)`` pairs.

    For single words, the number of all words of a language comes under a NULL phrase.
    """
    tokens: list[bytes] = []
    sizes = []
    names: dict[bytes, int] = {}
    lang_of = []
    for lang, text in texts:
        here = text.lower().translate(TO_MARKS).replace(MARK, b" . ").split()
        tokens += here
        tokens.append(MARK)
        sizes.append(len(here) + 1)
        lang_of.append(names.setdefault(lang, len(names)))
    encoded = pa.array(tokens, pa.binary()).dictionary_encode()
    del tokens
    vocabulary = encoded.dictionary
    word = encoded.indices.to_numpy()
    lang = np.repeat(np.array(lang_of, np.int32), sizes)
    langs = pa.array(names, pa.binary())
    usable = (pc.not_equal(vocabulary, MARK).to_numpy(zero_copy_only=False))[word]
    if n == 1:
        totals = np.bincount(lang[usable], minlength=len(langs))
        yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.binary()), pa.array(totals, pa.int64())], names=["lang", "phrase", "f"])
    starts = max(len(word) - n + 1, 0)
    ok = np.ones(starts, bool)
    for place in range(n):
        ok &= usable[place : place + starts]
    at = np.flatnonzero(ok)
    if bitmap is not None:
        word_hash, lang_hash = _hash_all(vocabulary.to_pylist()), _hash_all(langs.to_pylist())
        for first in (0, 1):
            hashes = run_hashes([word_hash[word[at + first + place]] for place in range(n - 1)], lang_hash[lang[at]])
            at = at[may_be_frequent(bitmap, hashes)]
    # Sorted into counts, one more word at a time, so that a key stays below 64 bits.
    key = lang[at].astype(np.int64)
    for place in range(n):
        if place:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(vocabulary) + word[at + place]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    at = at[first]
    for low in range(0, len(at), ROWS_AT_ONCE):
        some = at[low : low + ROWS_AT_ONCE]
        words = [vocabulary.take(pa.array(word[some + place])) for place in range(n)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())) if n > 1 else words[0]
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[some])), phrase, pa.array(counts[low : low + ROWS_AT_ONCE])], names=["lang", "phrase", "f"])


def counted_runs(docs: DataFrame, n: int, bitmap: Broadcast | None) -> DataFrame:
    """``lang, phrase, f`` with the counts of each task's blocks of text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = bitmap.value if bitmap else None
        held, size = [], 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                held.append((lang, text.as_py()))
                size += len(held[-1][1])
                if size >= TEXT_AT_ONCE:
                    yield from count_runs(held, n, runs)
                    held, size = [], 0
        if held:
            yield from count_runs(held, n, runs)

    slim = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    found = slim.mapInArrow(scan, "lang binary, phrase binary, f long")
    return found.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f")


def frequent_bitmap(runs: DataFrame) -> np.ndarray:
    """Bitmap of the frequent runs; FILTER_BITS bits reach the driver, whatever their number."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [p.split(b" ") for p in batch["phrase"].to_pylist()]
            n = len(words[0]) if words else 0
            hashes = run_hashes([_hash_all([w[i] for w in words]) for i in range(n)], _hash_all(batch["lang"].to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(filter_places(hashes)) if n else np.zeros(0, np.int64))], names=["bit"])

    bits = runs.select(F.col("lang").cast("binary").alias("lang"), F.col("phrase").cast("binary").alias("phrase")).mapInArrow(places, "bit long")
    # Spark's bitmap functions count from 1.
    bit = F.col("bit") + 1
    maps = bits.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("map"))
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, bitmap in maps.collect():
        low = (part - 1) * BITMAP_BITS // 8
        whole[low : low + len(bitmap)] = np.frombuffer(bytes(bitmap), np.uint8)
    return whole


def count_streams(docs: DataFrame, longest: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """Streams of the frequent runs of 1 to ``longest`` words, and the number of words of each language."""
    streams: list[DataFrame] = []
    bitmap = None
    for n in range(1, longest + 1):
        summed = counted_runs(docs, n, bitmap).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        kept = stage(summed.where((F.col("f") >= least) | F.col("phrase").isNull()), f"runs{n}")
        if n == 1:
            words = kept.where("phrase is null").select("lang", F.col("f").alias("n"))
            kept = kept.where("phrase is not null")
        streams.append(kept)
        if n < longest:
            bitmap = docs.sparkSession.sparkContext.broadcast(frequent_bitmap(kept))
    return streams, words


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, absorbed: int = 80, limit: int | None = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases.

    The score of a cut is ``floor(2000000 * a / (l + r))``; the lowest cut of a phrase counts.
    Phrases inside a longer one that has ``absorbed`` percent of their occurrences are left
    out. ``limit`` None ranks all phrases in one window a language; meant for small tables.
    """
    streams, words = count_streams(docs.select("lang", "text"), longest, least)
    counts = streams[0].select("lang", "phrase", "f")
    for stream in streams[1:]:
        counts = counts.unionByName(stream)
    parts = F.split("phrase", " ")
    join = lambda low, length: F.array_join(F.slice(parts, low, length), " ")
    cuts, parents = [], []
    for size, stream in enumerate(streams[1:], 2):
        for k in range(1, size):
            cuts.append(stream.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"), join(1, k).alias("head"), join(k + 1, size - k).alias("tail")))
        if size > 2:
            parents += [stream.select("lang", join(low, size - 1).alias("phrase"), "f") for low in (1, 2)]

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for table in tables[1:]:
            out = out.unionByName(table)
        return out

    # Prefix order: heads stand before what they begin; suffix order: tails before what they end.
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = union(cuts).join(heads.hint("merge"), ["lang", "head"]).join(tails.hint("merge"), ["lang", "tail"])
    score = F.expr("(CAST(a AS DECIMAL(38, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = both.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    if parents:
        longer = union(parents).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        kept = F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(38, 0)) * 100 < CAST(a AS DECIMAL(38, 0)) * {int(absorbed)}")
        scored = scored.join(longer.hint("merge"), ["lang", "phrase"], "left").where(kept).drop("longer")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    top = scored.withColumn("rank", F.row_number().over(best))
    if limit is not None:
        top = top.where(F.col("rank") <= limit)
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
