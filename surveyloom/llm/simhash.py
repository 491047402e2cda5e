"""SimHash near-duplicates, found through counts of set bits in segments.

A fingerprint of 64 bits is mapped to the number of set bits in each of 32 segments
of two bits. The Manhattan distance of two such vectors is never above the number of
differing bits, so fingerprints within ``distance`` bits lie within Manhattan distance
``distance``. The vectors live on a grid. Instead of visiting all grid cells in range
(746,241 of them at distance 4), the 32 axes are dealt into ``axis_groups`` groups: a
Manhattan distance of ``distance`` touches at most that many groups, so two
fingerprints in range share the grid cell of some ``axis_groups - distance`` groups.
Every choice of groups gives one cell to each fingerprint, and the range join is made
inside cells: Manhattan distance first, then the exact number of differing bits.

Documents with one fingerprint meet once, before any comparison. A cell with many
fingerprints is cut into blocks, all pairs of blocks are compared, and what is found
leaves a task as one link for each fingerprint, not as all pairs.

Rules for odd input: text without a word, or NULL, has fingerprint 0 and is linked like
any other; fewer than ``shingle_words`` words are one shingle; a document without an id
gets a fingerprint but joins no component (its component is NULL); repeated rows
and tied ids are in one component; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.cells import in_units, pairs_by_lag, whole_units
from surveyloom.llm.components import connected_components
from surveyloom.sources.staging import stage

SEED = 42
# Shingles whose bits are counted at a time.
SHINGLES_AT_ONCE = 1 << 16
LOW_BITS = np.uint64(0x5555555555555555)


def fingerprint_of(text: bytes, shingle_words: int) -> int:
    """``bytes.lower`` and ``bytes.split`` know ASCII letters and the six ASCII white spaces only."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - shingle_words + 1].tolist()
    stops = ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), SHINGLES_AT_ONCE):
        some = hashes[low : low + SHINGLES_AT_ONCE]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle_words: int = 4) -> Column:
    """Signed 64-bit SimHash of a text column."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint_of(t or b"", shingle_words) for t in texts], np.uint64)
            yield pd.Series(found.view(np.int64))

    return simhash(text.cast("binary"))


def segment_counts(bits: np.ndarray) -> np.ndarray:
    """Set bits of each two-bit segment, in place of the segment."""
    return (bits & LOW_BITS) + ((bits >> np.uint64(1)) & LOW_BITS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of segment counts; counts are 0 to 2, in fields of two bits."""
    high = LOW_BITS << np.uint64(1)
    # Counts 0, 1, 2 as the unary codes 00, 01, 11: their distance is the number of differing bits.
    ua, ub = (a | ((a & high) >> np.uint64(1))), (b | ((b & high) >> np.uint64(1)))
    return np.bitwise_count(ua ^ ub)


def grid_cells(counts: Column, axis_groups: int, distance: int) -> Column:
    """One cell number for every choice of ``axis_groups - distance`` groups of axes."""
    edges = [round(32 * g / axis_groups) for g in range(axis_groups + 1)]
    masks = [sum(3 << (2 * axis) for axis in range(a, b)) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    choices = list(combinations(masks, axis_groups - distance))
    return F.array(*[F.xxhash64(F.lit(k), counts.bitwiseAND(F.lit(signed(sum(choice))))) for k, choice in enumerate(choices)])


def _counts_column(bits: Column) -> Column:
    low = F.lit(int(LOW_BITS))
    odd = F.shiftrightunsigned(bits, 1).bitwiseAND(low)
    even = bits.bitwiseAND(low)
    # Field by field the sum has no carry; as two's complement it may still leave the signed range.
    both = even.bitwiseAND(odd)
    return F.shiftleft(both, 1).bitwiseOR(even.bitwiseXOR(odd))


def linked_fingerprints(bits: DataFrame, distance: int, axis_groups: int) -> DataFrame:
    """Links ``src, dst`` that connect all fingerprints in range; ``bits`` holds distinct ones in ``fp``."""
    cells = bits.select("fp", F.explode(grid_cells(_counts_column(F.col("fp")), axis_groups, distance)).alias("cell"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            fp = table["fp"].to_numpy()
            raw = fp.view(np.uint64)
            counts = segment_counts(raw)

            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = manhattan(counts[i], counts[j]) <= distance
                ok[ok] = np.bitwise_count(raw[i[ok]] ^ raw[j[ok]]) <= distance
                return ok

            i, j = pairs_by_lag(table["unit"].to_numpy(), near)
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["src", "dst"])

    return in_units(cells, "cell", "fp").select("unit", "fp").mapInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle_words: int = 4, axis_groups: int = 8) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest doc_id reachable over links, itself included.

    More ``axis_groups`` make cells smaller and more numerous: 8 gives 70 cells to a
    fingerprint, each with one in 7 million others by chance; 10 gives 210, with one in
    150 million. Any number above ``distance`` finds the same links.
    """
    if axis_groups <= distance:
        raise ValueError(f"axis_groups must be above {distance}; there are {math.comb(axis_groups, distance)} choices")
    prints = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), shingle_words).alias("fp")), "fingerprints")
    groups = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    # One row becomes very many, so the rows are spread before, whatever their own size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = linked_fingerprints(groups.select("fp").repartition(tasks), distance, axis_groups).distinct()
    by_doc = (
        links.join(groups.select(F.col("fp").alias("src"), F.col("least").alias("_a")), "src")
        .join(groups.select(F.col("fp").alias("dst"), F.col("least").alias("_b")), "dst")
        .select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
    )
    found = connected_components(by_doc)
    classes = groups.join(found, groups["least"] == found["node"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("_component")
    )
    joined = prints.join(classes, prints["fp"] == classes["_fp"], "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"),
    )
