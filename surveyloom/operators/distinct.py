"""Exact distinct counts that roll up from fine groups to coarse ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.joins import join_on
from surveyloom.sources.staging import stage


def distinct_bitmaps(df: DataFrame, by: Sequence[str], code: str) -> DataFrame:
    """``*by, _bucket, _bits``: which codes occur in each group, one bit a code.

    Distinct codes are numbered once. The numbers are written, so a task that runs again sees the
    same ones; they count up inside each partition and leave gaps only between partitions, so
    buckets are well filled and no window over all codes is needed. NULL is no code.
    """
    pairs = stage(df.select(*by, F.col(code).alias("_code")).where(F.col("_code").isNotNull()).distinct(), "codes")
    numbers = stage(pairs.select("_code").distinct().withColumn("_n", F.monotonically_increasing_id()), "code-numbers")
    numbered = pairs.join(numbers, "_code")
    return numbered.groupBy(*by, F.bitmap_bucket_number("_n").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bits")
    )


def distinct_counts(bitmaps: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Distinct codes of each coarser group: bitmaps are united, never the codes."""
    united = bitmaps.groupBy(*by, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    return united.groupBy(*by).agg(F.sum(F.bitmap_count("_bits")).alias(name))


def distinct_rollup(df: DataFrame, levels: Mapping[str, Sequence[str]], code: str, name: str = "n_codes", level: str = "level") -> DataFrame:
    """Distinct codes at several levels, stacked: ``level``, all keys (NULL above their level), the count.

    The table is scanned once. A level without keys has one row, also for an empty table. A group whose codes are all NULL counts 0.
    """
    keys = list(dict.fromkeys(k for by in levels.values() for k in by))
    groups = stage(df.groupBy(*keys, code).agg(F.lit(1).alias("_1")), "groups")
    bitmaps = stage(distinct_bitmaps(groups, keys, code), "bitmaps")
    parts = []
    for label, by in levels.items():
        counts = distinct_counts(bitmaps, by, name)
        if by:
            counts = join_on(groups.select(*by).distinct(), counts, by, "left")
        types = dict(groups.dtypes)
        columns = [F.col(k) if k in by else F.lit(None).cast(types[k]).alias(k) for k in keys]
        parts.append(counts.select(F.lit(label).alias(level), *columns, F.coalesce(F.col(name), F.lit(0)).alias(name)))
    return reduce(DataFrame.unionAll, parts)
