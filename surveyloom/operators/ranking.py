"""Average ranks, top lists and first-row-per-key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.operators.joins import join_on
from surveyloom.sources.staging import stage


def _value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))


def average_rank(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Descending rank within the group; ties share the mean of their places.

    Rows collapse to counts per value. A range partition cuts the sorted counts at split points
    taken from the data, so a large group, however close its values, is
    shared by many tasks; the counts of a group's earlier ranges are added to the places
    inside a range. The sorted counts are staged, so the cuts are the same wherever they are read. A NULL value has a NULL rank.
    """
    counts = _value_counts(df, group, value)
    order = [*[F.col(g).asc() for g in group], F.col(value).desc()]
    ranged = stage(counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    per_range = ranged.groupBy(*group, "_range").agg(F.sum("_n").alias("_inside"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*group, "_range", F.coalesce(F.sum("_inside").over(earlier), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, "_range").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = join_on(ranged, offsets, [*group, "_range"], "inner")
    above = F.col("_before") + F.coalesce(F.sum("_n").over(inner), F.lit(0))
    ranks = placed.select(*group, value, (above + (F.col("_n") + 1) / 2.0).alias(name))
    return join_on(df, ranks, [*group, value], "left").select(*df.columns, name)


def top_by_rank(df: DataFrame, group: Sequence[str], value: str, name: str, limit: int) -> DataFrame:
    """Rows whose average rank is at most ``limit``; ties may change the count.

    Only the ``limit`` largest distinct values of a group can have such a rank,
    so each task passes on at most that many values per group.
    """
    order = Window.partitionBy(*group).orderBy(F.col(value).desc())
    counts = _value_counts(df, group, value)
    largest = counts.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit)
    above = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = largest.select(*group, value, (above + (F.col("_n") + 1) / 2.0).alias(name)).where(F.col(name) <= limit)
    return join_on(df, ranks, [*group, value], "inner").select(*df.columns, name)


def top_n(df: DataFrame, n: int, value: str, ties: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest rows overall or per group, NULL values last.

    Ties break on ``ties`` ascending. Spark keeps ``n`` rows per task before
    the exchange in both forms (top-k sort, or window group limit).
    """
    order: list[Column] = [F.col(value).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    if not group:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Whole first row of each key in an explicit order.

    ``min_by`` over a struct combines on the map side; no key's rows are
    gathered in one task.
    """
    order = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order_by])
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns]), order)
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def distinct_count(column: str) -> Column:
    """Number of distinct values, where NULL counts as one value."""
    return F.count_distinct(F.col(column)) + F.max(F.col(column).isNull().cast("int"))
