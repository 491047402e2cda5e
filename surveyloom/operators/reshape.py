"""Stacking, labelling, long and wide forms, column shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.money import share


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a missing column is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def stack_labelled(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """Union that records the label of the source table."""
    return stack_tables([df.select(F.lit(label).alias(name), "*") for label, df in tables.items()])


def to_long(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Every column as one (name, value) row."""
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    return cast.unpivot([], df.columns, name, value)


def to_wide(df: DataFrame, keys: Sequence[str], names: str, value: str, levels: Sequence | None = None) -> DataFrame:
    """One column per level of ``names``.

    Without ``levels`` they are read from the data in a job of their own, however many there are. With
    them no job runs, and a row of a level that is not listed fails instead of vanishing.
    """
    if levels is None:
        # One row a column of the result. Named levels are not subject to ``spark.sql.pivotMaxValues``.
        df = df.withColumn(names, F.col(f"`{names}`").cast("string"))
        found = [r[0] for r in df.select(f"`{names}`").distinct().sort(f"`{names}`").collect()]
        return df.groupBy(*keys).pivot(names, found).agg(F.first(value))
    unlisted = F.raise_error(F.format_string("%s is not a listed level", F.col(names)))
    checked = F.when(F.col(names).isNull() | F.col(names).isin(list(levels)), F.col(names)).otherwise(unlisted)
    return df.withColumn(names, checked).groupBy(*keys).pivot(names, list(levels)).agg(F.first(value))


def column_shares(df: DataFrame, shares: Mapping[str, str]) -> DataFrame:
    """Add each column's share of its own total.

    The totals are scalar subqueries: one number each from a partial aggregation,
    without a join.
    """
    totals = {c: df.agg(F.sum(c)).scalar() for c in shares.values()}
    return df.select(*df.columns, *[share(F.col(c), totals[c]).alias(p) for p, c in shares.items()])


def row_shares(df: DataFrame, shares: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``part / whole`` columns."""
    return df.withColumns({p: share(F.col(a), F.col(b)) for p, (a, b) in shares.items()})
