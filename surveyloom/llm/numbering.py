"""Running totals within a key, split so that a key of any size is shared by many tasks.

``chunk`` is a column that cuts each key into pieces in the wanted order. A piece
is summed by one window; what the earlier pieces of the key hold is added from a
table with one row for each key and piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame, key: str, chunk: str, order: Sequence[Column], weight: Column, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the key before this one.

    A NULL key is a key of its own; ``chunk`` is never NULL. The order must be total up to rows that are
    equal in every column, else the totals of tied rows may swap places.
    """
    # Plain equality of columns that are never NULL lets the join use the window's partitions.
    piece = ["_no_key", "_key", "_piece"]
    keyed = df.withColumns({"_no_key": F.col(key).isNull(), "_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_piece": F.col(chunk)})
    totals = keyed.groupBy(*piece).agg(F.sum(weight).alias("_inside"))
    earlier = Window.partitionBy("_no_key", "_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*piece, F.coalesce(F.sum("_inside").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(starts, piece).withColumn(name, F.col("_start") + F.col("_local")).drop(*piece, "_start", "_local")
