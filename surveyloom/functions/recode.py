"""Categories: ordinals, value maps, fallbacks, multi-way recodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def indicator(cond: Column) -> Column:
    """1, 0 or NULL for a true, false or unknown condition."""
    return cond.cast("int")


def literal_map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs.items())])


def ordinal(col: Column, levels: Sequence[str]) -> Column:
    """Position (from 1) of a label in ``levels``; NULL when not listed."""
    return F.when(col.isNull(), F.lit(None).cast("int")).otherwise(
        F.try_element_at(literal_map({label: i for i, label in enumerate(levels, 1)}), col)
    )


def map_values(col: Column, pairs: Mapping[str, str]) -> Column:
    """Replace listed values; keep the others."""
    return F.coalesce(F.try_element_at(literal_map(pairs), col), col)


def sentinel_fallback(col: Column, sentinel: str, other: Column) -> Column:
    """``other`` where ``col`` is the sentinel; a NULL stays NULL."""
    return F.when(col == sentinel, other).otherwise(col)


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first true rule; unknown conditions do not match."""
    (cond, label), *rest = rules
    out = F.when(cond, F.lit(label))
    for cond, label in rest:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))
