"""Scaling, shares and report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale(col: Column, *factors: Column | float) -> Column:
    """Multiply by each factor in order, as double."""
    out = col.cast("double")
    for f in factors:
        out = out * (f if isinstance(f, Column) else F.lit(float(f)))
    return out


def share(part: Column, whole: Column) -> Column:
    """``part / whole``; NULL where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def dollar_text(col: Column, digits: int = 2) -> Column:
    """``$1,234.50``; negative amounts carry the sign before the mark."""
    sign = F.when(col < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.concat(sign, F.format_number(F.abs(col), digits))


def percent_text(col: Column, digits: int = 1) -> Column:
    """A fraction as percent text, ``0.125`` to ``12.5%``."""
    return F.concat(F.format_number(col * 100, digits), F.lit("%"))
