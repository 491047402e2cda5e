"""Student t quantiles for whole degrees of freedom."""

from __future__ import annotations

from functools import lru_cache
from math import atan, cos, pi, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _central_mass(t: float, df: int) -> float:
    """P(-t <= T <= t) by the finite trigonometric series."""
    a = atan(t / sqrt(df))
    s, c = sin(a), cos(a)
    odd = df % 2
    term = c if odd else 1.0
    series = 0.0
    for k in range(3 if odd else 2, df + 1, 2):
        series += term
        term *= c * c * (k - 1) / k
    return 2 / pi * (a + s * series) if odd else s * series


@lru_cache(maxsize=None)
def t_quantile(df: int, level: float = 0.95) -> float:
    """Two-sided ``level`` point of the t distribution, by bisection."""
    lo, hi = 0.0, 1.0
    while _central_mass(hi, df) < level:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if _central_mass(mid, df) < level:
            lo = mid
        else:
            hi = mid
    return hi


def t_quantile_column(df: Column, max_df: int, level: float = 0.95) -> Column:
    """Lookup by an integer column; NULL below 1, ``max_df`` is the last entry."""
    table = F.expr("array(" + ", ".join(f"{t_quantile(k, level)!r}D" for k in range(1, max_df + 1)) + ")")
    return F.when(df >= 1, F.try_element_at(table, df.cast("int")))
