"""What to estimate: measures, and blocks of measures over a sub-population."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Measure:
    """One estimate ``name`` and its standard error ``name_se``.

    With ``strict`` a NULL input in the group makes the estimate NULL;
    otherwise NULL inputs are skipped.
    """

    kind: str
    name: str
    column: str | None = None
    strict: bool = False


def total(name: str, column: str | None = None, strict: bool = False) -> Measure:
    """Weighted total of a column, or the weighted population count."""
    return Measure("total", name, column, strict)


def mean(name: str, column: str, strict: bool = False) -> Measure:
    """Weighted mean."""
    return Measure("mean", name, column, strict)


def median(name: str, column: str) -> Measure:
    """Weighted median: the smallest value that reaches half of the weight."""
    return Measure("median", name, column)


@dataclass(frozen=True)
class Block:
    """Measures over the rows where ``where`` holds (all rows when None)."""

    measures: Sequence[Measure]
    where: Column | None = None

    def columns_of(self, *kinds: str) -> list[str]:
        """Distinct input columns of the measures of these kinds."""
        return list(dict.fromkeys(m.column for m in self.measures if m.kind in kinds and m.column))

    def estimate_columns(self) -> list[str]:
        return [c for m in self.measures for c in (m.name, f"{m.name}_se")]
