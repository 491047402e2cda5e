"""Cleaning of coded statistical text: null codes, top-codes, numbers, codes.

Every function takes and returns a Column, so Catalyst can fuse the whole
cleaning step of a table into one projection over the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes that mean "no value" in the published sources.
WAGE_NULL_CODES = ("*", "**")
MICRODATA_NULL_PATTERN = "^b{1,8}$"
TEXT_NULLS = ("", "NA")
TOP_CODE_MARK = "#"
HOURLY_TOP_CODE = "101.00"
ANNUAL_TOP_CODE = "209000"


def null_if_any(col: Column, codes: Iterable[str]) -> Column:
    """NULL where the text equals one of ``codes``; otherwise unchanged."""
    return F.when(col.isin(*codes), F.lit(None)).otherwise(col)


def null_microdata_codes(col: Column) -> Column:
    """NULL for 1 to 8 letters ``b``, for empty text and for ``NA``."""
    blank = col.rlike(MICRODATA_NULL_PATTERN) | col.isin(*TEXT_NULLS)
    return F.when(blank, F.lit(None)).otherwise(col)


def to_number(col: Column) -> Column:
    """Plain numeric cast that gives NULL, not an error, on other text."""
    return col.try_cast("double")


def parse_number(col: Column) -> Column:
    """First number in a text that may hold ``,`` ``$`` ``%`` or words."""
    digits = F.regexp_extract(F.regexp_replace(col, ",", ""), r"-?[0-9]+\.?[0-9]*|-?\.[0-9]+", 0)
    return F.nullif(digits, F.lit("")).try_cast("double")


def replace_top_code(col: Column, value: str, mark: str = TOP_CODE_MARK) -> Column:
    """Put the top-code value in place of every mark."""
    return F.replace(col, F.lit(mark), F.lit(value))


def remove_first(col: Column, mark: str = "-") -> Column:
    """Remove the first ``mark`` only; later ones stay."""
    return F.regexp_replace(col, f"^([^{mark}]*){mark}", "$1")


def is_group_code(col: Column, suffix: str = "-0000") -> Column:
    """True for codes of occupation groups; a NULL code is not a group."""
    return F.coalesce(col.contains(suffix), F.lit(False))


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from ``first`` to ``last`` in schema order."""
    names = df.columns
    lo, hi = names.index(first), names.index(last)
    if hi < lo:
        raise ValueError(f"{last} comes before {first}")
    return names[lo : hi + 1]


def across(
    df: DataFrame,
    fn: Callable[[Column], Column],
    columns: Sequence[str] | None = None,
    only_strings: bool = False,
) -> DataFrame:
    """Apply ``fn`` to each named column (default: all) in one projection."""
    chosen = set(df.columns if columns is None else columns)
    if only_strings:
        chosen &= {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[fn(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])
