"""Person indicators as data, for two codebooks.

Every rule is a Spark SQL condition cast to int, so an unknown condition gives
NULL and not 0. A level may read the indicators of the level before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.recode import first_match, indicator


@dataclass(frozen=True)
class Codebook:
    levels: tuple[dict[str, str], ...]
    education: tuple[tuple[str, str], ...]
    education_default: str


# The indicator definitions and education tiers of each codebook.
CENSUS = Codebook(
    levels=(
        {
            "WORKINGAGE": "AGEP >= 18 AND AGEP < 65",
            "FTEMP": "ESR = 1 AND WKHP >= 35 AND WKW <= 3",
            "FEM": "SEX = 2",
            "MAL": "SEX = 1",
            "MOM": "PAOC <= 3 AND SEX = 2",
            "MOMYC": "PAOC IN (1, 3) AND SEX = 2",
            "LESSBACH": "SCHL <= 20",
            "BACHMORE": "SCHL >= 21",
        },
        {
            "PTEMP": "ESR = 1 AND WKHP > 0 AND WKW <= 5 AND FTEMP = 0",
            "SMOM": "MOM = 1 AND MAR >= 2",
            "SMOMYC": "MOMYC = 1 AND MAR >= 2",
        },
    ),
    education=(
        ("SCHL = 20", "Associate"),
        ("SCHL >= 21", "Bach or more"),
        ("SCHL >= 18", "Some college"),
        ("SCHL >= 16", "HS or GED"),
    ),
    education_default="Less than HS",
)
HARMONISED = Codebook(
    levels=(
        {
            "WORKINGAGE": "AGE >= 18 AND AGE < 65",
            "FTEMP": "EMPSTAT = 1 AND UHRSWORK >= 35 AND WKSWORK2 >= 4",
            "FEM": "SEX = 2",
            "MAL": "SEX = 1",
            "MOM": "NCHILD >= 1 AND SEX = 2",
            "MOMYC": "NCHLT5 >= 1 AND SEX = 2",
            "LESSBACH": "EDUCD <= 100",
            "BACHMORE": "EDUCD <> 999 AND EDUCD >= 101",
        },
        {
            "PTEMP": "EMPSTAT = 1 AND UHRSWORK >= 3 AND WKSWORK2 >= 2 AND FTEMP = 0",
            "SMOM": "MOM = 1 AND MARST >= 3",
            "SMOMYC": "MOMYC = 1 AND MARST >= 3",
        },
    ),
    education=(
        ("EDUCD = 999", "Missing"),
        ("EDUCD >= 101", "Bach or more"),
        ("EDUCD >= 90", "Some college"),
        ("EDUCD >= 81", "Associate"),
        ("EDUCD >= 65", "Some college"),
        ("EDUCD >= 62", "HS or GED"),
    ),
    education_default="Less than HS",
)


def education_tier(book: Codebook):
    return first_match([(F.expr(cond), label) for cond, label in book.education], book.education_default)


def add_indicators(df: DataFrame, book: Codebook) -> DataFrame:
    """Add all indicators, the education tier ``EDATT_RC`` and the constant ``CNT``."""
    for rules in book.levels:
        df = df.withColumns({name: indicator(F.expr(rule)) for name, rule in rules.items()})
    return df.withColumns({"EDATT_RC": education_tier(book), "CNT": F.lit(1)})
