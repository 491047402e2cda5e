"""Occupation tables: cleaned wages, projections, promising occupations, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.cleaning import (
    ANNUAL_TOP_CODE,
    HOURLY_TOP_CODE,
    WAGE_NULL_CODES,
    column_range,
    is_group_code,
    null_if_any,
    parse_number,
    replace_top_code,
)
from surveyloom.functions.money import dollar_text, percent_text
from surveyloom.functions.recode import ordinal
from surveyloom.operators.joins import fold_join
from surveyloom.operators.ranking import top_by_rank
from surveyloom.operators.reshape import to_wide
from surveyloom.sources.schemas import ANNUAL_WAGES, HOURLY_WAGES

# Category levels in order, from lowest to highest.
EDUCATION_LEVELS = (
    "No formal educational credential",
    "High school diploma or equivalent",
    "Some college, no degree",
    "Postsecondary nondegree award",
    "Associate's degree",
    "Bachelor's degree",
    "Master's degree",
    "Doctoral or professional degree",
)
EXPERIENCE_LEVELS = ("None", "Less than 5 years", "5 years or more")
TRAINING_LEVELS = (
    "None",
    "Short-term on-the-job training",
    "Moderate-term on-the-job training",
    "Long-term on-the-job training",
    "Apprenticeship",
    "Internship/residency",
)
# New column names.
PROJECTION_NAMES = {"SOC Code2": "OCC_CODE", "Occupation Title": "OCC_TITLEAZ"}
EDUCATION_NAMES = {
    "2021 National Employment Matrix code": "OCC_CODE",
    "2021 National Employment Matrix title": "OCC_TITLE21",
    "Typical education needed for entry": "ED_REQ",
    "Work experience in a related occupation": "EXP_REQ",
    "Typical on-the-job training needed to attain competency in the occupation": "TRN_REQ",
}
# Columns that the merge leaves out.
UNUSED = ["state", "NAICS", "NAICS_TITLE", "I_GROUP", "OWN_CODE", "OCC_TITLEAZ", "PCT_TOTAL", "PCT_RPT", "O_GROUP"]
# Column names of the report.
REPORT_NAMES = {
    "OCC_TITLE": "Occupation",
    "H_MEDIAN": "Med_Wage",
    "percchange_2030": "Growth_2030",
    "avg_annualopenings": "Openings",
    "ED_REQ": "Education",
    "EXP_REQ": "Experience",
}
PROJECTION_YEARS = 10


def clean_wages(df: DataFrame) -> DataFrame:
    """Null codes, top-codes and numbers of the wage table, in one projection."""
    top = {c: HOURLY_TOP_CODE for c in HOURLY_WAGES} | {c: ANNUAL_TOP_CODE for c in ANNUAL_WAGES}
    numeric = set(column_range(df, "TOT_EMP", "A_PCT90"))
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

    def clean(name: str) -> Column:
        col = F.col(f"`{name}`")
        if name not in text:
            return col
        col = null_if_any(col, WAGE_NULL_CODES)
        if name in top:
            col = replace_top_code(col, top[name])
        return (parse_number(col) if name in numeric else col).alias(name)

    return df.select(*[clean(c) for c in df.columns])


def clean_projections(df: DataFrame, area: str) -> DataFrame:
    """Renamed projections with average openings per year; ``area`` names the area column."""
    return df.withColumnsRenamed({"Area Name": area, **PROJECTION_NAMES}).withColumn(
        "avg_annualopenings", F.col("total_openings") / PROJECTION_YEARS
    )


def clean_education(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(EDUCATION_NAMES)


def merge_occupations(wages: DataFrame, projections: DataFrame, education: DataFrame) -> DataFrame:
    """Full outer merge of the three cleaned tables by occupation code."""
    return fold_join([wages, projections, education], ["OCC_CODE"], "full_outer").drop(*UNUSED)


@dataclass(frozen=True)
class Criteria:
    """Promising occupations: upper levels are inclusive."""

    education: int = 5
    experience: int = 2
    training: int = 3
    training_label: str = "Apprenticeship"
    hourly_median: float = 20
    annual_openings: float = 150
    growth: float = 0


def promising_occupations(occupations: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """Occupations that meet all criteria, with their ordinals.

    A factor column holds the position of the label; an unlisted label is NULL
    and fails its criterion.
    """
    ranked = occupations.withColumns(
        {
            "ED_REQ_LEVEL": ordinal(F.col("ED_REQ"), EDUCATION_LEVELS),
            "EXP_REQ_LEVEL": ordinal(F.col("EXP_REQ"), EXPERIENCE_LEVELS),
            "TRN_REQ_LEVEL": ordinal(F.col("TRN_REQ"), TRAINING_LEVELS),
        }
    )
    return ranked.where(
        (F.col("ED_REQ_LEVEL") <= criteria.education)
        & (F.col("EXP_REQ_LEVEL") <= criteria.experience)
        & ((F.col("TRN_REQ_LEVEL") <= criteria.training) | (F.col("TRN_REQ") == criteria.training_label))
        & (F.col("H_MEDIAN") >= criteria.hourly_median)
        & (F.col("avg_annualopenings") >= criteria.annual_openings)
        & (F.col("percchange_2030") > criteria.growth)
    )


def with_factor_labels(promising: DataFrame) -> DataFrame:
    """The label columns in place of the ordinals, under the published names."""
    labels = {"ED_REQ.FACTOR": "ED_REQ", "EXP_REQ.FACTOR": "EXP_REQ", "TRN_REQ.FACTOR": "TRN_REQ"}
    kept = promising.drop("ED_REQ_LEVEL", "EXP_REQ_LEVEL", "TRN_REQ_LEVEL")
    return kept.select("*", *[F.col(source).alias(name) for name, source in labels.items()])


def report_table(promising: DataFrame, percent_digits: int = 1) -> DataFrame:
    """The report: wages and growth as text, openings rounded."""
    return (
        promising.select(*REPORT_NAMES)
        .withColumnsRenamed(REPORT_NAMES)
        .withColumns(
            {
                "Growth_2030": percent_text(F.col("Growth_2030"), percent_digits),
                "Med_Wage": dollar_text(F.col("Med_Wage")),
                "Openings": F.round("Openings", 2),
            }
        )
    )


def area_ranks(projections: DataFrame, limit: int = 40) -> DataFrame:
    """Occupations with an average openings rank of at most ``limit`` in their area."""
    detailed = projections.where(~is_group_code(F.col("OCC_CODE")))
    return top_by_rank(detailed, ["area"], "total_openings", "openings_rank", limit)


def area_rank_matrix(ranks: DataFrame, areas: list[str] | None = None) -> DataFrame:
    """One row per occupation, one rank column per area; areas are read from the ranks unless given."""
    return to_wide(ranks, ["OCC_CODE", "OCC_TITLEAZ"], "area", "openings_rank", areas)
