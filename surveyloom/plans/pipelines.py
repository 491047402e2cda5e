"""From source files to named result tables: occupations, microdata extracts, survey tables.

Each function reads delimited files by header name, writes its results as tables
below one folder, and returns them as read back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.plans import occupations, vintages
from surveyloom.plans.population import SurveyTables
from surveyloom.sources import readers, schemas, writers

# Names of the result tables of the 2020 vintage.
SURVEY_TABLES = {
    "population_table": "pums20_poptab",
    "sex_income": "sex_medinc_top_jobs",
    "sex_income_less_bachelor": "sex_medinc_top_jobsLB",
    "top_lists_long": "top_women_jobs_long",
    "top_lists_wide": "top_women_jobs_wide",
    "women_table": "top_women_jobs_wide_v2",
    "education_table": "ed_attainment_women",
    "full_part_time": "ftptsplit_top_jobs",
    "promising_table": "promising_occupations_tab",
    "promising_with_data": "PUMSBLS_promising_occupations_tab",
}
# Those of the 2015 vintage that do not only end in 2015.
SURVEY_TABLES_2015 = {"population_table": "pums15_poptab", "women_table": "top_women_jobs_wide_v2_2015"}


def table_name(key: str, year: int) -> str:
    if year == 2020:
        return SURVEY_TABLES[key]
    return SURVEY_TABLES_2015.get(key, f"{SURVEY_TABLES[key]}{year}")


def build_occupations(
    spark: SparkSession,
    files: Mapping[str, str],
    out: str,
    criteria: occupations.Criteria = occupations.Criteria(),
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Merged occupations, county projections, promising occupations, and the rank matrix of areas.

    ``files`` names the files ``wages, projections_state, projections_county, education``.
    """
    wages = occupations.clean_wages(readers.read_table(spark, files["wages"], schemas.WAGES))
    state, county = (
        occupations.clean_projections(readers.read_table(spark, files[f"projections_{x}"], schemas.PROJECTIONS), x_name)
        for x, x_name in (("state", "state"), ("county", "area"))
    )
    education = occupations.clean_education(readers.read_table(spark, files["education"], schemas.EDUCATION))
    merged = occupations.merge_occupations(wages, state, education)
    done = writers.write_tables({"az_occdata_may21": merged, "azcty_proj_sept21": county}, out, fmt)
    promising = occupations.promising_occupations(done["az_occdata_may21"], criteria)
    matrix = occupations.area_rank_matrix(occupations.area_ranks(done["azcty_proj_sept21"]))
    return done | writers.write_tables(
        {"az_promising_occupations21": occupations.with_factor_labels(promising), "occupation_rank_top40openings": matrix}, out, fmt
    )


def extract_microdata(spark: SparkSession, path: str, schema: T.StructType, out: str, state: str, year: int, fmt: str = "csv") -> DataFrame:
    """Named columns of one state's persons, added as one year of a table that is partitioned by year.

    Running it again replaces that year only. A filter on ``year`` reads that year's files only.
    """
    persons = readers.read_microdata(spark, path, schema, fmt, where=F.col("ST") == state)
    target = f"{out}/year={year}"
    persons.write.mode("overwrite").parquet(target)
    full = T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])
    return spark.read.schema(full).option("basePath", out).parquet(out).where(F.col("year") == year)


def build_survey_tables(
    persons: DataFrame,
    vintage: vintages.Vintage,
    titles: DataFrame,
    promising: DataFrame,
    out: str,
    codes: DataFrame | None = None,
    replicates: int = 80,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """All result tables of one vintage under their names.

    ``promising`` is the written table of promising occupations. ``codes`` (2010 code
    lists) brings the census codes by which the 2015 tables find promising persons.
    """
    mapped = vintages.promising_codes(promising.select("OCC_CODE", "OCC_TITLE"), vintage, codes)
    tables = SurveyTables(
        persons=vintages.prepare_persons(persons, vintage),
        weight="PWGTP",
        replicates=schemas.weight_columns("PWGTP", replicates),
        titles=titles,
        promising=mapped,
        code=vintage.code,
        promising_code=None if codes is None else "SOCCODE10_CENSUS",
    )
    data = vintages.promising_data(promising, mapped)
    results = {table_name(k, vintage.year): df for k, df in tables.all_tables(data).items() if k in SURVEY_TABLES}
    return writers.write_tables(results, out, fmt)
