"""The result tables on the stand-in persons, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators import joins
from surveyloom.operators.measures import mean, median, total
from surveyloom.plans import codebooks, occupations, population, vintages
from surveyloom.queries import sqlgen, standin
from surveyloom.queries.operators import Query, rounded

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The stand-in has codes of its own, so its crosswalk is one of its own too.
CROSSWALK = {"1503LA": "1504LA", "1506ME": "1507ME"}
VINTAGE = replace(vintages.VINTAGE_2020, crosswalk=CROSSWALK)


def query(sql: str):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return register


# -- occupation tables from the given tables -----------------------------------

_DASHED = "'15-' || lpad(substr(p_brand, 7), 2, '0') || substr(p_type, 1, 2)"
_BY_CODE = (
    f"SELECT {_DASHED} AS code, max(p_brand || ' ' || p_type) AS title, count(*) AS parts, "
    "max(p_size) AS size, CAST(max(p_partkey) AS BIGINT) AS last FROM part GROUP BY 1"
)


def _by_code(spark, sf_dir) -> DataFrame:
    return standin.from_part(spark, sf_dir, _BY_CODE)


def _wages(spark, sf_dir) -> DataFrame:
    """A wage table as text, with null codes, top-codes and commas."""
    last = F.col("last")
    hourly = F.when(last % 11 == 0, "#").when(last % 13 == 0, "*").otherwise(F.format_number(12 + last % 30, 2))
    annual = F.when(last % 11 == 0, "#").when(last % 17 == 0, "**").otherwise(F.format_number(30000 + 10 * last, 0))
    names = occupations.HOURLY_WAGES + occupations.ANNUAL_WAGES
    return _by_code(spark, sf_dir).where("last % 19 <> 0").select(
        *[F.lit("x").alias(c) for c in ("NAICS", "NAICS_TITLE", "I_GROUP", "OWN_CODE")],
        F.col("code").alias("OCC_CODE"),
        F.col("title").alias("OCC_TITLE"),
        F.lit("detailed").alias("O_GROUP"),
        F.format_number(1000 * F.col("parts"), 0).alias("TOT_EMP"),
        F.lit("1.0").alias("PCT_TOTAL"),
        F.lit("2.0").alias("PCT_RPT"),
        *[(hourly if c.startswith("H_") else annual).alias(c) for c in names],
    )


def _projections(spark, sf_dir) -> DataFrame:
    return _by_code(spark, sf_dir).where("last % 23 <> 0").select(
        F.lit("State").alias("Area Name"),
        F.col("code").alias("SOC Code2"),
        F.col("title").alias("Occupation Title"),
        (F.col("last") % 400 * 10.0).alias("total_openings"),
        ((F.col("last") % 9 - 2) / 100.0).alias("percchange_2030"),
    )


def _education(spark, sf_dir) -> DataFrame:
    last = F.col("last")

    def pick(levels, k: int):
        return F.get(F.array(*[F.lit(x) for x in levels], F.lit("Unlisted"), F.lit(None)), (F.floor(last / k) % (len(levels) + 2)).cast("int"))

    names = list(occupations.EDUCATION_NAMES)
    return _by_code(spark, sf_dir).select(
        F.col("code").alias(names[0]),
        F.col("title").alias(names[1]),
        pick(occupations.EDUCATION_LEVELS, 1).alias(names[2]),
        pick(occupations.EXPERIENCE_LEVELS, 2).alias(names[3]),
        pick(occupations.TRAINING_LEVELS, 3).alias(names[4]),
    )


def _merged(spark, sf_dir) -> DataFrame:
    return occupations.merge_occupations(
        occupations.clean_wages(_wages(spark, sf_dir)),
        occupations.clean_projections(_projections(spark, sf_dir), "state"),
        occupations.clean_education(_education(spark, sf_dir)),
    )


def _levels_sql(levels, k: int) -> str:
    texts = ", ".join("'" + x.replace("'", "''") + "'" for x in levels)
    return f"([{texts}, 'Unlisted', NULL])[CAST((last // {k}) % {len(levels) + 2} AS INT) + 1]"


_MERGED_COLUMNS = (
    "OCC_CODE, OCC_TITLE, TOT_EMP, "
    + ", ".join([*occupations.HOURLY_WAGES, *occupations.ANNUAL_WAGES])
    + ", total_openings, percchange_2030, avg_annualopenings, OCC_TITLE21, ED_REQ, EXP_REQ, TRN_REQ"
)
_MERGED = (
    f"p AS ({_BY_CODE}), merged AS (SELECT code AS OCC_CODE, CASE WHEN last % 19 <> 0 THEN title END AS OCC_TITLE, "
    "CASE WHEN last % 19 <> 0 THEN 1000.0::DOUBLE * parts END AS TOT_EMP, "
    + ", ".join(
        f"CASE WHEN last % 19 = 0 THEN NULL WHEN last % 11 = 0 THEN 101::DOUBLE WHEN last % 13 = 0 THEN NULL ELSE (12 + last % 30)::DOUBLE END AS {c}"
        for c in occupations.HOURLY_WAGES
    )
    + ", "
    + ", ".join(
        f"CASE WHEN last % 19 = 0 THEN NULL WHEN last % 11 = 0 THEN 209000::DOUBLE WHEN last % 17 = 0 THEN NULL ELSE (30000 + 10 * last)::DOUBLE END AS {c}"
        for c in occupations.ANNUAL_WAGES
    )
    + ", CASE WHEN last % 23 <> 0 THEN (last % 400 * 10)::DOUBLE END AS total_openings, "
    "CASE WHEN last % 23 <> 0 THEN (last % 9 - 2) / 100.0::DOUBLE END AS percchange_2030, "
    "CASE WHEN last % 23 <> 0 THEN (last % 400)::DOUBLE END AS avg_annualopenings, title AS OCC_TITLE21, "
    f"{_levels_sql(occupations.EDUCATION_LEVELS, 1)} AS ED_REQ, {_levels_sql(occupations.EXPERIENCE_LEVELS, 2)} AS EXP_REQ, "
    f"{_levels_sql(occupations.TRAINING_LEVELS, 3)} AS TRN_REQ FROM p)"
)
_PROMISING = (
    "promising AS (SELECT * FROM merged WHERE ED_REQ IN ('No formal educational credential', 'High school diploma or equivalent', "
    "'Some college, no degree', 'Postsecondary nondegree award', 'Associate''s degree') AND EXP_REQ IN ('None', 'Less than 5 years') "
    "AND TRN_REQ IN ('None', 'Short-term on-the-job training', 'Moderate-term on-the-job training', 'Apprenticeship') "
    "AND H_MEDIAN >= 20 AND avg_annualopenings >= 50 AND percchange_2030 > 0)"
)
_CRITERIA = occupations.Criteria(annual_openings=50)


@query(f"WITH {_MERGED} SELECT {_MERGED_COLUMNS} FROM merged")
def occupations_merged(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(
    f"WITH {_MERGED}, {_PROMISING} SELECT {_MERGED_COLUMNS}, ED_REQ AS \"ED_REQ.FACTOR\", EXP_REQ AS \"EXP_REQ.FACTOR\", "
    "TRN_REQ AS \"TRN_REQ.FACTOR\" FROM promising"
)
def occupations_promising(spark, sf_dir):
    return occupations.with_factor_labels(occupations.promising_occupations(_merged(spark, sf_dir), _CRITERIA))


@query(
    f"WITH {_MERGED}, {_PROMISING} SELECT OCC_TITLE AS Occupation, '$' || format('{{:,.2f}}', H_MEDIAN) AS Med_Wage, "
    "format('{:.1f}', percchange_2030 * 100) || '%' AS Growth_2030, avg_annualopenings AS Openings, ED_REQ AS Education, "
    "EXP_REQ AS Experience FROM promising"
)
def occupations_report(spark, sf_dir):
    return occupations.report_table(occupations.promising_occupations(_merged(spark, sf_dir), _CRITERIA))


# -- persons -----------------------------------------------------------------------


@query(
    f"WITH {sqlgen.cte_persons()} SELECT code AS SOCP, OCC_TITLE, n, income, wage, weighted FROM (SELECT CASE WHEN SOCP10 IS NULL THEN NULL WHEN SOCP10 = 'N.A.//' "
    "THEN SOCP12 ELSE SOCP10 END AS code, count(*) AS n, round(max(PINCP * ADJINC * 1.09257667) + 1e-6, 4) AS income, "
    "round(round(sum(6 * q * WAGP * ADJINC * 1.09257667), 0) + 1e-6, 4) AS weighted, "
    f"round(max(WAGP * ADJINC * 1.09257667) + 1e-6, 4) AS wage FROM base GROUP BY 1) LEFT JOIN ({standin.TITLES}) ON code = SOCCODE18"
)
def persons_2015(spark, sf_dir):
    """The 2015 vintage: merged code, title by the merged code, 2020 dollars."""
    titles = standin.titles(spark, sf_dir).withColumnRenamed("SOCCODE18", "SOCCODE10")
    data = standin.persons(spark, sf_dir).drop("SOCP")
    people = vintages.prepare_persons(data, vintages.VINTAGE_2015)
    by_code = people.groupBy("SOCP").agg(
        F.count("*").alias("n"), F.max("PINCP").alias("income"), F.max("PERNP").alias("wage"), F.round(F.sum(F.col(standin.BASE) * F.col("PERNP")), 0).alias("weighted")
    )
    return rounded(joins.add_title(by_code, titles, "SOCP", "SOCCODE10"))


def _tables(spark, sf_dir) -> population.SurveyTables:
    titles = standin.titles(spark, sf_dir)
    return population.SurveyTables(
        persons=vintages.prepare_persons(standin.persons(spark, sf_dir), VINTAGE),
        weight=standin.BASE,
        replicates=standin.REPLICATES,
        count=80,
        titles=titles,
        promising=standin.promising(spark, sf_dir),
    )


_FT = "WORKINGAGE = 1 AND FTEMP = 1"
_START = f"WITH {sqlgen.cte_persons()}, {sqlgen.cte_flags()}, titles AS ({standin.TITLES}), codes AS ({standin.PROMISING})"
_KEY = ["SOCP"]
_INCOME = [total("EMPCNT"), mean("MN_INC", "PINCP"), median("MED_INC", "PINCP"), median("MED_WG", "PERNP")]
_INCOME_COLUMNS = [c for m in _INCOME for c in (m.name, f"{m.name}_se")]
_CONDITIONS = {
    "all": "TRUE",
    "female": "SEX = 2",
    "mom": "MOM = 1",
    "mom young children": "MOMYC = 1",
    "single mom": "SMOM = 1",
    "single mom young children": "SMOMYC = 1",
    "all less bach": "LESSBACH = 1",
    "female less bach": "LESSBACH = 1 AND SEX = 2",
    "mom less bach": "LESSBACH = 1 AND MOM = 1",
    "mom young children lb": "LESSBACH = 1 AND MOMYC = 1",
    "single mom lb": "LESSBACH = 1 AND SMOM = 1",
    "single mom young children lb": "LESSBACH = 1 AND SMOMYC = 1",
}


def _titled_sql(sub: str) -> str:
    return f"(SELECT e.*, OCC_TITLE FROM {sub} e LEFT JOIN titles ON SOCP = SOCCODE18)"


def _ctes_lists(measures) -> str:
    parts = []
    for i, cond in enumerate(_CONDITIONS.values()):
        sub = _titled_sql(sqlgen.estimate("persons", _KEY, measures, f"{_FT} AND {cond}"))
        parts.append(f"list{i} AS MATERIALIZED (SELECT * FROM {sub} ORDER BY EMPCNT DESC NULLS LAST, SOCP NULLS LAST LIMIT 50)")
    return ", ".join(parts)


_LISTS = _ctes_lists(_INCOME)
# The list of codes needs the counts only.
_CODES = (
    _ctes_lists([total("EMPCNT")])
    + ", alltop AS MATERIALIZED (SELECT DISTINCT SOCP FROM ("
    + " UNION ALL ".join(f"SELECT SOCP FROM list{i}" for i in range(12))
    + ")), listed AS (SELECT * FROM persons p WHERE EXISTS (SELECT 1 FROM alltop a WHERE a.SOCP IS NOT DISTINCT FROM p.SOCP))"
)


def _names(names: dict[str, str], count: str | None = None, strict: bool = False):
    return [*([total(count)] if count else []), *[total(n, c, strict) for n, c in names.items()]]


def _pairs(measures) -> list[str]:
    return [c for m in measures for c in (m.name, f"{m.name}_se")]


def _join_sql(first: str, sides: dict[str, tuple[str, list[str]]], first_columns: list[str]) -> str:
    """Null-safe left joins on code and title with suffixed columns."""
    cols, joins = ["f.SOCP", "f.OCC_TITLE", *[f"f.{c}" for c in first_columns]], ""
    for i, (sfx, (sub, names)) in enumerate(sides.items()):
        cols += [f"s{i}.{c} AS {c}{sfx}" for c in names]
        joins += f" LEFT JOIN {sub} s{i} ON f.SOCP IS NOT DISTINCT FROM s{i}.SOCP AND f.OCC_TITLE IS NOT DISTINCT FROM s{i}.OCC_TITLE"
    return f"SELECT {', '.join(cols)} FROM {first} f{joins}"


def _shares_sql(sub: str, shares: dict[str, str], whole: str) -> str:
    cols = ", ".join(f"round({c} / NULLIF({whole}, 0) + 1e-6, 4) AS {p}" for p, c in shares.items())
    return f"(SELECT *, {cols} FROM {sub})"


def _long_sql(measures, where: str) -> str:
    return (
        f"SELECT name, value FROM (SELECT * FROM {sqlgen.estimate('persons', [], measures, where)}) "
        f"UNPIVOT (value FOR name IN ({', '.join(_pairs(measures))}))"
    )


@query(
    _START
    + " "
    + " UNION ALL ".join(
        [
            _long_sql(_names(population.TOTALS_WORKING_AGE, "WAPOPCNT"), "WORKINGAGE = 1"),
            _long_sql(_names(population.TOTALS_FULL_TIME, "WAFTCNT"), _FT),
            _long_sql(_names(population.TOTALS_IN_SCHOOL, "WASCHLCNT"), f"{_FT} AND SCH >= 2"),
        ]
    )
)
def table_population(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).population_table())


@query(
    f"{_START}, {_LISTS} "
    + " UNION ALL ".join(f"SELECT '{label}' AS category, * FROM list{i}" for i, label in enumerate(_CONDITIONS))
)
def table_top_lists(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).top_lists())


@query(
    f"{_START}, {_LISTS} "
    + _join_sql(
        "list0",
        {population.SUFFIXES[x]: (f"list{i}", _INCOME_COLUMNS) for i, x in enumerate(_CONDITIONS) if i},
        _INCOME_COLUMNS,
    )
)
def table_top_lists_wide(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).top_lists_wide())


_EDUCATION = _names(population.TOTALS_EDUCATION, "TOTCNT")


@query(
    f"{_START} SELECT *, "
    + ", ".join(f"round({c} / sum({c}) OVER () + 1e-6, 4) AS {p}" for p, c in population.SHARES_EDUCATION.items())
    + f" FROM {sqlgen.estimate('persons', ['EDATT_RC'], _EDUCATION, _FT)}"
)
def table_education(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).education_table())


_SPLIT = {"FTCNT": "FTEMP", "PTCNT": "PTEMP"}
_SPLIT_SHARES = {"pFT": "FTCNT", "pPT": "PTCNT"}


def _split_sql(where: str, strict: bool) -> tuple[str, list[str]]:
    measures = _names(_SPLIT, "TOTCNT", strict)
    sub = _titled_sql(sqlgen.estimate("listed", _KEY, measures, where))
    return _shares_sql(sub, _SPLIT_SHARES, "TOTCNT"), [*_pairs(measures), *_SPLIT_SHARES]


_ALL_SPLIT = _split_sql("ESR = 1 AND WORKINGAGE = 1", False)


@query(
    f"{_START}, {_CODES} "
    + _join_sql(_ALL_SPLIT[0], {"_fem": _split_sql("ESR = 1 AND WORKINGAGE = 1 AND SEX = 2", True)}, _ALL_SPLIT[1])
)
def table_full_part_time(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).full_part_time())


def _income_sql(source: str, where: str) -> tuple[str, list[str]]:
    return _titled_sql(sqlgen.estimate(source, _KEY, _INCOME, where)), _INCOME_COLUMNS


_WOMEN = _names({n: c for n, c in population.TOTALS_ALL.items() if n not in ("FTCNT", "PTCNT")}, "TOTCNT")


@query(
    f"{_START}, {_CODES} "
    + _join_sql(
        _shares_sql(_titled_sql(sqlgen.estimate("listed", _KEY, _WOMEN, _FT)), population.SHARES_WOMEN, "TOTCNT"),
        {f"_{c.lower()}": _income_sql("listed", f"{_FT} AND {c} = 1") for c in ("MOM", "MOMYC", "SMOMYC")},
        [*_pairs(_WOMEN), *population.SHARES_WOMEN],
    )
)
def table_women(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).women_table())


def _sex_sql(where: str) -> str:
    measures = [*_names({"FEMCNT": "FEM", "MALCNT": "MAL"}, "EMPCNT", strict=True), *_INCOME[1:]]
    shares = {"pFEM": "FEMCNT", "pMAL": "MALCNT"}
    first = _shares_sql(_titled_sql(sqlgen.estimate("listed", _KEY, measures, where)), shares, "EMPCNT")
    sides = {"_fem": _income_sql("listed", f"{where} AND SEX = 2"), "_ml": _income_sql("listed", f"{where} AND SEX = 1")}
    return f"{_START}, {_CODES} " + _join_sql(first, sides, [*_pairs(measures), *shares])


@query(_sex_sql(_FT))
def table_sex_income(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).sex_income())


@query(_sex_sql(f"{_FT} AND LESSBACH = 1"))
def table_sex_income_less_bachelor(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).sex_income(less_bachelor=True))


_ALL = _names(population.TOTALS_ALL, "TOTCNT")
_PROMISED = "promised AS (SELECT * FROM persons WHERE SOCP IN (SELECT SOCCODE18 FROM codes))"
_PROMISING_TABLE = _join_sql(
    _shares_sql(_titled_sql(sqlgen.estimate("promised", _KEY, _ALL)), population.SHARES_ALL, "TOTCNT"),
    {
        "_ft": (
            _shares_sql(_titled_sql(sqlgen.estimate("promised", _KEY, [*_ALL, *_INCOME[2:]], _FT)), population.SHARES_ALL, "TOTCNT"),
            [*_pairs([*_ALL, *_INCOME[2:]]), *population.SHARES_ALL],
        ),
        "_femft": _income_sql("promised", f"{_FT} AND SEX = 2"),
        "_mlft": _income_sql("promised", f"{_FT} AND SEX = 1"),
    },
    [*_pairs(_ALL), *population.SHARES_ALL],
)


@query(f"{_START}, {_PROMISED} {_PROMISING_TABLE}")
def table_promising(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).promising_table())


_MAPPED_SQL = (
    "mapped AS (SELECT *, CASE OCC_CODE "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CROSSWALK.items())
    + " ELSE OCC_CODE END AS survey FROM (SELECT * REPLACE (replace(OCC_CODE, '-', '') AS OCC_CODE) FROM promising))"
)


@query(
    f"{_START}, {_MERGED}, {_PROMISING}, {_MAPPED_SQL}, "
    "promised AS (SELECT * FROM persons WHERE SOCP IN (SELECT survey FROM mapped)), "
    f"pt AS ({_PROMISING_TABLE}) SELECT coalesce(pt.SOCP, survey) AS SOCP, pt.OCC_TITLE AS title_survey, mapped.OCC_TITLE AS title_data, "
    "OCC_CODE, TOTCNT, TOTCNT_se, MED_INC_ft, MED_INC_ft IS NULL AS no_median, MN_INC_mlft, H_MEDIAN, avg_annualopenings FROM pt FULL JOIN mapped ON pt.SOCP = survey"
)
def table_promising_data(spark, sf_dir):
    promising = occupations.promising_occupations(_merged(spark, sf_dir), _CRITERIA)
    codes = vintages.promising_codes(promising, VINTAGE)
    tables = replace(_tables(spark, sf_dir), promising=codes)
    out = tables.promising_with_data(vintages.promising_data(promising, codes))
    return rounded(
        out.select(
            "SOCP",
            F.col("`OCC_TITLE.x`").alias("title_survey"),
            F.col("`OCC_TITLE.y`").alias("title_data"),
            *"OCC_CODE TOTCNT TOTCNT_se MED_INC_ft".split(),
            F.col("MED_INC_ft").isNull().alias("no_median"),
            *"MN_INC_mlft H_MEDIAN avg_annualopenings".split(),
        )
    )


# -- the 2015 vintage ----------------------------------------------------------------

# Code merged from two columns, 2020 dollars; promising persons are found by the census code.
_BASE_2015 = (
    "base15 AS (SELECT * REPLACE (CASE WHEN SOCP10 IS NULL THEN NULL WHEN SOCP10 = 'N.A.//' THEN SOCP12 ELSE SOCP10 END AS SOCP, "
    "ADJINC * 1.09257667 AS ADJINC) FROM base)"
)
_CENSUS_2015 = "SELECT SOCCODE18 AS SOCCODE10, CASE WHEN SOCCODE18 LIKE '%LA' THEN SOCCODE18 ELSE 'X' || SOCCODE18 END AS SOCCODE10_CENSUS FROM codes"
_START_2015 = (
    f"WITH {sqlgen.cte_persons()}, {_BASE_2015}, {sqlgen.cte_flags('base15')}, titles AS ({standin.TITLES}), "
    f"codes AS ({standin.PROMISING}), census AS ({_CENSUS_2015}), promised AS (SELECT * FROM persons WHERE SOCP IN (SELECT SOCCODE10_CENSUS FROM census))"
)


def _tables_2015(spark, sf_dir) -> population.SurveyTables:
    census = F.when(F.col("SOCCODE18").endswith("LA"), F.col("SOCCODE18")).otherwise(F.concat(F.lit("X"), F.col("SOCCODE18")))
    promising = standin.promising(spark, sf_dir).select(F.col("SOCCODE18").alias("SOCCODE10"), census.alias("SOCCODE10_CENSUS"))
    return population.SurveyTables(
        persons=vintages.prepare_persons(standin.persons(spark, sf_dir), vintages.VINTAGE_2015),
        weight=standin.BASE,
        replicates=standin.REPLICATES,
        count=80,
        titles=standin.titles(spark, sf_dir).withColumnRenamed("SOCCODE18", "SOCCODE10"),
        promising=promising,
        code="SOCCODE10",
        promising_code="SOCCODE10_CENSUS",
    )


@query(
    f"{_START_2015}, {_LISTS} "
    + " UNION ALL ".join(f"SELECT '{label}' AS category, * FROM list{i}" for i, label in enumerate(_CONDITIONS))
)
def table_2015_top_lists(spark, sf_dir):
    return rounded(_tables_2015(spark, sf_dir).top_lists())


@query(f"{_START_2015} {_PROMISING_TABLE}")
def table_2015_promising(spark, sf_dir):
    return rounded(_tables_2015(spark, sf_dir).promising_table())


@query(f"{_START_2015} SELECT DISTINCT SOCCODE10_CENSUS FROM census WHERE SOCCODE10_CENSUS NOT IN (SELECT SOCP FROM persons WHERE SOCP IS NOT NULL)")
def missing_promising_2015(spark, sf_dir):
    """Promising census codes without any person."""
    return _tables_2015(spark, sf_dir).missing_promising()


# -- linearised tables -------------------------------------------------------------


def _linear_tables(spark, sf_dir) -> population.LinearTables:
    people = codebooks.add_indicators(standin.harmonised(spark, sf_dir).where("YEAR = 2020"), codebooks.HARMONISED)
    return population.LinearTables(people, standin.titles(spark, sf_dir), standin.promising(spark, sf_dir))


def _cte_harmonised() -> str:
    cols = ", ".join(f"{sql} AS {name}" for name, sql in standin.HARMONISED_PERSON.items())

    def flag(cond: str) -> str:
        return f"CASE WHEN {cond} THEN 1 WHEN NOT ({cond}) THEN 0 END"

    ft = "(EMPSTAT = 1 AND UHRSWORK >= 35 AND WKSWORK2 >= 4)"
    flags = {
        "WORKINGAGE": "AGE >= 18 AND AGE < 65",
        "FTEMP": ft,
        "PTEMP": f"EMPSTAT = 1 AND UHRSWORK >= 3 AND WKSWORK2 >= 2 AND NOT {ft}",
        "FEM": "SEX = 2",
        "MAL": "SEX = 1",
        "MOM": "NCHILD >= 1 AND SEX = 2",
        "MOMYC": "NCHLT5 >= 1 AND SEX = 2",
        "SMOM": "NCHILD >= 1 AND SEX = 2 AND MARST >= 3",
        "SMOMYC": "NCHLT5 >= 1 AND SEX = 2 AND MARST >= 3",
        "LESSBACH": "EDUCD <= 100",
        "BACHMORE": "EDUCD <> 999 AND EDUCD >= 101",
    }
    tier = (
        "CASE WHEN EDUCD = 999 THEN 'Missing' WHEN EDUCD >= 101 THEN 'Bach or more' WHEN EDUCD >= 90 THEN 'Some college' WHEN EDUCD >= 81 "
        "THEN 'Associate' WHEN EDUCD >= 65 THEN 'Some college' WHEN EDUCD >= 62 THEN 'HS or GED' ELSE 'Less than HS' END AS EDATT_RC"
    )
    made = ", ".join(f"{flag(c)} AS {n}" for n, c in flags.items())
    return (
        f"raw AS (SELECT {cols} FROM lineitem JOIN part ON l_partkey = p_partkey), "
        f"persons AS MATERIALIZED (SELECT *, OCCSOC AS SOCP, {made}, {tier} FROM raw WHERE YEAR = 2020), "
        f"titles AS ({standin.TITLES}), codes AS ({standin.PROMISING})"
    )


_LINEAR = f"WITH {_cte_harmonised()}"
_LINEAR_INCOME = [total("EMPCNT"), mean("MN_INC", "INCTOT", strict=True)]


def _linear_list(cond: str) -> str:
    return f"(SELECT * FROM {_titled_sql(sqlgen.linear('persons', _KEY, _LINEAR_INCOME, 'PERWT', f'{_FT} AND {cond}'))} ORDER BY EMPCNT DESC, SOCP NULLS LAST LIMIT 50)"


_LINEAR_LISTS = " UNION ALL ".join(f"SELECT '{x}' AS category, * FROM {_linear_list(c)}" for x, c in _CONDITIONS.items())


@query(f"{_LINEAR} SELECT * RENAME (SOCP AS OCCSOC) FROM ({_LINEAR_LISTS})")
def table_linear_top_lists(spark, sf_dir):
    return rounded(_linear_tables(spark, sf_dir).top_lists())


_LINEAR_EDUCATION = _names(population.TOTALS_EDUCATION, "TOTCNT", strict=True)


@query(
    f"{_LINEAR} SELECT *, "
    + ", ".join(f"round({c} / sum({c}) OVER () + 1e-6, 4) AS {p}" for p, c in population.SHARES_EDUCATION.items())
    + f" FROM {sqlgen.linear('persons', ['EDATT_RC'], _LINEAR_EDUCATION, 'PERWT', _FT)}"
)
def table_linear_education(spark, sf_dir):
    return rounded(_linear_tables(spark, sf_dir).education_table())


def _linear_split(where: str) -> tuple[str, list[str]]:
    measures = _names(_SPLIT, "TOTCNT", strict=True)
    sub = _titled_sql(sqlgen.linear("listed", _KEY, measures, "PERWT", where))
    return _shares_sql(sub, _SPLIT_SHARES, "TOTCNT"), [*_pairs(measures), *_SPLIT_SHARES]


_LINEAR_ALL = _linear_split("EMPSTAT = 1 AND WORKINGAGE = 1")


@query(
    f"{_LINEAR}, alltop AS MATERIALIZED (SELECT DISTINCT SOCP FROM ({_LINEAR_LISTS})), "
    "listed AS MATERIALIZED (SELECT * FROM persons p WHERE EXISTS (SELECT 1 FROM alltop a WHERE a.SOCP IS NOT DISTINCT FROM p.SOCP)) "
    "SELECT * RENAME (SOCP AS OCCSOC) FROM ("
    + _join_sql(_LINEAR_ALL[0], {"_fem": _linear_split("EMPSTAT = 1 AND WORKINGAGE = 1 AND SEX = 2")}, _LINEAR_ALL[1])
    + ")"
)
def table_linear_full_part_time(spark, sf_dir):
    return rounded(_linear_tables(spark, sf_dir).full_part_time())


def _linear_promising(names: dict[str, str], where: str, extra) -> tuple[str, list[str]]:
    measures = [*_names(names, "TOTCNT", strict=True), *extra]
    shares = {p: c for p, c in population.SHARES_ALL.items() if c in names}
    sub = _titled_sql(sqlgen.linear("promised", _KEY, measures, "PERWT", where))
    return _shares_sql(sub, shares, "TOTCNT"), [*_pairs(measures), *shares]


_LINEAR_EVERYONE = _linear_promising({n: c for n, c in population.TOTALS_ALL.items() if n != "MALCNT"}, "TRUE", [])
_LINEAR_FULL = _linear_promising(
    {n: c for n, c in population.TOTALS_ALL.items() if n not in ("MALCNT", "FTCNT", "PTCNT")}, _FT, _LINEAR_INCOME[1:]
)


@query(
    f"{_LINEAR}, promised AS MATERIALIZED (SELECT * FROM persons WHERE SOCP IN (SELECT SOCCODE18 FROM codes)) SELECT * RENAME (SOCP AS OCCSOC) FROM ("
    + _join_sql(_LINEAR_EVERYONE[0], {"_ft": _LINEAR_FULL}, _LINEAR_EVERYONE[1])
    + ")"
)
def table_linear_promising(spark, sf_dir):
    return rounded(_linear_tables(spark, sf_dir).promising_table())
