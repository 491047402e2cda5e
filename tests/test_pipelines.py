"""From small written files to every named result table."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import types as T

from surveyloom.plans import pipelines, vintages
from surveyloom.plans.occupations import Criteria
from surveyloom.sources import schemas

NUMBERS = ["TOT_EMP", "PCT_TOTAL", "PCT_RPT", *schemas.HOURLY_WAGES, *schemas.ANNUAL_WAGES]
REPLICATES = 4


def csv(path, header, rows):
    def cell(x):
        x = "" if x is None else str(x)
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x

    path.write_text("\n".join(",".join(map(cell, r)) for r in [header, *rows]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def occupation_tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("occupations")
    text = "NAICS NAICS_TITLE I_GROUP OWN_CODE OCC_CODE OCC_TITLE O_GROUP".split()

    def wage(code, title, hourly):
        return ["", "", "", "", code, title, "", "1,234", "*", "**", *[hourly] * 6, *["#"] * 6]

    projections = [f.name for f in schemas.PROJECTIONS.fields]
    files = {
        "wages": csv(folder / "w.csv", [*text, *NUMBERS, "more"], [
            [*wage("11-1011", 'Managers "all", other', "45.5"), "x"], [*wage("15-1231", "Technicians", "30"), "x"], [*wage("47-2140", "Painters", "12"), "x"],
        ]),
        "projections_state": csv(folder / "s.csv", projections, [["State", "11-1011", "Managers", 5000, 0.1], ["State", "15-1231", "Tech", 4000, 0.2], ["State", "99-9999", "Only here", 10, 0.1]]),
        "projections_county": csv(folder / "c.csv", projections, [
            ["Pima", "11-1011", "Managers", 500, 0.1], ["Pima", "15-1231", "Tech", 400, 0.1], ["Pima", "15-0000", "Group", 9000, 0.1], ["A new county", "15-1231", "Tech", 7, 0.1],
        ]),
        "education": csv(folder / "e.csv", [f.name for f in schemas.EDUCATION.fields], [
            ["11-1011", "Managers", "Associate's degree", "None", "None"], ["15-1231", "Tech", "High school diploma or equivalent", "None", "Apprenticeship"],
        ]),
    }
    out = folder / "out"
    return pipelines.build_occupations(spark, files, str(out), Criteria()), out


def test_occupation_files_to_tables(occupation_tables):
    tables, out = occupation_tables
    assert set(os.listdir(out)) == set(tables) == {"az_occdata_may21", "azcty_proj_sept21", "az_promising_occupations21", "occupation_rank_top40openings"}
    merged = {r.OCC_CODE: r for r in tables["az_occdata_may21"].collect()}
    assert set(merged) == {"11-1011", "15-1231", "47-2140", "99-9999"}
    assert merged["11-1011"].OCC_TITLE == 'Managers "all", other' and merged["11-1011"].TOT_EMP == 1234 and merged["11-1011"].A_MEDIAN == 209000
    assert {r.OCC_CODE for r in tables["az_promising_occupations21"].collect()} == {"11-1011", "15-1231"}
    ranks = {r.OCC_CODE: r for r in tables["occupation_rank_top40openings"].collect()}
    assert set(tables["occupation_rank_top40openings"].columns) == {"OCC_CODE", "OCC_TITLEAZ", "Pima", "A new county"}
    assert ranks["15-1231"]["Pima"] == 2.0 and ranks["15-1231"]["A new county"] == 1.0 and ranks["11-1011"]["A new county"] is None
    assert tables["azcty_proj_sept21"].count() == 4


def microdata_schema(ids):
    names = "AGEP SEX ESR WKHP WKW PAOC MAR SCHL SCH".split()
    weights = ["PWGTP", *schemas.weight_columns("PWGTP", REPLICATES)]
    fields = [T.StructField(n, T.StringType()) for n in ids] + [T.StructField(n, T.IntegerType()) for n in names]
    return T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in ("PINCP", "WAGP", "ADJINC", *weights)])


def people(schema, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        r = {
            "AGEP": rng.randint(14, 70), "SEX": rng.randint(1, 2), "ESR": rng.choice([1, 1, 1, 3, 6]), "WKHP": rng.choice([20, 40, "bb"]), "WKW": rng.choice([1, 3, 6]),
            "PAOC": rng.choice([1, 2, 3, 4, "b"]), "MAR": rng.randint(1, 5), "SCHL": rng.randint(1, 24), "SCH": rng.randint(1, 3), "PINCP": rng.randint(0, 90) * 1000, "WAGP": rng.randint(0, 90) * 1000, "ADJINC": 1.0,
        }
        code = rng.choice(["111011", "151230", "472140"])
        r |= {"SERIALNO": i, "SOCP": code, "SOCP10": rng.choice([code, "N.A.//"]), "SOCP12": code}
        r |= {w: rng.randint(1, 9) for w in schema.names if w.startswith("PWGTP")}
        rows.append([rng.choice(["04", "04", "05"]), *[r[n] for n in schema.names]])
    return rows


def test_extract_is_partitioned_by_year_and_pruned(spark, tmp_path):
    schema = microdata_schema(["SERIALNO", "SOCP"])
    out, rows = str(tmp_path / "extract"), {}
    for year in (2015, 2020):
        rows[year] = people(schema, year)
        path = csv(tmp_path / f"{year}.csv", ["ST", *schema.names], rows[year])
        got = pipelines.extract_microdata(spark, path, schema, out, "04", year)
        n = got.count()
        assert n == sum(r[0] == "04" for r in rows[year])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    again = pipelines.extract_microdata(spark, path, schema, out, "04", 2020)
    assert again.count() == n and sorted(os.listdir(out))[-2:] == ["year=2015", "year=2020"]
    assert again.where("WKHP is null").count() == sum(r[0] == "04" and r[1 + schema.names.index("WKHP")] == "bb" for r in rows[2020])


@pytest.mark.parametrize("year", [2020, 2015])
def test_survey_files_to_tables(spark, tmp_path, occupation_tables, year):
    vintage = vintages.VINTAGE_2020 if year == 2020 else vintages.VINTAGE_2015
    schema = microdata_schema(["SERIALNO", *(["SOCP"] if year == 2020 else ["SOCP10", "SOCP12"])])
    rows = people(schema, 7)
    path = csv(tmp_path / "p.csv", ["ST", *schema.names], rows)
    persons = pipelines.extract_microdata(spark, path, schema, str(tmp_path / "x"), "04", year)
    promising, codes = occupation_tables[0]["az_promising_occupations21"], None
    if year == 2020:
        titles = spark.createDataFrame([("111011", "Managers"), ("151230", "Technicians")], "SOCCODE18 string, OCC_TITLE string")
    else:
        lookup = spark.createDataFrame(
            [("1", "111011", "11-1011", "Managers"), ("2", "151150", "15-1150", "Technicians")],
            "Census_OccCode_2010 string, SOCCODE10_CENSUS string, SOCCODE10 string, OCC_TITLE string",
        )
        codes = vintages.codes_2010(lookup, spark.createDataFrame([("47-2140", "Painters")], "SOCCODE10 string, OCC_TITLE string"))
        titles = vintages.titles_2010(codes)
    tables = pipelines.build_survey_tables(persons, vintage, titles, promising, str(tmp_path / "out"), codes, REPLICATES)
    names = {pipelines.table_name(k, year) for k in pipelines.SURVEY_TABLES}
    assert set(tables) == set(os.listdir(tmp_path / "out")) == names and len(names) == 10
    inside = [dict(zip(["ST", *schema.names], r)) for r in rows if r[0] == "04"]
    working = [r for r in inside if 18 <= r["AGEP"] <= 64]
    totals = {r.name: r.value for r in tables["pums20_poptab" if year == 2020 else "pums15_poptab"].collect()}
    assert totals["WAPOPCNT"] == sum(r["PWGTP"] for r in working)
    lists = tables[pipelines.table_name("top_lists_long", year)].collect()
    code = {"04": lambda r: r["SOCP"] if year == 2020 else (r["SOCP12"] if r["SOCP10"] == "N.A.//" else r["SOCP10"])}["04"]
    full = [r for r in working if r["ESR"] == 1 and r["WKHP"] != "bb" and r["WKHP"] >= 35 and r["WKW"] <= 3]
    for r in lists:
        if r.category == "overall":
            assert r.EMPCNT == sum(p["PWGTP"] for p in full if code(p) == r.SOCP)
    promising_found = {r.SOCP for r in tables[pipelines.table_name("promising_table", year)].collect()}
    assert promising_found <= {"111011", "151230"} and promising_found
