from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import cleaning, money, recode
from surveyloom.plans import codebooks, occupations, vintages
from surveyloom.sources.schemas import WAGES


def column(spark, values, expr, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr(F.col("v"))).collect()]


def test_null_codes(spark):
    values = ["b", "bbbbbbbb", "bbbbbbbbb", "", "NA", "12", None, "cab"]
    assert column(spark, values, cleaning.null_microdata_codes) == [None, None, "bbbbbbbbb", None, None, "12", None, "cab"]
    assert column(spark, ["*", "**", "***", None], lambda c: cleaning.null_if_any(c, cleaning.WAGE_NULL_CODES)) == [None, None, "***", None]


def test_parse_number(spark):
    values = ["1,234", "$ 12.50 an hour", "-3%", "none", None, "5.", ".5"]
    assert column(spark, values, cleaning.parse_number) == [1234.0, 12.5, -3.0, None, None, 5.0, 0.5]


def test_remove_first_mark_only(spark):
    assert column(spark, ["11-1011", "a-b-c", "none", None], cleaning.remove_first) == ["111011", "ab-c", "none", None]


def test_null_code_is_no_group(spark):
    assert column(spark, ["11-0000", "11-1011", None], lambda c: ~cleaning.is_group_code(c)) == [False, True, True]


def test_across_and_range(spark):
    df = spark.createDataFrame([("a", "x", "x", 1)], "k string, p string, q string, n int")
    assert cleaning.column_range(df, "p", "n") == ["p", "q", "n"]
    out = cleaning.across(df, lambda c: F.nullif(c, F.lit("x")), ["p", "q", "n"], only_strings=True)
    assert out.first() == ("a", None, None, 1)


def test_indicator_keeps_null_and_first_match_does_not(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert [r[0] for r in df.select(recode.indicator(F.col("v") == 1)).collect()] == [1, 0, None]
    tier = recode.first_match([(F.col("v") == 2, "two"), (F.col("v") >= 1, "some")], "none")
    assert [r[0] for r in df.select(tier).collect()] == ["some", "two", "none"]


def test_ordinal_and_map(spark):
    assert column(spark, ["None", "5 years or more", "x", None], lambda c: recode.ordinal(c, occupations.EXPERIENCE_LEVELS)) == [1, 3, None, None]
    assert column(spark, ["1", "9", None], lambda c: recode.map_values(c, {"1": "all"})) == ["all", "9", None]


def test_sentinel(spark):
    df = spark.createDataFrame([("N.A.//", "b"), (None, "b"), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(recode.sentinel_fallback(F.col("x"), "N.A.//", F.col("y"))).collect()] == ["b", None, "a"]


def test_money(spark):
    assert column(spark, [1234.5, -2.0, None], money.dollar_text, "v double") == ["$1,234.50", "-$2.00", None]
    assert column(spark, [0.125, None], money.percent_text, "v double") == ["12.5%", None]
    assert column(spark, [2.0], lambda c: money.share(c, F.lit(0)), "v double") == [None]


def wages(spark, rows):
    base = dict.fromkeys(WAGES.fieldNames(), "1")
    return spark.createDataFrame([tuple({**base, **r}[c] for c in WAGES.fieldNames()) for r in rows], WAGES)


def test_clean_wages(spark):
    rows = [
        {"OCC_CODE": "11-1011", "H_MEAN": "#", "A_MEAN": "#", "TOT_EMP": "1,234"},
        {"OCC_CODE": None, "H_MEAN": "*", "A_MEAN": "55000", "TOT_EMP": "**"},
    ]
    out = occupations.clean_wages(wages(spark, rows)).select("OCC_CODE", "H_MEAN", "A_MEAN", "TOT_EMP").collect()
    assert [tuple(r) for r in out] == [("11-1011", 101.0, 209000.0, 1234.0), (None, None, 55000.0, None)]


def test_merge_matches_null_codes(spark):
    projections = spark.createDataFrame(
        [("AZ", None, "x", 10.0, 0.1), ("AZ", "22-2", "y", 20.0, 0.1)],
        "`Area Name` string, `SOC Code2` string, `Occupation Title` string, total_openings double, percchange_2030 double",
    )
    education = spark.createDataFrame([("33-3", "t", "e", "x", "r")], [*occupations.EDUCATION_NAMES])
    merged = occupations.merge_occupations(
        occupations.clean_wages(wages(spark, [{"OCC_CODE": None}])),
        occupations.clean_projections(projections, "state"),
        occupations.clean_education(education),
    )
    got = {r.OCC_CODE: (r.TOT_EMP, r.avg_annualopenings, r.ED_REQ) for r in merged.collect()}
    assert got == {None: (1.0, 1.0, None), "22-2": (None, 2.0, None), "33-3": (None, None, "e")}
    assert not set(occupations.UNUSED) & set(merged.columns)


def test_promising_filter(spark):
    cols = "OCC_CODE string, ED_REQ string, EXP_REQ string, TRN_REQ string, H_MEDIAN double, avg_annualopenings double, percchange_2030 double"
    ok = ("a", "Associate's degree", "Less than 5 years", "Apprenticeship", 20.0, 150.0, 0.01)
    rows = [ok]
    for i, bad in enumerate(["Bachelor's degree", "5 years or more", "Long-term on-the-job training", 19.99, 149.0, 0.0], 1):
        rows.append((f"bad{i}", *ok[1:i], bad, *ok[i + 1 :]))
        rows.append((f"null{i}", *ok[1:i], None, *ok[i + 1 :]))
    out = occupations.promising_occupations(spark.createDataFrame(rows, cols))
    assert [r.OCC_CODE for r in out.collect()] == ["a"]
    assert occupations.with_factor_labels(out).first()["TRN_REQ.FACTOR"] == "Apprenticeship"


PERSON = "id int, AGEP int, ESR int, WKHP int, WKW int, SEX int, PAOC int, MAR int, SCHL int"


def test_census_indicators(spark):
    rows = [
        (1, 17, 1, 40, 1, 1, None, 1, 16),
        (2, 18, 1, 35, 3, 2, None, 2, None),
        (3, 64, 1, 34, 5, 2, 3, 2, 20),
        (4, 65, 1, 40, None, 2, 2, 1, 21),
    ]
    got = {r.id: r for r in codebooks.add_indicators(spark.createDataFrame(rows, PERSON), codebooks.CENSUS).collect()}
    assert [got[i].WORKINGAGE for i in (1, 2, 3, 4)] == [0, 1, 1, 0]
    assert [got[i].FTEMP for i in (1, 2, 3, 4)] == [1, 1, 0, None]
    assert [got[i].PTEMP for i in (1, 2, 3, 4)] == [0, 0, 1, None]
    assert [got[i].MOM for i in (1, 2, 3, 4)] == [0, None, 1, 1]
    assert [got[i].MOMYC for i in (1, 2, 3, 4)] == [0, None, 1, 0]
    assert [got[i].SMOM for i in (1, 2, 3, 4)] == [0, None, 1, 0]
    assert [got[i].EDATT_RC for i in (1, 2, 3, 4)] == ["HS or GED", "Less than HS", "Associate", "Bach or more"]
    assert [got[i].LESSBACH for i in (1, 2, 3, 4)] == [1, None, 1, 0]


def test_vintage_2015(spark):
    rows = [(1, "N.A.//", "472140", 100.0, 50.0, 2.0), (2, None, "x", None, 50.0, 2.0), (3, "111011", "N.A.//", 1.0, 1.0, 1.0)]
    cols = "id int, SOCP10 string, SOCP12 string, PINCP double, WAGP double, ADJINC double"
    data = spark.createDataFrame(rows, cols).selectExpr(
        "*", *[f"CAST(NULL AS INT) AS {c}" for c in "AGEP ESR WKHP WKW SEX PAOC MAR SCHL".split()]
    )
    lookup = spark.createDataFrame(
        [("2", "c", "11-1011", "second"), ("1", "b", "11-1011", "first")],
        "Census_OccCode_2010 string, SOCCODE10_CENSUS string, SOCCODE10 string, OCC_TITLE string",
    )
    missing = spark.createDataFrame([("47-2140", "added")], "SOCCODE10 string, OCC_TITLE string")
    codes = vintages.codes_2010(lookup, missing)
    titles = vintages.titles_2010(codes)
    got = {r.id: r for r in vintages.prepare_persons(data, vintages.VINTAGE_2015, titles).collect()}
    assert [(got[i].SOCP, got[i].OCC_TITLE) for i in (1, 2, 3)] == [("472140", "added"), (None, None), ("111011", "first")]
    assert got[1].PERNP == 50.0 * 2.0 * vintages.DOLLARS_2015_TO_2020
    from dataclasses import replace

    literal = replace(vintages.VINTAGE_2015, wage_without_adjustment=True)
    assert {r.id: r.PERNP for r in vintages.prepare_persons(data, literal, titles).collect()}[1] == 50.0 * vintages.DOLLARS_2015_TO_2020


def test_crosswalks(spark):
    assert len(vintages.CROSSWALK_2018) == 26 and len(vintages.CROSSWALK_2010) == 35
    promising = spark.createDataFrame([("15-1231", "t"), ("11-1011", "u")], "OCC_CODE string, OCC_TITLE string")
    codes = vintages.promising_codes(promising, vintages.VINTAGE_2020)
    assert {r.OCC_CODE: r.SOCCODE18 for r in codes.collect()} == {"151231": "151230", "111011": "111011"}
    census = spark.createDataFrame([("151150", "c1"), ("151150", "c2")], "SOCCODE10 string, SOCCODE10_CENSUS string")
    fanned = vintages.promising_codes(promising, vintages.VINTAGE_2015, census)
    assert sorted((r.OCC_CODE, r.SOCCODE10_CENSUS) for r in fanned.where("OCC_CODE = '151231'").collect()) == [("151231", "c1"), ("151231", "c2")]
