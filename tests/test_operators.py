from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import joins, ranking, reshape
from surveyloom.plans.occupations import area_rank_matrix, area_ranks
from surveyloom.sources import readers, writers
from surveyloom.sources.schemas import OCCUPATIONS_2018


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_null_safe_joins(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, v int")
    full = joins.join_on(a, b, ["k"], "full_outer")
    assert full.columns == ["k", "v.x", "v.y"]
    assert rows(full) == rows(spark.createDataFrame([("x", 1, None), (None, 2, 3), ("y", None, 4)], "k string, a int, b int"))
    assert rows(joins.in_list(a, b, "k", "k")) == [(None, 2)]
    assert rows(joins.missing_from(a, b, "k", "k")) == [("x",)]
    assert "NestedLoop" not in full._jdf.queryExecution().toString()


def test_suffix_and_fold(spark):
    a = spark.createDataFrame([("x", None, 1)], "k string, t string, v int")
    out = joins.fold_join([a, joins.suffix_columns(a, "_b", ["k", "t"])], ["k", "t"], "left")
    assert out.columns == ["k", "t", "v", "v_b"] and rows(out) == [("x", None, 1, 1)]


def test_average_rank_with_ties_and_null(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 9.0), ("a", None), ("b", -1.0), ("b", 0.0)], "g string, v double")
    got = rows(ranking.average_rank(df, ["g"], "v", "r"))
    assert got == rows(spark.createDataFrame([("a", 5.0, 2.5), ("a", 5.0, 2.5), ("a", 9.0, 1.0), ("a", None, None), ("b", -1.0, 2.0), ("b", 0.0, 1.0)], "g string, v double, r double"))


def test_average_rank_large_group_against_brute_force(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 613 - 100).cast("double").alias("v"))
    values = [r.v for r in df.collect()]
    want = {v: sum(x > v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}
    got = {r.v: r.r for r in ranking.average_rank(df, ["g"], "v", "r").distinct().collect()}
    assert got == want


def test_area_ranks_tie_at_the_limit(spark):
    data = [("p", f"c{i}", "t", float(100 - i)) for i in range(39)]
    data += [("p", "tie1", "t", 50.0), ("p", "tie2", "t", 50.0), ("p", None, "t", 60.0), ("p", "g-0000", "t", 1e9), ("p", "n", "t", None), ("q", "c1", "t", 1.0)]
    df = spark.createDataFrame(data, "area string, OCC_CODE string, OCC_TITLEAZ string, total_openings double")
    got = area_ranks(df)
    brute = [r for r in data if r[1] != "g-0000" and r[3] is not None]
    want = {
        (a, c): sum(y[3] > x and y[0] == a for y in brute) + (sum(y[3] == x and y[0] == a for y in brute) + 1) / 2 for a, c, _, x in brute
    }
    assert {(r.area, r.OCC_CODE): r.openings_rank for r in got.collect()} == {k: v for k, v in want.items() if v <= 40}
    wide = area_rank_matrix(got, ["p", "q"])
    assert {r.OCC_CODE: (r.p, r.q) for r in wide.collect()}["c1"] == (2.0, 1.0)


def test_top_n_orders_nulls_last(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), (None, 1.0), ("z", None), ("c", 2.0)], "k string, v double")
    assert [r.k for r in ranking.top_n(df, 3, "v", ["k"]).collect()] == ["c", "a", "b"]
    grouped = ranking.top_n(df.withColumn("g", F.coalesce("v", F.lit(1.0)) > 0), 3, "v", ["k"], ["g"])
    assert sorted(r.k for r in grouped.collect()) == ["a", "b", "c"]
    assert "WindowGroupLimit" in grouped._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_and_distinct(spark):
    df = spark.createDataFrame([("k", 2, None), ("k", 1, "x"), (None, 5, "y")], "k string, o int, v string")
    assert rows(ranking.first_per_key(df, ["k"], ["o"])) == rows(spark.createDataFrame([("k", 1, "x"), (None, 5, "y")], "k string, o int, v string"))
    assert df.agg(ranking.distinct_count("v")).first()[0] == 3


def test_shapes(spark):
    a = spark.createDataFrame([(1, 2.0)], "x int, y double")
    assert rows(reshape.to_long(a)) == [("x", 1.0), ("y", 2.0)]
    stacked = reshape.stack_labelled({"one": a, "two": a.drop("y")}, "src")
    assert rows(stacked) == [("one", 1, 2.0), ("two", 1, None)]
    shares = reshape.column_shares(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double"), {"p": "v"})
    assert rows(shares) == [("a", 1.0, 0.25), ("b", 3.0, 0.75)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("OCC_TITLE,extra,SOCCODE18\nManagers,1,111011\nNA,2,99XX\n")
    table = readers.read_folder(spark, str(tmp_path), {"codes": ("codes.csv", OCCUPATIONS_2018)})["codes"]
    assert rows(table) == [("111011", "Managers"), ("99XX", None)]
    assert readers.read_strings(spark, str(tmp_path / "codes.csv"), ["extra"]).schema[0].dataType.typeName() == "string"
    (tmp_path / "pums.csv").write_text("ST,SERIALNO,SCHL,PINCP,more\n04,1,bb,12.5,z\n04,2,16,bbbbbbb,z\n05,3,1,1,z\n")
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

    schema = StructType().add("SERIALNO", StringType()).add("SCHL", IntegerType()).add("PINCP", DoubleType())
    people = readers.read_microdata(spark, str(tmp_path / "pums.csv"), schema, where=F.col("ST") == "04")
    assert rows(people) == [("1", None, 12.5), ("2", 16, None)]
    back = writers.write_table(people, str(tmp_path / "out"), partition_by=["SCHL"])
    assert rows(back) == rows(people)
    assert rows(writers.write_table(people, str(tmp_path / "csv"), "csv")) == rows(people)
    (tmp_path / "fixed.txt").write_text("2020 045  12\n2019  1      \n")
    layout = {"YEAR": (1, 4, IntegerType()), "AGE": (6, 3, IntegerType()), "INC": (9, 4, DoubleType())}
    assert rows(readers.read_fixed_width(spark, str(tmp_path / "fixed.txt"), layout)) == rows(
        spark.createDataFrame([(2020, 45, 12.0), (2019, 1, None)], "a int, b int, c double")
    )
