"""Fixed records as a data source, bucketed extracts, wide tables of any width."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom import LinearDesign, mean, total
from surveyloom.operators import joins, reshape
from surveyloom.sources import readers, records, writers

LAYOUT = {"id": (1, 6, T.LongType()), "name": (7, 5, T.StringType()), "x": (12, 6, T.DoubleType()), "n": (18, 11, T.IntegerType())}
LINES = [
    "     1  a b   1.5          7",
    "    +2       -.25 2147483648",
    "     3  é   1e2  -2147483648",
    "   4.0 zz      NaN        ab",
    "      zz   7.      000000003",
]


def fixed(line: str) -> bytes:
    return line.encode().ljust(28)[:28] + b"\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.dat").write_bytes(b"".join(fixed(x) for x in LINES[:2]))
    (tmp_path / "in" / "deep" / "b.dat").write_bytes(b"".join(fixed(x) for x in LINES[2:]) * 3)
    (tmp_path / "in" / "empty.dat").write_bytes(b"")
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"not a record")
    return str(tmp_path / "in")


def test_records_against_a_plain_cut(spark, folder):
    kinds = {"id": int, "name": str, "x": float, "n": int}

    def value(line: bytes, name: str):
        first, width, _ = LAYOUT[name]
        text = line[first - 1 : first - 1 + width].decode().strip(" ")
        try:
            got = kinds[name](text) if text and text != "NaN" else None
        except ValueError:
            return None
        return got if name != "n" or got is None or -(2**31) <= got < 2**31 else None

    want = [tuple(value(fixed(x), c) for c in LAYOUT) for x in LINES[:2] + LINES[2:] * 3]
    key = lambda row: [(v is None, v or 0) if not isinstance(v, str) else (False, v) for v in (row[0], row[2], row[3])]
    got = [tuple(r) for r in records.read_records(spark, folder, LAYOUT, 29).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert [r.n for r in records.read_records(spark, f"file:{folder}/a.dat", LAYOUT, 29, ["n"]).collect()] == [7, None]


@pytest.mark.parametrize(
    "where", ["n = 7", "id > 1 AND x < 200", "name IN ('zz', 'é')", "n IS NULL", "n IS NOT NULL AND id <= 3", "NOT (id = 1)", "x >= 1.5 OR id = 2", "n <=> NULL"]
)
def test_pushed_filters_change_no_result(spark, folder, where):
    df = records.read_records(spark, folder, LAYOUT, 29)
    plain = spark.createDataFrame(df.collect(), df.schema)
    assert sorted(map(str, df.where(where).collect())) == sorted(map(str, plain.where(where).collect()))


def test_records_push_filters_and_split_files(spark, folder, monkeypatch):
    plan = records.read_records(spark, folder, LAYOUT, 29, ["id", "n"]).where("id > 1 AND n = 7")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter isnotnull" not in plan
    monkeypatch.setattr(records, "RANGE_BYTES", 60)
    df = records.read_records(spark, folder, LAYOUT, 29)
    assert df.rdd.getNumPartitions() == 6 and df.count() == 11


def test_odd_records(spark, tmp_path, folder):
    (tmp_path / "cut.dat").write_bytes(b"x" * 30)
    with pytest.raises(Exception, match="not whole records"):
        records.read_records(spark, str(tmp_path / "cut.dat"), LAYOUT, 29).collect()
    with pytest.raises(ValueError, match="does not lie"):
        records.read_records(spark, folder, LAYOUT, 20)
    with pytest.raises(ValueError, match="date"):
        records.read_records(spark, folder, {"d": (1, 8, T.DateType())}, 29)
    (tmp_path / "none").mkdir()
    assert records.read_records(spark, str(tmp_path / "none"), LAYOUT, 29).collect() == []


def test_records_and_lines_agree(spark, folder):
    ascii_only = {c: LAYOUT[c] for c in ("id", "n")}
    lines = readers.read_fixed_width(spark, f"{folder}/a.dat", ascii_only)
    assert lines.collect() == records.read_records(spark, f"{folder}/a.dat", ascii_only, 29).collect()


def test_bucketed_extract_groups_without_an_exchange(spark, tmp_path):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("SOCP"),
        (F.col("id") % 2).alias("w"),
        (2019 + F.col("id") % 3).cast("int").alias("year"),
    )
    path = str(tmp_path / "extract")
    written = writers.write_bucketed(rows, path, "SOCP", 4, ["year"], files_per_bucket=2)
    again = writers.open_bucketed(spark, path, rows.schema, "SOCP", 4, ["year"])
    want = sorted(map(str, rows.where("year > 2019").groupBy("SOCP").agg(F.sum("w"), F.count("*")).collect()))
    for df in (written, again):
        sums = df.where("year > 2019").groupBy("SOCP").agg(F.sum("w"), F.count("*"))
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "year" in plan.split("PartitionFilters")[1].split("]")[0]
        assert sorted(map(str, sums.collect())) == want
        assert set(df.columns) == {"SOCP", "w", "year"} and df.count() == 4000
    # A semi join with a list that is bucketed alike needs none either.
    codes = writers.write_bucketed(rows.select("SOCP").distinct(), str(tmp_path / "codes"), "SOCP", 4)
    met = written.hint("merge").join(codes, "SOCP", "left_semi")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == rows.where("SOCP IS NOT NULL").count()


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 400_000, 1, 8).select(F.lit("hot").alias("_b"), F.xxhash64("id").alias("v"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "512k")
    try:
        written = writers.write_bucketed(rows, str(tmp_path / "extract"), "_b", 4)
    finally:
        spark.conf.unset(size)
    # About 3 MB of shuffled numbers: one task would sort them all if pieces were counted in advance.
    assert len(written.inputFiles()) >= 4 and written.columns == ["_b", "v"]
    sums = written.groupBy("_b").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sums.collect() == rows.groupBy("_b").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()


def test_pivot_beyond_the_limit_of_levels(spark):
    n = 12_000
    df = spark.range(3 * n).select((F.col("id") % 3).alias("k"), F.concat(F.lit("a"), F.floor(F.col("id") / 3)).alias("area"), F.col("id").alias("v"))
    wide = reshape.to_wide(df.where("v <> 5"), ["k"], "area", "v")
    assert len(wide.columns) == n + 1 and wide.columns[1:] == sorted(f"a{i}" for i in range(n))
    got = {r["k"]: r for r in wide.collect()}
    assert all(got[k][f"a{i}"] == (None if 3 * i + k == 5 else 3 * i + k) for k in range(3) for i in range(0, n, 7))
    odd = reshape.to_wide(spark.createDataFrame([("a", None, 1.0), ("a", 2, 3.0)], "k string, area int, v double"), ["k"], "area", "v")
    assert odd.select("k", "null", "`2`").collect() == [("a", 1.0, 3.0)]


def test_a_list_meets_collapsed_rows_only(spark):
    rows = [(None if i % 9 == 0 else f"c{i % 5}", float(i % 7), 1.0 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "code string, x double, w double")
    codes = spark.createDataFrame([("c1",), ("c3",), ("c3",), (None,), ("zz",)], "listed string")
    measures, domains = [total("X", "x"), mean("M", "x")], {"all": None, "heavy": F.col("w") > 1}
    got = LinearDesign(df, "w").estimate(["code"], measures, domains=domains, among=(codes, "code", "listed"))
    want = LinearDesign(joins.in_list(df, codes, "code", "listed"), "w").estimate(["code"], measures, domains=domains)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join LeftSemi") :].split("Relation")[0].split("LogicalRDD")[0]
    with pytest.raises(ValueError, match="not a grouping column"):
        LinearDesign(df, "w").estimate(["x"], measures, among=(codes, "code", "listed"))
