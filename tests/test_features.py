"""Type inference, ranks of replicate weights, bitmap counts, joins with hot keys, published tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom import ReplicateDesign, median
from surveyloom.operators import distinct, gram, joins, quantile
from surveyloom.sources import readers, staging, writers


def report(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    r = readers.type_report(df).first()
    return (r.type, r.text_example) if r else None


def test_types_need_every_value(spark):
    assert report(spark, ["1", "-2", None, "NA", ""]) == ("int", None)
    assert report(spark, ["1", "2147483648"]) == ("bigint", None)
    assert report(spark, ["1", "9223372036854775808"]) == ("double", None)
    assert report(spark, ["1", "2.5", "-.5", "1e3"]) == ("double", None)
    assert report(spark, ["007", "8"]) == ("string", "007")
    assert report(spark, ["2020-02-29"]) == ("date", None)
    assert report(spark, ["2020-02-29", "2021-02-29"]) == ("string", "2021-02-29")
    assert report(spark, ["2020-02-29", "12"]) == ("string", "2020-02-29")
    assert report(spark, ["1,000", "NaN", "5"]) == ("string", "1,000")
    assert report(spark, [None, "NA"]) == ("string", None)
    assert report(spark, []) is None


def test_types_are_judged_without_sorting_the_values(spark):
    texts = ["a\U0001f600", "a\ufffd", "z", "2020-01-01", "", "NA", None, "1", "1.5", "-0", "99999999999"]
    df = spark.createDataFrame([(t, "x" + (t or ""), None, "7") for t in texts], "`a.b` string, text string, nothing string, n string").repartition(3)
    df = df.withColumn("bytes", F.concat(F.unhex(F.lit("ff")), F.col("text").cast("binary")).cast("string"))
    report = readers.type_report(df)
    # Sorting by column name would hold all values of a task in memory.
    plan = report._jdf.queryExecution().executedPlan().toString()
    values = plan[plan.index("MapInArrow") :]
    assert "Sort" not in values and "Expand" not in values
    got = {r["column"]: tuple(r)[1:] for r in report.collect()}
    assert got["a.b"] == ("string", 8, 3, 2, 3, 4, 1, "a\ufffd")
    assert got["text"] == ("string", 11, 0, 0, 0, 0, 0, "x") and got["nothing"] == ("string", 0, 11, 0, 0, 0, 0, None)
    assert got["n"] == ("int", 11, 0, 11, 11, 11, 0, None) and got["bytes"][:2] == ("string", 11)


def test_inferred_files_widen_on_a_late_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,n.rows,note\n011,1,\n012,2,NA\n")
    (tmp_path / "b.csv").write_text("code,n.rows,note\n013,2.5,\n")
    df, found = readers.read_inferred(spark, str(tmp_path))
    assert df.dtypes == [("code", "string"), ("n.rows", "double"), ("note", "string")]
    assert sorted(tuple(r) for r in df.collect()) == [("011", 1.0, None), ("012", 2.0, None), ("013", 2.5, None)]
    assert {r["column"]: r["type"] for r in found.collect()} == dict(df.dtypes)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("code,n\n")
    df, found = readers.read_inferred(spark, str(tmp_path / "empty"))
    assert df.dtypes == [("code", "string"), ("n", "string")] and df.count() == 0 and found.count() == 0


@pytest.mark.parametrize("rank", [1, 4, 12])
def test_rank_of_weights(spark, rank):
    rng = np.random.default_rng(rank)
    rows = rng.random((500, rank)) @ rng.random((rank, 12)) * rng.choice([1.0, 1e6], (500, 1))
    df = spark.createDataFrame([([float(x) for x in r],) for r in rows], "x array<double>").repartition(5)
    assert gram.row_rank(df, F.col("x"), 12) == rank == np.linalg.matrix_rank(rows)
    got = {(r.i, r.j): r.g for r in gram.gram_matrix(df, F.col("x"), 12).collect()}
    want = rows.T @ rows
    assert len(got) == 78 and all(got[i, j] == pytest.approx(want[i - 1, j - 1]) for i, j in got)


def test_rank_of_odd_weights(spark):
    df = spark.createDataFrame([([1.0, None, 2.0],), (None,), ([0.0, 0.0, 0.0],)], "x array<double>")
    assert gram.row_rank(df, F.col("x"), 3) == 1
    assert gram.row_rank(df.limit(0), F.col("x"), 3) == 0


def test_weights_go_to_the_gram_matrix_as_they_are(spark):
    df = spark.createDataFrame([([1.0, None, 2.0],), (None,), ([3.0, 0.0, float("nan")],)], "x array<double>").repartition(2)
    plan = gram.gram_matrix(df, F.col("x"), 3)._jdf.queryExecution().optimizedPlan().toString()
    # A filter on the array would compute it a second time, below the exchange.
    assert "transform" not in plan and "Filter" not in plan
    got = {(r.i, r.j): str(r.g) for r in gram.gram_matrix(df, F.col("x"), 3).collect()}
    assert got == {(1, 1): "10.0", (1, 2): "0.0", (1, 3): "nan", (2, 2): "0.0", (2, 3): "nan", (3, 3): "nan"}


def test_histogram_of_medians_is_not_shuffled_again(spark, monkeypatch):
    df = spark.range(0, 20_000, 1, 4).select((F.col("id") % 5).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("x"), F.lit(1.0).alias("w"))
    plans = {}

    def seen(frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return staging.stage(frame, name)

    monkeypatch.setattr(quantile, "stage", seen)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "60k")
    try:
        got = ReplicateDesign(df, "w", ["w"]).medians(["g"], [median("m", "x")]).collect()
    finally:
        spark.conf.unset(limit)
    # The bucket that holds each median is a small table; only this one moves.
    assert "BroadcastHashJoin" in plans["buckets"] and "SortMergeJoin" not in plans["buckets"]
    want = df.groupBy("g").agg(F.sort_array(F.collect_list("x"))[1999].alias("m")).collect()
    assert sorted(got) == sorted(want)


def test_fewer_degrees_widen_the_limits(spark):
    rows = [(i % 2, float(i % 41), 1.0 + i % 3, [1.0 + (i * (1 + r % 2)) % 5 for r in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, x double, w double, reps array<double>")
    by_count = ReplicateDesign(df, "w", "reps", count=6)._independent_replicates()
    by_rank = ReplicateDesign(df, "w", "reps", count=6, degrees="rank")
    # Only two different columns of weights.
    assert by_count == 6 and by_rank._independent_replicates() == 2
    assert len(by_rank.estimate(["g"], [median("M", "x")]).collect()) == 2
    with pytest.raises(ValueError):
        ReplicateDesign(df, "w", "reps", count=6, degrees="other")


def test_distinct_codes_of_many_partitions(spark):
    n = 100_000
    df = spark.range(n).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), F.concat(F.lit("c"), F.col("id") % 40_009).alias("code")).repartition(8)
    df = df.unionAll(spark.sql("SELECT 100L, NULL, CAST(NULL AS STRING)"))
    got = {(r.level, r.a, r.b): r.n_codes for r in distinct.distinct_rollup(df, {"ab": ["a", "b"], "b": ["b"], "all": []}, "code").collect()}
    want = {("ab", r.a, r.b): r.n for r in df.groupBy("a", "b").agg(F.count_distinct("code").alias("n")).collect()}
    want |= {("b", None, r.b): r.n for r in df.groupBy("b").agg(F.count_distinct("code").alias("n")).collect()}
    assert got == want | {("all", None, None): 40_009} and got["ab", 100, None] == 0


def test_no_distinct_codes(spark):
    df = spark.createDataFrame([], "a int, code string")
    assert [tuple(r) for r in distinct.distinct_rollup(df, {"a": ["a"], "all": []}, "code").collect()] == [("all", None, 0)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_equals_plain_join(spark, how):
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise((F.col("id") % 500).cast("string"))
    left = spark.range(6000).select(key.alias("k"), "id")
    right = spark.createDataFrame([(None, 1), ("hot", 2), ("hot", 3), ("5", 4), ("unused", 5)], "k string, v int")
    got = joins.hot_join(left, right, ["k"], how)
    want = joins.join_on(left, right, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        joins.hot_join(left, right, ["k"], "full")


def test_hot_keys_are_spread(spark):
    """A key with a third of the rows: the longest task has at most three times the median rows."""
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 9000).cast("string")).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    assert len(joins.hot_keys(left, ["k"], 0.01)) == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.hot_join(left, right, ["k"], "left", pieces=256)
        rows = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(rows) == 60_000 and len(rows) == 8 and max(rows) <= 3 * sorted(rows)[4]


def test_no_hot_keys(spark):
    left = spark.createDataFrame([], "k string, x int")
    assert joins.hot_keys(left, ["k"], 0.5) == [] and joins.hot_join(left, left, ["k"], "inner").count() == 0


def test_published_tables_appear_together(spark, tmp_path):
    folder = str(tmp_path / "out")
    a = spark.range(10).withColumn("x", F.col("id") * 0.5)
    manifest = writers.publish_tables({"a": a, "b": a.limit(0)}, folder, {"a": {"x": F.col("x")}})
    assert {r["name"]: (r["rows"], r["sums"]) for r in manifest.collect()} == {"a": (10, {"x": 22.5}), "b": (0, {})}
    broken = a.withColumn("x", F.raise_error(F.lit("sink fails")).cast("double"))
    with pytest.raises(Exception, match="sink fails"):
        writers.publish_tables({"a": a.limit(3), "b": broken}, folder)
    seen = writers.read_published(spark, folder)
    assert set(seen) == {"a", "b"} and seen["a"].count() == 10 and seen["b"].count() == 0
    writers.publish_tables({"a": a.limit(4)}, folder)
    assert {n: df.count() for n, df in writers.read_published(spark, folder).items()} == {"a": 4}
