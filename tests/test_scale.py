"""No cap on blocks, no vanishing levels, strict replicate counts, files that come back as written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from surveyloom import Block, LinearDesign, ReplicateDesign, mean, median, total
from surveyloom.operators import quantile, reshape
from surveyloom.operators.ranking import average_rank
from surveyloom.sources import readers, writers

R = 4
ROWS = [(i, i % 5, float(i % 7), 1.0 + i % 3, [1.0 + (i + r) % 4 for r in range(R)]) for i in range(300)]
SCHEMA = "id int, g int, x double, w double, reps array<double>"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_140_blocks_each_as_if_alone(spark, people):
    design = ReplicateDesign(people, "w", "reps", count=R)
    measures = [total("X", "x"), mean("M", "x"), median("MED", "x")]
    # Block b has the rows whose id leaves b when divided by 150; blocks above 149 have none.
    domains = {f"b{b}": F.col("id") % 150 == b for b in range(15, 155)}
    got = {}
    for r in design.estimate(["g"], measures[:2], domains=domains).collect():
        got[r.domain, r.g] = (r.X, r.M)
    want = {}
    for b in range(15, 155):
        for g in range(5):
            inside = [(x, w) for i, k, x, w, _ in ROWS if i % 150 == b and k == g]
            if inside:
                s = sum(x * w for x, w in inside)
                want[f"b{b}", g] = (s, s / sum(w for _, w in inside))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    few = {f"b{b}": F.col("id") % 70 == b for b in range(70)}
    medians = design.estimate(["g"], measures[2:], domains=few).collect()
    assert {r.domain for r in medians} == set(few)


def test_linear_domains_equal_single_estimates(spark, people):
    design = LinearDesign(people, "w")
    domains = {"all": None, "low": F.col("x") < 3, "none": F.col("x") > 100}
    got = {(r.domain, r.g): tuple(r)[2:] for r in design.estimate(["g"], [total("N"), mean("M", "x")], domains=domains).collect()}
    for label in ("all", "low"):
        alone = design.estimate(["g"], [total("N"), mean("M", "x")], where=domains[label]).collect()
        assert {(label, r.g): pytest.approx(tuple(r)[1:]) for r in alone} == {k: v for k, v in got.items() if k[0] == label}
    assert not [k for k in got if k[0] == "none"]


def test_array_weights_need_a_right_count(spark, people):
    with pytest.raises(ValueError):
        ReplicateDesign(people, "w", "reps")
    with pytest.raises(Exception, match="expected 5 replicate weights"):
        ReplicateDesign(people, "w", "reps", count=5).estimate(["g"], [total("N")]).collect()


def test_not_a_number_is_missing(spark):
    rows = [(1, 1.0), (2, float("nan")), (3, None), (4, 3.0)]
    df = spark.createDataFrame([(*r, 2.0, [1.0, 1.0]) for r in rows], "id int, x double, w double, reps array<double>").withColumn("g", F.lit(1))
    r = ReplicateDesign(df, "w", "reps", count=2).estimate(["g"], [mean("M", "x"), median("D", "x")]).first()
    assert r.M == 2.0 and r.D == 1.0
    assert LinearDesign(df, "w").estimate(["g"], [mean("M", "x")]).first().M == 2.0


def test_pivot_keeps_every_level(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "new area", 2.0), ("b", "p", 3.0)], "k string, area string, v double")
    assert set(reshape.to_wide(df, ["k"], "area", "v").columns) == {"k", "p", "new area"}
    with pytest.raises(Exception, match="new area is not a listed level"):
        reshape.to_wide(df, ["k"], "area", "v", ["p"]).collect()


def test_shares_need_no_join(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    shares = reshape.column_shares(df, {"p": "v"})
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert sorted(r.p for r in shares.collect()) == [0.25, 0.75]


def test_delimited_text_round_trip(spark, tmp_path):
    rows = [(1, 'Managers "all", other', "111011"), (2, "", None), (3, None, ""), (4, "two\nlines, one", 'a"b'), (5, "back\\slash", "\\")]
    df = spark.createDataFrame(rows, "id int, title string, code string")
    got = writers.write_table(df, str(tmp_path / "t"), "csv")
    assert sorted(tuple(r) for r in got.collect()) == rows
    (tmp_path / "x.csv").write_text('title,code\n"Managers ""all"", other",111011\n')
    assert [tuple(r) for r in readers.read_strings(spark, str(tmp_path / "x.csv")).collect()] == [('Managers "all", other', "111011")]


def test_image_keeps_the_order_of_doubles(spark):
    values = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.0, 1.0000000000000002, 1.9999999999999998, 2.0, 3.0, 1e300, 1.7976931348623157e308, float("inf")]
    values += [2.0**e for e in range(-1022, 1024, 31)] + [1000.0 + i / 1e9 for i in range(50)] + [x * 1.1**i for i, x in enumerate([7.3] * 200)]
    df = spark.createDataFrame([(v,) for x in values for v in (x, -x)], "x double").distinct()
    got = sorted((r.x, r.i) for r in df.select("x", quantile.image(F.col("x")).alias("i")).collect())
    images = [i for x, i in got]
    assert images == sorted(images) and len(set(images)) == len({x for x, _ in got})
    bits = {x: __import__("struct").unpack(">q", __import__("struct").pack(">d", x))[0] for x in values}
    assert all(i == bits[x] for x, i in got if x in bits and x >= 0)


def test_narrow_values_have_exact_medians_and_ranks_in_many_tasks(spark):
    """100,000 distinct values within one percent, most of them in one group."""
    n = 100_000
    x = 1000 + (F.col("id") * 7919 % n) / (n * 100)
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), x.alias("x"), (1 + F.col("id") % 3).cast("double").alias("w"))
    df = df.withColumn("reps", F.array("w", "w")).repartition(8)
    got = {r.g: r.md for r in ReplicateDesign(df, "w", "reps", count=2).medians(["g"], [median("md", "x")]).collect()}
    for g in "ab":
        rows = sorted((r.x, r.w) for r in df.where(F.col("g") == g).collect())
        whole, cum = sum(w for _, w in rows), 0.0
        assert got[g] == next(v for v, w in rows if (cum := cum + w) >= whole / 2)
    ranks = average_rank(df, ["g"], "x", "place")
    top = {g: sorted((r.x for r in df.where(F.col("g") == g).collect()), reverse=True) for g in "ab"}
    some = ranks.where("w = 2").collect()
    place = {(g, v): i for g in "ab" for i, v in enumerate(top[g], 1)}
    assert all(r.place == place[r.g, r.x] for r in some) and some


def test_persons_collapse_to_patterns(spark, people):
    """Rows after the only aggregation of persons do not grow with the persons, and are not spread before it."""
    flagged = people.withColumn("f", (F.col("id") % 2).cast("int"))
    design = ReplicateDesign(flagged.unionAll(flagged), "w", "reps", count=R)
    blocks = {"all": Block([total("N"), total("F", "f")]), "low": Block([total("F", "f")], F.col("x") < 3)}
    patterns = design._patterns(["g"], blocks, None).df
    assert patterns.count() <= 5 * 2 * 2
    plan = design.sums(["g"], blocks).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.rindex("Aggregate")
