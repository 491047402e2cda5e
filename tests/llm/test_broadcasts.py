"""Tables that an explode has made larger than Spark knows are not broadcast."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import line_templates, simhash
from surveyloom.llm.cells import in_units
from surveyloom.llm.line_templates import SALTS, _salted, general_templates, parsed_lines
from surveyloom.sources.staging import stage


def plan_of(df):
    """The last plan of a query that has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_cells_are_not_broadcast(spark):
    # 500 rows of a few kilobytes become 35,000 in some thousand cells.
    rows = spark.range(500).repartition(4).select(F.col("id").alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(69))).alias("k"))
    units = in_units(rows.select("fp", (F.col("fp") % 100 * 70 + F.col("k") * (F.col("fp") % 2 + 1)).alias("cell")), "cell", "fp")
    placed = units.select("cell", "fp")
    got = placed.collect()
    where = {}
    for fp in range(500):
        for k in range(70):
            where.setdefault(fp % 100 * 70 + k * (fp % 2 + 1), []).append(fp)
    assert sorted(got) == sorted((cell, fp) for cell, fps in where.items() if len(fps) > 1 for fp in fps)
    assert "BroadcastExchange" not in plan_of(placed) and "SortMergeJoin" in plan_of(placed)


def test_salted_keys_are_not_broadcast(spark):
    keys = stage(spark.range(300).select(F.col("id").alias("leaf")), "leaves")
    rows = spark.range(3000).select((F.col("id") % 600).alias("leaf"), (F.col("id") % SALTS).cast("int").alias("salt"), "id")
    kept = rows.join(_salted(keys), ["leaf", "salt"], "left_semi")
    assert sorted(r.id for r in kept.collect()) == [i for i in range(3000) if i % 600 < 300]
    assert "BroadcastExchange" not in plan_of(kept) and "SortMergeJoin" in plan_of(kept)


def test_recurring_choices_of_fields_are_not_broadcast(spark):
    texts = [f"common words lead the line number {'abcdefgh'[i]} here" for i in range(4)] + ["quite another line that stands alone in all texts"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = general_templates(stage(parsed_lines(docs, 3), "lines"), 0.75)
    assert [r["first"].doc_id for r in found.collect()] == [0] * 4
    assert "BroadcastExchange" not in plan_of(found) and "SortMergeJoin" in plan_of(found)


@pytest.fixture(scope="module")
def prose(spark):
    """Pairs of documents that differ in one word of their last line."""
    letters = "abcdefgh"
    lines = [f"{a} common words lead the line {b} of a page" for a in letters for b in letters]
    rows = [(i, "\n".join([*lines[4 * (i // 2) : 4 * (i // 2) + 4], f"this one is of {letters[i % 8] * (i + 2)} only"]), "en", "s") for i in range(32)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


def test_line_stage_broadcasts_no_salted_leaves(spark, prose, monkeypatch):
    plans = {}

    def watched(df, name):
        plans[name] = plan_of(df)
        return stage(df, name)

    monkeypatch.setattr(line_templates, "stage", watched)
    left = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.line_dedup(spark, prose, "").collect()}
    # A template has the eight lines of a first letter, which lie in four documents; one has all the last lines.
    want = {4 * i: [f"{a} common words lead the line a of a page"] for i, a in enumerate("abcdefgh")}
    want[0].append("this one is of aa only")
    assert left == want
    assert "BroadcastExchange" not in plans["choices"] and "SortMergeJoin" in plans["choices"]


def test_simhash_stage_broadcasts_no_cells(spark, prose, monkeypatch):
    units = []

    def watched(*args):
        units.append(in_units(*args))
        return units[-1]

    monkeypatch.setattr(simhash, "in_units", watched)
    twice = prose.unionByName(prose.withColumn("doc_id", F.col("doc_id") + 100))
    left = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, twice, "").collect()}
    assert 0 in left and left <= set(range(32))
    assert "BroadcastExchange" not in plan_of(units[0]) and "SortMergeJoin" in plan_of(units[0])
