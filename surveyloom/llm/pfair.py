"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in the order of a hash of their ids, are laid end to end
and cut into blocks of ``block_size``; a document belongs to the block it starts in.
One block is written in each slot. Block ``k`` of a source with weight ``w`` is released
at slot ``floor(k / w)`` and due by slot ``ceil((k + 1) / w)``; of the released blocks
the one with the earliest deadline is next. Since the weights sum to one, every block
runs inside its window, and so at every slot the number of blocks that a source has
had differs by less than one from ``w`` times the number of slots.

Weights are exact fractions, each the decimal number that it is written as, so the bound holds
against the targets themselves however long the mixture is. One task walks through the slots, with one number for each source, and writes the schedule as a table;
blocks find their slots by a join. The mixture ends when every document has been written
once. A source whose target is above its share of the input starts over, up to that end;
nothing is left out.

Rules for odd input: NULL is a source of its own; a document takes one byte at least,
so NULL and empty texts are mixed too; a document longer than a block fills the
following slots of its source as well; repeated rows and tied ids are documents of
their own; an empty table gives an empty result; a source that the targets do not name, or name with
a weight of zero or less, is an error. Input columns are kept, but for those
that have the name of a result.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.numbering import running_total
from surveyloom.sources.staging import stage

SLOTS_AT_ONCE = 1 << 16
RESULTS = ["size", "block", "pass_no", "slot", "release_slot", "deadline_slot"]


def whole_parts(weights: list[float], resolution: int) -> list[int]:
    """Weights as positive whole numbers that sum to ``resolution``, by largest remainders."""
    if any(w <= 0 for w in weights):
        raise ValueError("a target weight must be above zero")
    if len(weights) > resolution:
        raise ValueError("there are more sources than parts")
    total = sum(map(Fraction, weights))
    exact = [resolution * Fraction(w) / total for w in weights]
    parts = [max(1, int(x)) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (parts[i] - exact[i], i))
    left = resolution - sum(parts)
    for i in order[: max(left, 0)]:
        parts[i] += 1
    # What the smallest sources have above their weight is taken where it shows least.
    while left < 0:
        i = max((i for i in range(len(parts)) if parts[i] > 1), key=lambda i: (parts[i], -i))
        parts[i] -= 1
        left += 1
    return parts


def exact_parts(weights: list[float]) -> list[int]:
    """The smallest whole numbers in the proportions of the weights."""
    if any(w <= 0 for w in weights):
        raise ValueError("a target weight must be above zero")
    exact = [Fraction(str(w)) for w in weights]
    common = math.lcm(*[x.denominator for x in exact])
    parts = [int(x * common) for x in exact]
    return [p // math.gcd(*parts) for p in parts]


def walked(parts: list[int]) -> Iterator[tuple[int, int]]:
    """Earliest deadline first, without end: the source and its block number in each slot."""
    period = sum(parts)
    waiting = [(0, i, 0) for i in range(len(parts))]
    ready: list[tuple[int, int, int]] = []
    for slot in itertools.count():
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // parts[i]), i, k))
        deadline, i, k = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("weights that sum to one leave no block late")
        yield i, k
        heapq.heappush(waiting, ((k + 1) * period // parts[i], i, k + 1))


def one_period(parts: list[int]) -> list[tuple[int, int]]:
    """The source and its block number in each slot of a period."""
    return list(itertools.islice(walked(parts), sum(parts)))


def slots_until_done(blocks: list[int], parts: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Source, block, pass, slot and number of the block, until every source has had all its blocks once."""
    open_sources = len(blocks)
    for slot, (i, k) in enumerate(walked(parts)):
        yield i, k % blocks[i], k // blocks[i], slot, k
        open_sources -= k + 1 == blocks[i]
        if not open_sources:
            return


def schedule_table(spark: SparkSession, blocks: list[int], parts: list[int]) -> DataFrame:
    """``_owner, _turn, _pass, _slot, _release, _deadline``: a row for each slot."""
    period = sum(parts)
    names = ["_owner", "_turn", "_pass", "_slot", "_release", "_deadline"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = slots_until_done(blocks, parts) if batch.num_rows else iter(())
            while some := list(itertools.islice(slots, SLOTS_AT_ONCE)):
                rows = [(i, b, p, s, k * period // parts[i], -(-(k + 1) * period // parts[i])) for i, b, p, s, k in some]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(rows, np.int64).T], names=names)

    return stage(spark.range(1, numPartitions=1).mapInArrow(walk, ", ".join(f"{n} long" for n in names)), "slots")


def tempered(sizes: list[int], power: float) -> list[float]:
    """Target weights that follow the sizes, with large sources held back."""
    return [max(n, 1) ** power for n in sizes]


def mix_sources(
    docs: DataFrame,
    size: Column,
    targets: Mapping[str | None, float] | None = None,
    power: float = 0.9,
    block_size: int = 1 << 16,
    resolution: int | None = None,
) -> DataFrame:
    """``docs`` with ``size, block, pass_no, slot, release_slot, deadline_slot``; rows in slot order are the mixture.

    ``targets`` gives the weight of every source; without it, weights are the numbers of
    blocks of the sources to ``power``. A source then repeats at most
    ``(largest / own) ** (1 - power)`` times. With ``resolution`` the weights are rounded to that
    many parts first.
    """
    spark = docs.sparkSession
    place = F.xxhash64("doc_id", size)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("source").alias("_source"),
        F.col("doc_id").alias("_id"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(1)).alias("_size"),
        place.alias("_place"),
    ).withColumn("_chunk", F.shiftrightunsigned("_place", 54))
    totals = sorted(rows.groupBy("_source").agg(F.sum("_size").alias("n")).collect(), key=lambda r: (r["_source"] is not None, r["_source"]))
    if not totals:
        return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS], *[F.lit(0).cast("long").alias(c) for c in RESULTS])
    blocks = [-(-r["n"] // block_size) for r in totals]
    unnamed = [] if targets is None else [r["_source"] for r in totals if r["_source"] not in targets]
    if unnamed:
        raise ValueError(f"no target weight for the sources {unnamed}")
    weights = tempered(blocks, power) if targets is None else [targets[r["_source"]] for r in totals]
    parts = exact_parts(weights) if resolution is None else whole_parts(weights, resolution)

    source_kind = docs.select("source").schema["source"].dataType.simpleString()
    sources = spark.createDataFrame([(r["_source"], i) for i, r in enumerate(totals)], f"_name {source_kind}, _number long")
    schedule = schedule_table(spark, blocks, parts)

    laid = running_total(rows, "_source", "_chunk", [F.col("_place"), F.col("_id"), F.col("_size")], F.col("_size"), "_offset")
    known = laid.join(F.broadcast(sources), laid["_source"].eqNullSafe(sources["_name"]))
    turned = known.withColumn("_block", F.floor(F.col("_offset") / block_size))
    found = turned.join(schedule, (turned["_number"] == schedule["_owner"]) & (turned["_block"] == schedule["_turn"]))
    results = {
        "size": F.col("_size"),
        "block": F.col("_block"),
        "pass_no": F.col("_pass"),
        "slot": F.col("_slot"),
        "release_slot": F.col("_release"),
        "deadline_slot": F.col("_deadline"),
    }
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in results]
    return found.select(*kept, *[c.alias(n) for n, c in results.items()])
