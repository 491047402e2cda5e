"""Work over cells of rows, when some cells hold very many.

``in_units`` cuts every cell into blocks of a bounded number of rows and sends each
pair of blocks to a unit of its own, so that all pairs of a cell meet and no task
needs a whole large cell. ``star_links`` then replaces the pairs found in a unit by
one link for each row, which connects the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 2048


def in_units(rows: DataFrame, cell: str, salt: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Rows of cells with two rows or more, with columns ``unit, block, other``, sorted by unit in each partition.

    ``salt`` is a long column that differs between the rows of a cell. A unit holds the
    rows of one block (``block = other``) or of two.
    """
    sizes = rows.groupBy(F.col(cell).alias("_cell")).agg(F.count("*").alias("_n")).where("_n > 1")
    # Rows come from an explode, which Spark takes for as many rows as went in: unasked it would broadcast all of them.
    sized = rows.hint("merge").join(sizes.hint("merge"), rows[cell] == sizes["_cell"])
    blocks = F.ceil(F.col("_n") / rows_per_block).cast("int")
    own = F.pmod(F.xxhash64(salt), blocks.cast("long")).cast("int")
    # A cell of one block, by far the most common, is one unit without other blocks.
    other = F.explode(F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    placed = sized.withColumn("block", own).withColumn("other", other)
    unit = F.xxhash64(cell, F.least("block", "other"), F.greatest("block", "other"))
    return placed.withColumn("unit", unit).drop("_cell", "_n").repartition("unit").sortWithinPartitions("unit")


def whole_units(batches: Iterator[pa.RecordBatch], some_rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole units, about ``some_rows`` rows each, from batches sorted by ``unit``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < some_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        unit = table["unit"].to_numpy()
        cut = int(np.searchsorted(unit, unit[-1], "left"))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows = len(unit) - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_by_lag(unit: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Star links between rows of one unit that ``linked(i, j)`` accepts; ``unit`` is sorted.

    Rows at a distance of 1, 2, ... are compared together, so small units cost no loop of
    their own. Pairs are reduced to stars whenever many have been found.
    """
    n = len(unit)
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    sizes = np.diff(np.r_[starts, n])
    ends = np.repeat(starts + sizes, sizes)
    here = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0
    for lag in range(1, int(sizes.max()) if n else 0):
        here = here[here + lag < ends[here]]
        i, j = here, here + lag
        ok = linked(i, j)
        if ok.any():
            found.append((i[ok], j[ok]))
            many += int(ok.sum())
        if many > 1 << 20:
            found = [star_links(n, *map(np.concatenate, zip(*found)))]
            many = 0
    return star_links(n, *map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def star_links(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every row that has one to the smallest row that it is connected with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            break
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]
