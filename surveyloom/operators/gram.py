"""Rank of a matrix with one row a person, from its Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_matrix(df: DataFrame, rows: Column, width: int) -> DataFrame:
    """``i, j, g`` for ``i <= j``: sums over all rows of component i times component j, counted from 1.

    ``rows`` is an array of ``width`` numbers; a missing component is 0. Every task adds its rows up to
    one small matrix, so what is shuffled does not depend on the number of rows.
    """
    i, j = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            # A missing row has no components here.
            x = pc.fill_null(batch.column(0).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(i + 1, pa.int32()), pa.array(j + 1, pa.int32()), pa.array(total[i, j])], names=["i", "j", "g"])

    parts = df.select(rows.cast("array<double>").alias("x")).mapInArrow(add, "i int, j int, g double")
    return parts.groupBy("i", "j").agg(F.sum("g").alias("g"))


def matrix_rank(gram: np.ndarray, tolerance: float = 1e-11) -> int:
    """Rank of a Gram matrix by elimination with the largest remaining diagonal as the pivot.

    Components are brought to length one first; a remainder below ``tolerance`` is rounding.
    """
    length = np.sqrt(np.diag(gram))
    some = length > 0
    rest = gram[np.ix_(some, some)] / np.outer(length[some], length[some])
    rank = 0
    while rest.size:
        p = int(np.argmax(np.diag(rest)))
        if rest[p, p] <= tolerance:
            break
        rank += 1
        rest = rest - np.outer(rest[:, p], rest[p, :]) / rest[p, p]
        rest = np.delete(np.delete(rest, p, 0), p, 1)
    return rank


def row_rank(df: DataFrame, rows: Column, width: int) -> int:
    """Rank of the matrix of all rows; ``width`` squared numbers reach the driver."""
    gram = np.zeros((width, width))
    for r in gram_matrix(df, rows, width).collect():
        gram[r.i - 1, r.j - 1] = gram[r.j - 1, r.i - 1] = r.g
    return matrix_rank(gram)
