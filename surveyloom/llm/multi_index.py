"""Near-duplicate vectors through an inverted multi-index.

A vector of length one is cut into two halves, each with a codebook of its own. The
pair of nearest centroids is the vector's cell in a product grid, where inverted lists
are kept. A vector visits cells in the order of ``e1 + e2``, how much farther (in squared
distance) their centroids are than the nearest ones, up to a margin. The margin is the
largest of what four measurements ask for, each at ``target_recall`` and from one side or
the other: pairs at exactly the least similarity, made from the sample in random
directions of the whole space, in directions drawn from the covariance of the data and in
directions between sampled vectors; and real pairs, for which ``QUERY_ROWS`` sampled
vectors are compared with every vector of their label, in blocks. What is met is verified
by the exact cosine in double precision.

Grid rows (cells with one first centroid) are the places where the lists meet their
visitors: a vector is sent to the rows it visits, and inside a row only to the lists it
visits. A row with many vectors is cut into blocks and all pairs of blocks are worked on,
so no list has a cap. A pair that two vectors meet from both sides counts once.

Equal vectors of a label are compared as one. Links leave a task as one count and one
link for each vector, not as pairs.

The codebooks are fitted on a sample of at most ``SAMPLE_ROWS`` vectors and
``SAMPLE_BYTES`` bytes; every vector is indexed. Codebooks grow with the square root of
the rows of a label, to at most a sixteenth of the sample.

Rules for odd input: a vector that is NULL, empty, zero or has a NULL or non-finite
component, or a NULL label or vec_id, links with nothing and is its own component; vectors of different
lengths do not link; repeated ids count as vectors of their own; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.cells import in_units, star_links, whole_units
from surveyloom.llm.components import connected_components
from surveyloom.sources.staging import stage

SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 32 << 20
# Sampled vectors of each length whose real neighbours among all vectors set the margin.
QUERY_ROWS = 1024
ROWS_PER_CELL = 64
ROWS_PER_BLOCK = 8192
# Visitors of a list that are compared at a time.
TILE = 512


@dataclass
class MultiIndex:
    """Codebooks of the two halves of vectors of one length, and the margin of the traversal."""

    first: np.ndarray
    second: np.ndarray
    margin: float

    def excess(self, unit_vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = unit_vectors.shape[1] // 2
        return _excess(unit_vectors[:, :half], self.first), _excess(unit_vectors[:, half:], self.second)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :]


def _excess(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = _squared(x, centroids)
    return d - d.min(1, keepdims=True)


def _codebook(x: np.ndarray, size: int, rng: np.random.Generator, turns: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), size, replace=False)].copy()
    for _ in range(turns):
        nearest = _squared(x, centroids).argmin(1)
        n = np.bincount(nearest, minlength=size)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def fit(sample: np.ndarray, size: int, similarity: float, target_recall: float) -> MultiIndex:
    """Codebooks of ``size`` centroids, and the margin at which the target is met."""
    rng = np.random.default_rng(0)
    half, size = sample.shape[1] // 2, max(1, min(size, len(sample) // 16))
    index = MultiIndex(_codebook(sample[:, :half], size if half else 1, rng), _codebook(sample[:, half:], size, rng), 0.0)
    here = np.arange(len(sample))
    for away in _directions(sample, rng):
        away = away - (away * sample).sum(1, keepdims=True) * sample
        length = np.linalg.norm(away, axis=1, keepdims=True)
        other = similarity * sample + np.sqrt(1 - similarity**2) * away / np.maximum(length, 1e-300)
        e, other_e = index.excess(sample), index.excess(other)
        needed = _needed(e, other_e, here, here)[length[:, 0] > 1e-9]
        if len(needed):
            index.margin = max(index.margin, float(np.quantile(needed, target_recall)))
    return index


def _directions(sample: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Ways to leave each vector: anywhere, as the data spreads, and towards another vector."""
    yield rng.standard_normal(sample.shape)
    spread, axes = np.linalg.eigh(sample.T @ sample / len(sample))
    yield rng.standard_normal(sample.shape) * np.sqrt(np.maximum(spread, 0)) @ axes.T
    yield sample[rng.permutation(len(sample))] - sample


def _needed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The margin at which vector ``i`` of ``a`` and vector ``j`` of ``b`` meet, from the nearer side."""
    (a1, a2), (b1, b2) = a, b
    there = a1[i, b1.argmin(1)[j]] + a2[i, b2.argmin(1)[j]]
    back = b1[j, a1.argmin(1)[i]] + b2[j, a2.argmin(1)[i]]
    return np.minimum(there, back)


def _widen(distinct: DataFrame, indexes: dict[int, MultiIndex], samples: dict[int, pa.Table], similarity: float, target_recall: float) -> None:
    """Margins at which ``target_recall`` of the queries meet all their real neighbours.

    One scan; a task returns one number for each query that has a neighbour in it.
    """
    queries = {}
    for dim, sample in samples.items():
        own = sample.slice(0, QUERY_ROWS)
        x = _unit_vectors(own["vector"])
        queries[dim] = (own["rep"].to_numpy(), own["kind"].to_numpy(), x, indexes[dim].excess(x))
    shared = distinct.sparkSession.sparkContext.broadcast((indexes, queries))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, queries = shared.value
        most = {dim: np.full(len(q[0]), -1.0) for dim, q in queries.items()}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                rep, kind, x, e = queries[dim]
                rows, row_kind, y = some["rep"].to_numpy(), some["kind"].to_numpy(), _unit_vectors(some["vector"])
                for low in range(0, len(x), TILE):
                    i, j = np.nonzero(x[low : low + TILE] @ y.T >= similarity)
                    i += low
                    real = (kind[i] == row_kind[j]) & (rep[i] != rows[j])
                    i, j = i[real], j[real]
                    if len(i):
                        near, to = np.unique(j, return_inverse=True)
                        np.maximum.at(most[dim], i, _needed(e, indexes[dim].excess(y[near]), i, to))
        for dim, needed in most.items():
            met = np.flatnonzero(needed >= 0)
            columns = [pa.array(np.full(len(met), dim), pa.int32()), pa.array(met, pa.int32()), pa.array(needed[met])]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "query", "needed"])

    found = distinct.select("rep", "dim", "kind", "vector").mapInArrow(needs, "dim int, query int, needed double")
    # At most QUERY_ROWS numbers for each length of vectors.
    per_query = found.groupBy("dim", "query").agg(F.max("needed").alias("needed")).toPandas()
    for dim, needed in per_query.groupby("dim")["needed"]:
        margin = float(np.quantile(needed.to_numpy(), target_recall, method="higher"))
        # Rounding in blocks of another shape may move the last bits.
        indexes[dim].margin = max(indexes[dim].margin, margin * (1 + 1e-9) + 1e-12)


def _unit_vectors(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64)
    vectors = flat.reshape(len(column), -1)
    # Scaling first keeps the squares of very large and very small components finite.
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _met_in_row(index: MultiIndex, row: int, table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors of one unit: which have links, how many, and the smallest-placed one they lead to."""
    x = _unit_vectors(table["vector"])
    rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
    block, other = table["block"].to_numpy(), table["other"].to_numpy()
    e1, e2 = index.excess(x)
    c1, c2 = e1.argmin(1), e2.argmin(1)
    two_blocks = block[0] != other[0]
    width = e2.shape[1]
    cell = c1 * width + c2
    links = np.zeros(len(x), np.int64)
    stars: list[tuple[np.ndarray, np.ndarray]] = []
    for j in np.unique(c2[c1 == row]):
        lists = np.flatnonzero((c1 == row) & (c2 == j))
        visitors = np.flatnonzero(e1[:, row] + e2[:, j] <= index.margin)
        for low in range(0, len(visitors), TILE):
            some = visitors[low : low + TILE]
            p, h = np.nonzero(x[some] @ x[lists].T >= similarity)
            p, h = some[p], lists[h]
            back = e1[h, c1[p]] + e2[h, c2[p]] <= index.margin
            once = np.where(cell[p] == cell[h], rep[p] < rep[h], ~back | (cell[h] < cell[p]))
            once &= (block[p] != block[h]) if two_blocks else (p != h)
            p, h = p[once], h[once]
            np.add.at(links, p, copies[h])
            np.add.at(links, h, copies[p])
            if len(p):
                stars.append(star_links(len(x), p, h))
    if not stars:
        nothing = np.empty(0, np.int64)
        return nothing, nothing, nothing
    i, root = star_links(len(x), *map(np.concatenate, zip(*stars)))
    leads = np.arange(len(x))
    leads[i] = root
    linked = np.flatnonzero(links)
    return rep[linked], links[linked], rep[leads[linked]]


def _distinct_vectors(valid: DataFrame) -> DataFrame:
    return valid.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def near_duplicate_vectors(embeddings: DataFrame, similarity: float = 0.93, target_recall: float = 0.9999) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each vector."""
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    infinite = float("inf")
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == infinite))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    distinct = stage(_distinct_vectors(rows.where("_ok")), "vectors")
    distinct = distinct.withColumn("dim", F.size("vector")).withColumn("kind", F.xxhash64("label"))

    sizes = distinct.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect()
    indexes: dict[int, MultiIndex] = {}
    samples: dict[int, pa.Table] = {}
    for r in sizes:
        wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * r["dim"])))
        part = distinct.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / r["n"]))))
        sample = part.select("rep", "kind", "vector").toArrow().sort_by("rep")
        if not len(sample):
            sample = distinct.where(F.col("dim") == r["dim"]).orderBy("rep").limit(1).select("rep", "kind", "vector").toArrow()
        size = round((r["most"] / ROWS_PER_CELL) ** 0.5)
        indexes[r["dim"]] = fit(_unit_vectors(sample["vector"]), size, similarity, target_recall)
        # Queries spread over the sample, in an order that has nothing to do with their ids.
        samples[r["dim"]] = sample.take(np.random.default_rng(1).permutation(len(sample))[:QUERY_ROWS])
    _widen(distinct, indexes, samples, similarity, target_recall)
    shared = spark.sparkContext.broadcast(indexes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                e1, _ = shared.value[dim].excess(_unit_vectors(some["vector"]))
                at, row = np.nonzero(e1 <= shared.value[dim].margin)
                sent = some.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([sent["rep"], sent["label"], sent["dim"], pa.array(row, pa.int32()), sent["copies"], sent["vector"]], names=["rep", "label", "dim", "row", "copies", "vector"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches, ROWS_PER_BLOCK):
            unit = table["unit"].to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]), len(unit)]
            for low, high in zip(edges, edges[1:]):
                own = table.slice(low, high - low)
                found = _met_in_row(shared.value[own["dim"][0].as_py()], own["row"][0].as_py(), own, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in found], names=["rep", "links", "leads"])

    label = distinct.schema["label"].dataType.simpleString()
    sent = distinct.select("rep", "label", "dim", "copies", "vector").mapInArrow(
        visit, f"rep long, label {label}, dim int, row int, copies long, vector array<double>"
    )
    units = in_units(sent.withColumn("cell", F.xxhash64("label", "dim", "row")), "cell", "rep", ROWS_PER_BLOCK)
    found = stage(units.select("unit", "block", "other", "rep", "dim", "row", "copies", "vector").mapInArrow(compare, "rep long, links long, leads long"), "vector-links")

    groups = connected_components(found.select(F.col("rep").alias("src"), F.col("leads").alias("dst")))
    counts = found.groupBy(F.col("rep").alias("_rep")).agg(F.sum("links").alias("links"))
    classes = (
        distinct.join(counts, distinct["rep"] == counts["_rep"], "left")
        .join(groups, distinct["rep"] == groups["node"], "left")
        .select(
            F.col("label").alias("_label"),
            F.col("vector").alias("_vector"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"),
            F.coalesce("component", "rep").alias("_component"),
        )
    )
    same = rows["_ok"] & (rows["label"] == classes["_label"]) & (rows["vector"] == classes["_vector"])
    component = F.coalesce("_component", "vec_id")
    return rows.join(classes, same, "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
