"""Quality by the votes of the nearest labelled documents in a latent semantic space.

A text is a bag of tokens: runs of letters and digits, lower-cased, and runs of other
signs; two capital letters in a row add the token ``^``, and tokens equal to the one before add a token for their
number and one for their share in eighths. Tokens weigh ``log(1 + count) * idf``.
The leading singular vectors of the labelled sample map a bag to ``axes`` numbers, scaled
to length 1; tokens that the sample lacks add nothing. The vectors of the sample and their labels are
broadcast, and every document's cosine with each of them is computed, a block of documents at a time: no
index, no candidates. Its ``neighbours`` nearest vote for their label with their
similarity (negative ones have no vote); all that tie with the last one vote too, so the order of the sample does not
matter. Cosines are compared after rounding to ``DIGITS`` decimals.

The sample has at most ``sample_rows`` labelled documents, half of each label at most, those whose hashed ids
are smallest; a vote is weighted back to its label's share. ``TERMS`` tokens at most form the vocabulary, those in most documents of the sample. So the
sample, the axes and what is broadcast have a bound that does not depend on the tables; all documents are scored over their whole texts.

Rules for odd input: a text without a known token (NULL and empty ones, too) gets the share of label
1; labels with a NULL id or quality or without a document are not used; a document labelled twice
has its lowest quality; of several texts under a sampled id the smallest is used; without labels every score is 0.5; repeated rows are
scored each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
CAPITALS = re.compile(rb"[A-Z]{2}")
SAMPLE_ROWS = 4000
TERMS = 8000
LEAST_DOCS = 3
DIGITS = 6
BLOCK = 256
# A longer token goes by its hash, so that the vocabulary has a bound in bytes.
LONGEST_TOKEN = 64


@dataclass
class NeighbourModel:
    terms: dict[bytes, int]
    idf: np.ndarray
    axes: np.ndarray  # terms x axes
    vectors: np.ndarray  # sample x axes
    labels: np.ndarray
    weights: np.ndarray
    share: float


def bag_of(text: bytes | None) -> Counter[bytes]:
    if not text:
        return Counter()
    tokens = TOKEN.findall(text.lower())
    bag = Counter(t if len(t) <= LONGEST_TOKEN else xxhash.xxh64_digest(t) for t in tokens)
    capitals = len(CAPITALS.findall(text))
    if capitals:
        bag[b"^"] += capitals
    repeats = sum(map(eq, tokens, islice(tokens, 1, None)))
    if repeats:
        bag[b" ="] = repeats
        bag[b" =%d" % (8 * repeats // len(tokens))] = repeats
    return bag


def _labelled(labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("label"))


def sample_of(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``label_id, label, weight, text``: at most ``rows`` labelled documents that exist."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    known = _labelled(labels).join(ids, F.col("label_id") == F.col("doc_id"), "left_semi")
    counts = known.groupBy("label").count().collect()
    parts = []
    for label, n in sorted((r["label"], r["count"]) for r in counts if r["label"] in (0, 1)):
        chosen = known.where(F.col("label") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(rows // 2)
        parts.append(chosen.withColumn("weight", F.lit(max(1.0, n / (rows // 2)))))
    if not parts:
        return labels.sparkSession.createDataFrame([], "label_id long, label long, weight double, text binary")
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # At most sample_rows rows of three numbers; one text for each id, whatever the number of its rows.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("label_id")), F.col("doc_id") == F.col("label_id"))
    texts = texts.groupBy("doc_id").agg(F.min("text").cast("binary").alias("text"))
    return chosen.join(texts, F.col("label_id") == F.col("doc_id")).select("label_id", F.col("label").cast("long").alias("label"), "weight", "text")


def _bags(sample: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bag = sorted(bag_of(batch["text"][row].as_py()).items())
                n = len(bag)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["label_id"][row].as_py()] * n, pa.int64()),
                        pa.array([t for t, _ in bag], pa.binary()),
                        pa.array([c for _, c in bag], pa.int64()),
                    ],
                    names=["label_id", "term", "n"],
                )

    return sample.mapInArrow(cut, "label_id long, term binary, n long")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, axes: int = 48) -> NeighbourModel | None:
    """The frozen space and the labelled vectors in it; None without labels."""
    sample = sample_of(docs, labels, sample_rows).persist()
    rows = sorted(tuple(r) for r in sample.select("label_id", "label", "weight").collect())
    if not rows:
        sample.unpersist()
        return None
    bags = _bags(sample)
    frequent = bags.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min(LEAST_DOCS, len(rows)))
    # At most TERMS rows of a short token.
    vocabulary = frequent.orderBy(F.col("df").desc(), "term").limit(TERMS)
    chosen = vocabulary.collect()
    # At most sample_rows x TERMS numbers; texts stay where they are.
    cells = bags.join(F.broadcast(vocabulary.select("term")), "term").select("label_id", "term", "n").toArrow()
    sample.unpersist()
    terms = {bytes(r["term"]): i for i, r in enumerate(chosen)}
    idf = np.log((1 + len(rows)) / (1 + np.array([r["df"] for r in chosen], float))) + 1
    place = {r[0]: i for i, r in enumerate(rows)}
    at = np.array([place[i] for i in cells["label_id"].to_pylist()], np.int64)
    column = np.array([terms[t] for t in cells["term"].to_pylist()], np.int64)
    table = np.zeros((len(rows), len(terms)), np.float32)
    table[at, column] = np.log1p(cells["n"].to_numpy()) * idf[column]
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    basis = leading_axes(table, min(axes, *table.shape) if table.size else 0)
    vectors = unit_rows((table @ basis).astype(np.float64))
    label, weight = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    return NeighbourModel(terms, idf, basis.astype(np.float64), vectors, label, weight, float((label * weight).sum() / weight.sum()))


def leading_axes(table: np.ndarray, axes: int, turns: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    if not axes:
        return np.zeros((table.shape[1], 0), np.float32)
    wide = min(axes + 16, *table.shape)
    basis = np.random.default_rng(0).standard_normal((table.shape[1], wide)).astype(np.float32)
    for _ in range(turns):
        basis = np.linalg.qr(table.T @ (table @ np.linalg.qr(basis)[0]))[0]
    _, _, turned = np.linalg.svd(table @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :axes]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-9)


def project(model: NeighbourModel, texts: list[bytes | None]) -> np.ndarray:
    """Unit vectors of texts; zero for a text without a known token."""
    out = np.zeros((len(texts), model.axes.shape[1]))
    for row, text in enumerate(texts):
        bag = bag_of(text)
        known = sorted((model.terms[t], bag[t]) for t in bag.keys() & model.terms.keys())
        if known:
            column, n = np.array(known).T
            out[row] = (np.log1p(n) * model.idf[column]) @ model.axes[column]
    return unit_rows(out)


def votes(model: NeighbourModel, vectors: np.ndarray, neighbours: int) -> np.ndarray:
    """Share of the votes for label 1, for a block of vectors against all labelled ones."""
    cosine = np.round(vectors @ model.vectors.T, DIGITS)
    k = min(neighbours, cosine.shape[1])
    last = np.partition(cosine, -k, axis=1)[:, -k, None]
    power = np.where(cosine >= last, np.maximum(cosine, 0), 0) * model.weights
    whole = power.sum(axis=1)
    return np.divide(power @ model.labels, whole, out=np.full(len(whole), model.share), where=whole > 0)


def quality_score(spark: SparkSession, model: NeighbourModel | None, text: Column, neighbours: int = 15) -> Column:
    """Score of a text column, 0 to 1; higher: label 1 is likelier."""
    if model is None:
        return F.lit(0.5)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            blocks = [texts[low : low + BLOCK].tolist() for low in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate([votes(model, project(model, b), neighbours) for b in blocks]) if blocks else np.zeros(0))

    return F.least(F.greatest(score(text.cast("binary")), F.lit(0.0)), F.lit(1.0))


def in_fold_zero(doc_id: Column) -> Column:
    """The held-out fifth: crc32 of the id as text is divisible by 5; a NULL id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def vote_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, cutoff: float = 0.3, **settings: int) -> DataFrame:
    """``doc_id, score, predicted`` of every document; labels where ``held_out`` (over ``doc_id``) holds are not learned."""
    learned = labels if held_out is None else labels.where(~held_out)
    texts = docs.select("doc_id", "text")
    model = fit(texts, learned.select("doc_id", "quality"), **settings)
    scored = texts.select("doc_id", quality_score(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
