"""Toxicity as a grade of severity, by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(threshold_k - weights . tokens)``: one weight for each token,
shared by all thresholds, which rise with the grade. The expected severity is
``sum_k P(grade > k)``. A text is a set of lower-cased runs of letters and digits; a token
that is in it counts once.

The grade of a labelled document is 0 if it is not toxic, 1 if it is toxic, and 2 if
it is toxic and also of low quality.

The model is fitted by proximal AdaGrad with an L1 penalty, which chooses the tokens, and then
again on those tokens with a weak one, which gives their weights; on a sample of at most
``SAMPLE_ROWS`` labelled documents (half of them toxic at most, those whose hashed ids
are smallest, weighted back to their shares), with their whole texts; tokens of fewer than
``LEAST_DOCS`` of them are left out. Most weights end at zero and are not kept. Every
document is then scored over its whole text.

Rules for odd input: NULL and empty texts have no token and the severity of the
thresholds alone; labels with a NULL id or toxicity, or without a document, are not used;
a document labelled twice has its highest grade; repeated rows are scored each;
without toxic or without clean labels every severity is the mean grade; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+")
SAMPLE_ROWS = 16_000
LEAST_DOCS = 3
GRADES = 3


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: np.ndarray


def tokens_of(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


def graded(labels: DataFrame) -> DataFrame:
    """``label_id, grade``, one row for each labelled document."""
    toxic = F.col("toxic") == 1
    grade = F.when(~toxic, 0).when(F.col("quality") == 0, 2).otherwise(1)
    known = labels.where("doc_id is not null and toxic is not null")
    return known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(grade).alias("grade"))


def sample_of(docs: DataFrame, grades: DataFrame, rows: int = SAMPLE_ROWS) -> pa.Table:
    """``grade, weight, tokens`` of the sampled documents."""
    sizes = {r["toxic"]: r["count"] for r in grades.groupBy((F.col("grade") > 0).alias("toxic")).count().collect()}
    parts = []
    for toxic, n in sorted(sizes.items()):
        chosen = grades.where((F.col("grade") > 0) == F.lit(toxic)).orderBy(F.xxhash64("label_id"), "label_id").limit(rows // 2)
        parts.append(chosen.withColumn("weight", F.lit(max(1.0, n / (rows // 2)))))
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pa.array([sorted(tokens_of(t)) for t in batch["text"].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["grade"], batch["weight"], tokens], names=["grade", "weight", "tokens"])

    # At most SAMPLE_ROWS rows of three numbers.
    texts = docs.select("doc_id", "text")
    labelled = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"]).select("grade", "weight", "text")
    return labelled.mapInArrow(cut, "grade int, weight double, tokens array<string>").toArrow()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit(sample: pa.Table, penalties: tuple[float, ...] = (3.0, 0.05), turns: int = 200, rate: float = 0.3) -> OrdinalModel:
    """Each penalty weighs as much as that many documents of weight 1 that are wholly wrong."""
    grade = sample["grade"].to_numpy().astype(np.int64)
    share = sample["weight"].to_numpy() / max(sample["weight"].to_numpy().sum(), 1e-300)
    mean = [float(share[grade > k].sum()) for k in range(GRADES - 1)]
    base = np.array([np.log1p(-p) - np.log(p) if 0 < p < 1 else (30.0 if p <= 0 else -30.0) for p in mean])
    if not 0 < mean[0] < 1:
        return OrdinalModel({}, base)
    whole = max(sample["weight"].to_numpy().sum(), 1e-300)
    lists = sample["tokens"].combine_chunks()
    encoded = lists.flatten().dictionary_encode()
    column = encoded.indices.to_numpy()
    row = np.repeat(np.arange(len(grade)), np.diff(lists.offsets.to_numpy()))
    kept_tokens = np.bincount(column, minlength=len(encoded.dictionary)) >= LEAST_DOCS
    use = kept_tokens[column]
    row, column = row[use], column[use]
    n = len(encoded.dictionary)
    weights, squares = np.zeros(n), np.full(n, 1e-12)
    # The first threshold, and the logarithms of the steps to the later ones.
    steps = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 0.1))])
    step_squares = np.full(GRADES - 1, 1e-12)
    for turn in range(turns * len(penalties)):
        if turn % turns == 0:
            penalty = penalties[turn // turns] / whole
            squares[:], step_squares[:] = 1e-12, 1e-12
            if turn:
                use = weights[column] != 0
                row, column = row[use], column[use]
        thresholds = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
        score = np.bincount(row, weights[column], minlength=len(grade))
        below = _sigmoid(thresholds[None, :] - score[:, None])
        edges = np.concatenate([np.zeros((len(grade), 1)), below, np.ones((len(grade), 1))], axis=1)
        slope = edges * (1 - edges)
        at = np.arange(len(grade))
        p = np.maximum(edges[at, grade + 1] - edges[at, grade], 1e-12)
        high, low = slope[at, grade + 1] / p, slope[at, grade] / p
        # d(-log p)/d(score), and by each threshold
        gradient = np.bincount(column, ((high - low) * share)[row], minlength=n)
        by_threshold = np.array([(share * (low * (grade == k + 1) - high * (grade == k))).sum() for k in range(GRADES - 1)])
        by_step = np.cumsum(by_threshold[::-1])[::-1] * np.concatenate([[1.0], np.exp(steps[1:])])
        squares += gradient**2
        step_squares += by_step**2
        pace = rate / np.sqrt(squares)
        moved = weights - pace * gradient
        weights = np.sign(moved) * np.maximum(np.abs(moved) - pace * penalty, 0)
        steps = steps - rate / np.sqrt(step_squares) * by_step
    thresholds = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
    words = np.flatnonzero(weights)
    return OrdinalModel(dict(zip(encoded.dictionary.take(pa.array(words)).to_pylist(), weights[words].tolist())), thresholds)


def severity(spark: SparkSession, model: OrdinalModel, text: Column) -> Column:
    """Struct ``expected_severity, p_toxic, grade`` of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("expected_severity double, p_toxic double, grade int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known, weight = model.weights.keys(), model.weights
        for texts in batches:
            total = np.array([sum(weight[t] for t in sorted(known & tokens_of(text))) for text in texts], float)
            above = 1 - _sigmoid(model.thresholds[None, :] - total[:, None])
            edges = np.concatenate([np.ones((len(total), 1)), above, np.zeros((len(total), 1))], axis=1)
            yield pd.DataFrame(
                {"expected_severity": above.sum(1), "p_toxic": above[:, 0], "grade": (edges[:, :-1] - edges[:, 1:]).argmax(1).astype(np.int32)}
            )

    return score(text)


def grade_toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = 0.25) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, grade, toxic``; toxic where ``P(grade > 0)`` reaches the cutoff.

    At 0.25 a missed toxic document counts as three clean ones that are taken for toxic.
    """
    grades = graded(labels)
    spark = docs.sparkSession
    if grades.isEmpty():
        model = OrdinalModel({}, np.full(GRADES - 1, 30.0))
    else:
        model = fit(sample_of(docs, grades))
    found = docs.select("doc_id", severity(spark, model, F.col("text")).alias("_found"))
    return found.select("doc_id", "_found.*", (F.col("_found.p_toxic") >= cutoff).alias("toxic"))
