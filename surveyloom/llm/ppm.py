"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of length 0 to 3 with the counts of the
bytes that followed them. A text costs, in one language, the sum of
``-log2 P(byte | context)`` over all its bytes: the longest context gives the
probability, a byte it has not seen costs an escape (``distinct / (seen + distinct)``,
method C) and is looked up in the next shorter context without the bytes that were
already ruled out, down to the uniform distribution over what is left of 256 values.
Counts are frozen after training. The language with the shortest code wins.

Training uses about ``docs_per_language`` labelled documents of each language (those
whose hashed ids are small) with their whole texts; the counts are summed by Spark.
The trees are as large as the distinct byte 4-grams of that sample. Every document is
then scored over its whole lower-cased text.

Rules for odd input: NULL text or text without a letter is ``und`` with score 0 and
no code length; ties go to the language that sorts first; repeated rows are scored
each; without labelled documents every text is ``und``. Input columns are kept, but for those
that have the name of a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Values of the hash that samples documents.
HASHES = 1 << 30
RESULTS = ["lang_pred", "score", "bits_per_byte"]
UNKNOWN = "und"
PAD = b"\n\n\n"
# Positions that are scored at a time; bounds the memory of a task whatever the length of a text.
POSITIONS = 1 << 18
# Texts of a batch that are lower-cased and joined at a time.
TEXTS_AT_ONCE = 500


@dataclass
class ContextTrees:
    """Frozen trees of all languages as tables.

    ``symbol`` maps a byte to a small number, ``row`` a triple of symbols to the row of
    its longest known suffix, and ``bits[row, symbol]`` holds the cost in each language.
    """

    languages: list[str]
    symbol: np.ndarray
    row: np.ndarray
    bits: np.ndarray


def _lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            data = np.frombuffer(PAD + _lowered(text), np.uint8).astype(np.int64)
            grams, n = np.unique(((data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})


def sample_of_languages(docs: DataFrame, docs_per_language: int) -> DataFrame:
    """``lang, text`` of about so many documents of each language, or all if there are fewer.

    The share that a language keeps comes from its number of documents; which ones,
    from a hash of their ids. So the sample is a filter of the scan, without a join.
    """
    labelled = docs.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return labelled.select("lang", "text")
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(HASHES * min(1.0, docs_per_language / r["count"]))))])
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < F.element_at(share, F.col("lang"))).select("lang", "text")


def train(docs: DataFrame, docs_per_language: int = 1500) -> ContextTrees | None:
    sample = sample_of_languages(docs, docs_per_language)
    grams = sample.where("text <> ''").mapInPandas(_count_grams, "lang string, gram long, n long")
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return build_trees(counts) if len(counts) else None


def build_trees(counts: pd.DataFrame) -> ContextTrees:
    """Tables from the columns ``lang, gram, n``; a gram is four bytes in one number."""
    languages = sorted(counts["lang"].unique())
    gram = counts["gram"].to_numpy()
    parts = np.stack([(gram >> s) & 255 for s in (24, 16, 8, 0)], axis=1)
    known = np.unique(parts)
    size = len(known) + 1  # the last symbol stands for every byte never seen
    symbol = np.full(256, size - 1, np.int32)
    symbol[known] = np.arange(len(known))
    parts = symbol[parts].astype(np.int64)
    language = np.searchsorted(languages, counts["lang"].to_numpy())
    n = counts["n"].to_numpy(np.float64)
    tables = []
    for order in range(4):
        code = np.zeros(len(parts), np.int64)
        for i in range(3 - order, 3):
            code = code * size + parts[:, i]
        contexts, index = np.unique(code, return_inverse=True)
        seen = np.zeros((len(languages), len(contexts), size))
        np.add.at(seen, (language, index, parts[:, 3]), n)
        tables.append((contexts, seen))
    row, first = None, []
    start = 0
    for order, (contexts, _) in enumerate(tables):
        first.append(start)
        start += len(contexts)
        longer = np.zeros(1, np.int32) if order == 0 else np.tile(row, size).astype(np.int32)
        longer[contexts] = first[order] + np.arange(len(contexts))
        row = longer
    bits = np.empty((start, size, len(languages)), np.float32)
    for k in range(len(languages)):
        for order, (contexts, _) in enumerate(tables):
            cost = _code_lengths(tables, k, order, contexts, size)
            bits[first[order] : first[order] + len(contexts), :, k] = cost
    return ContextTrees(list(languages), symbol, row, bits.reshape(-1, len(languages)))


def _code_lengths(tables: list, language: int, order: int, contexts: np.ndarray, size: int) -> np.ndarray:
    """``-log2 P`` of every symbol after every context of one order, exclusions included."""
    cost = np.zeros((len(contexts), size))
    left = np.ones((len(contexts), size), bool)
    for k in range(order, -1, -1):
        known, seen = tables[k]
        at = np.searchsorted(known, contexts % size**k)
        count = np.where(left, seen[language][at], 0.0)
        total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        here = count > 0
        all_of_it = np.log2(np.maximum(total + distinct, 1))
        cost = np.where(here, cost + all_of_it - np.log2(np.maximum(count, 1)), cost)
        escape = np.where(total > 0, all_of_it - np.log2(np.maximum(distinct, 1)), 0.0)
        left &= ~here
        cost = np.where(left, cost + escape, cost)
    # The symbol of unseen bytes is one of the byte values that are left.
    values = np.maximum(256 - (size - left.sum(1, keepdims=True)), 1)
    return np.where(left, cost + np.log2(values), cost)


def code_lengths(trees: ContextTrees, texts: list[bytes]) -> np.ndarray:
    """Bits of every whole text in every language."""
    size = int(trees.symbol.max()) + 1
    out = np.zeros((len(texts), len(trees.languages)))
    stream, starts = PAD.join([b"", *texts]), []
    at = 0
    for t in texts:
        at += len(PAD)
        starts.append(at)
        at += len(t)
    data = np.frombuffer(stream, np.uint8)
    edges = np.array([x for s, t in zip(starts, texts) for x in (s, s + len(t))], np.int64)
    for low in range(len(PAD), len(data), POSITIONS):
        high = min(low + POSITIONS, len(data))
        s = trees.symbol[data[low - 3 : high]]
        rows = trees.row[(s[:-3] * size + s[1:-2]) * size + s[2:-1]]
        cost = trees.bits[rows * size + s[3:]]
        running = np.zeros((high - low + 1, out.shape[1]))
        np.cumsum(cost, axis=0, dtype=np.float64, out=running[1:])
        inside = np.clip(edges, low, high) - low
        out += running[inside[1::2]] - running[inside[::2]]
    return out


def identify(spark: SparkSession, trees: ContextTrees | None, text: Column) -> Column:
    """Struct ``lang_pred, score, bits_per_byte`` of a text column.

    The score is the share of the winner in ``sum(2^-bits)`` over all languages.
    """
    if trees is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        names = np.array(trees.languages, object)
        for texts in batches:
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            bits = np.zeros((len(texts), len(names)))
            length = np.ones(len(texts))
            for low in range(0, len(texts), TEXTS_AT_ONCE):
                part = slice(low, low + TEXTS_AT_ONCE)
                data = [_lowered(t) if ok else b"" for t, ok in zip(texts.iloc[part], lettered[part])]
                bits[part] = code_lengths(trees, data)
                length[part] = np.maximum([len(d) for d in data], 1)
            best = bits.argmin(1)
            shortest = bits.min(1)
            share = 1.0 / np.exp2(shortest[:, None] - bits).sum(1)
            yield pd.DataFrame(
                {
                    "lang_pred": np.where(lettered, names[best], UNKNOWN),
                    "score": np.where(lettered, share, 0.0),
                    "bits_per_byte": pd.Series(np.where(lettered, shortest / length, np.nan)).astype(object).where(lettered, None),
                }
            )

    return score(text)


def predict_languages(docs: DataFrame, learners: Column, docs_per_language: int = 1500) -> DataFrame:
    """``docs`` with ``lang_pred, score, bits_per_byte``; trees are learned from rows where ``learners`` holds."""
    trees = train(docs.where(learners), docs_per_language)
    found = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)], identify(docs.sparkSession, trees, F.col("text")).alias("found"))
    kept = [F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in RESULTS]
    return found.select(*kept, *[F.col(f"found.{c}").alias(c) for c in RESULTS])


def in_fold_one(doc_id: Column) -> Column:
    """The held-out third: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
