"""Importance resampling, neighbour votes and phrases, against plain versions and SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import neighbour_votes
from surveyloom.llm.importance import collapsed, resample, scanner
from surveyloom.llm.neighbour_votes import bag_of, in_fold_zero, vote_quality
from surveyloom.llm.phrases import collocations, frequent_bitmap, may_be_frequent, run_hashes
from surveyloom.llm.queries import QUERIES, SQL
from tests.check_queries import compare, connect
from tests.llm.conftest import SF

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_overlapped_scan_resampling", "op13_phrase_streams"])
def test_query_matches_sql(spark, name):
    assert [d for d in compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) if d != "no rows"] == []


# -- importance resampling ----------------------------------------------------------


def test_scan_emits_overlapping_runs_at_word_boundaries():
    line = collapsed("Ab  c-d\tÉé 世界 x".encode())
    assert line == "ab c d Éé 世界 x".encode()
    for n in (1, 2, 3):
        words = line.split(b" ")
        want = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        assert [m[0] for m in scanner(n).finditer(line, overlapped=True)] == want


def _plain_resample(docs, target, sizes, buckets, least_words, percent, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
        grams = [" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for _, x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    eligible = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for place, row in enumerate(eligible[: percent * len(eligible) // 100], 1):
        row[5] = place
    return rows


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("sizes", [range(1, 2), range(1, 4), range(2, 3)])
def test_resample_equals_plain_version_on_odd_documents(spark, odd_docs, sizes):
    target = spark.createDataFrame([(0, "the same words in order", 1), (1, None, 2), (2, "", 3)], "item_id long, text string, n_words long")
    got = [list(r) for r in resample(odd_docs, target, sizes, 97, 3, 60, 5).collect()]
    plain = _plain_resample(
        [(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in target.collect()], sizes, 97, 3, 60, 5
    )
    # Repeated rows share their place among themselves in any order.
    assert _sorted(got) == _sorted(plain)


def test_resample_of_empty_tables(spark, no_docs, odd_docs):
    target = spark.createDataFrame([], "item_id long, text string")
    assert resample(no_docs, odd_docs).collect() == []
    assert resample(odd_docs, target).count() == odd_docs.count()


def test_repeated_rows_are_all_ranked(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    got = resample(docs, docs, least_words=1, percent=50).agg(F.count("rank"), F.count_distinct("rank"), F.max("rank")).first()
    assert tuple(got) == (1500, 1500, 1500)


# -- neighbour votes ----------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op12_neighbour_votes"](spark, sf)
    judged = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = {r["quality"]: r["right"] for r in judged.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect()}
    assert right[1] >= 0.98 and right[0] >= 0.75
    whole = found.agg(F.count("*"), F.min("score"), F.max("score"), F.count("held_out")).first()
    assert whole[0] == whole[3] == 1000 and whole[1] >= 0 and whole[2] <= 1


def test_scores_equal_plain_votes(spark, small_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~in_fold_zero(F.col("doc_id")))
    model = neighbour_votes.fit(small_docs.select("doc_id", "text"), labels.select("doc_id", "quality"), 60, axes=8)
    assert len(model.labels) <= 60 and model.axes.shape[1] == 8
    got = {r["doc_id"]: r["score"] for r in vote_quality(small_docs, labels, sample_rows=60, axes=8).collect()}
    for row in small_docs.limit(40).collect():
        vector = np.zeros(8)
        for token, n in bag_of(row["text"].encode()).items():
            if token in model.terms:
                vector += math.log(1 + n) * model.idf[model.terms[token]] * model.axes[model.terms[token]]
        vector /= math.sqrt((vector**2).sum()) or 1.0
        cosine = [round(float(sum(a * b for a, b in zip(vector, v))), neighbour_votes.DIGITS) for v in model.vectors]
        last = sorted(cosine, reverse=True)[min(15, len(cosine)) - 1]
        power = [(max(c, 0.0) * w, y) for c, w, y in zip(cosine, model.weights, model.labels) if c >= last]
        whole = sum(p for p, _ in power)
        want = sum(p * y for p, y in power) / whole if whole else model.share
        assert got[row["doc_id"]] == pytest.approx(want, abs=1e-4)


def test_axes_are_the_leading_singular_vectors():
    table = np.random.default_rng(1).standard_normal((50, 30)).astype(np.float32) @ np.diag(0.5 ** np.arange(30)).astype(np.float32)
    _, _, v = np.linalg.svd(table, full_matrices=False)
    assert np.abs(np.abs((neighbour_votes.leading_axes(table, 5) * v[:5].T).sum(axis=0)) - 1).max() < 1e-3


def test_votes_on_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, "x"), (5, 0, "x"), (6, 1, "x"), (8, 1, "x"), (11, None, "x"), (None, 1, "x"), (99, 0, "x")], "doc_id long, quality int, text string")
    got = vote_quality(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert vote_quality(no_docs, labels).collect() == []
    assert {r["score"] for r in vote_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in vote_quality(odd_docs, labels.where("doc_id = 6")).collect()} == {1.0}


def test_a_sampled_id_with_many_rows_is_one_text(spark):
    docs = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert neighbour_votes.sample_of(docs, labels, 10).count() == 1


# -- phrases ------------------------------------------------------------------------


def _plain_phrases(docs, longest, least, absorbed, limit):
    counts, words = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            run = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(run)
            for n in range(1, longest + 1):
                for i in range(len(run) - n + 1):
                    counts[lang or "und", tuple(run[i : i + n])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    rows = {}
    for (lang, phrase), a in found.items():
        inside = [f for (other, longer), f in found.items() if other == lang and len(longer) > len(phrase) and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))]
        if any(100 * f >= absorbed * a for f in inside):
            continue
        cuts = [(2000000 * a // (counts[lang, phrase[:k]] + counts[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), counts[lang, phrase[:k]], counts[lang, phrase[k:]]))
    return sorted(
        (lang, place, p.decode(), -a, left, right, words[lang], -score)
        for lang, some in rows.items()
        for place, (score, a, p, left, right) in enumerate(sorted(some)[:limit], 1)
    )


@pytest.mark.parametrize("longest, least, absorbed", [(4, 2, 80), (3, 1, 50), (5, 3, 101), (2, 2, 80)])
def test_phrases_equal_plain_version(odd_docs, longest, least, absorbed):
    got = sorted(tuple(r) for r in collocations(odd_docs, longest, least, absorbed, 50).collect())
    assert got == _plain_phrases([(r.lang, r.text) for r in odd_docs.collect()], longest, least, absorbed, 50)


def test_phrases_of_whole_small_documents(small_docs):
    some = small_docs.where("doc_id < 60")
    got = sorted(tuple(r) for r in collocations(some, 4, 4).collect())
    assert got == _plain_phrases([(r.lang, r.text) for r in some.collect()], 4, 4, 80, 2000) and got


def test_phrases_of_an_empty_table(no_docs):
    assert collocations(no_docs).collect() == []


def test_every_frequent_run_passes_the_bitmap(spark):
    rows = [("en", f"w{i} v{i}") for i in range(3000)]
    bitmap = frequent_bitmap(spark.createDataFrame(rows, "lang string, phrase string"))
    xx = lambda words: np.array([__import__("xxhash").xxh64_intdigest(w.encode()) for w in words], np.uint64)
    lang = xx(["en"] * 3000)
    ok = may_be_frequent(bitmap, run_hashes([xx([f"w{i}" for i in range(3000)]), xx([f"v{i}" for i in range(3000)])], lang))
    other = may_be_frequent(bitmap, run_hashes([xx([f"v{i}" for i in range(3000)]), xx([f"w{i}" for i in range(3000)])], lang))
    assert ok.all() and other.sum() < 3
