from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from surveyloom.llm import cells, ordinal, ppm
from surveyloom.llm.line_templates import drop_recurring_lines
from surveyloom.llm.queries import op6_ordinal_toxicity, op9_ppm_language_id, op10_line_templates
from surveyloom.llm.simhash import manhattan, near_duplicates, segment_counts
from tests.llm.conftest import ODD_TEXTS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, prints):
    ids = [i for i, _ in docs]
    component = {i: i for i in ids}
    values = np.array(prints, np.uint64)
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 4)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(component[a], component[b])
            for x in (a, b):
                if component[x] != low:
                    component[x], changed = low, True
    return component


def check_simhash(got, docs):
    prints = [simhash(t) for _, t in docs]
    known = [(d, p) for d, p in zip(docs, prints) if d[0] is not None]
    want = components([d for d, _ in known], [p for _, p in known])
    expected = Counter((i, f"{p:016x}", want.get(i)) for (i, _), p in zip(docs, prints))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected


def test_near_duplicates_match_brute_force(spark, small_docs):
    docs = [(r.doc_id, r.text) for r in small_docs.collect()]
    check_simhash(near_duplicates(small_docs).collect(), docs)


def test_near_duplicates_of_odd_documents(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == len(ODD_TEXTS) + 4
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.component_id)
    # Rows that share an id share its components' smallest id, or are one document with several texts.
    assert by_id[0] == by_id[1] == by_id[2] == by_id[3] == {0} and by_id[None] == {None} and 5 in by_id[6]
    assert near_duplicates(no_docs).collect() == []


def test_large_group_of_near_copies_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS_PER_BLOCK", 5)
    base = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join([*base[:i], f"changed{i}", *base[i + 1 :]])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check_simhash(near_duplicates(df).collect(), docs)


@pytest.mark.parametrize("groups", [5, 7, 10])
def test_any_number_of_axis_groups_finds_the_same(spark, small_docs, groups):
    docs = [(r.doc_id, r.text) for r in small_docs.limit(80).collect()]
    check_simhash(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), axis_groups=groups).collect(), docs)


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = a ^ (rng.integers(0, 2**63, 2000).astype(np.uint64) & rng.integers(0, 2**63, 2000).astype(np.uint64))
    fields = lambda x: np.array([[(int(v) >> 2 * i & 1) + (int(v) >> 2 * i + 1 & 1) for i in range(32)] for v in x])
    want = np.abs(fields(a) - fields(b)).sum(1)
    got = manhattan(segment_counts(a), segment_counts(b))
    assert (got == want).all() and (got <= np.bitwise_count(a ^ b)).all()


def slow_code_length(counts, text):
    """Bits of a text under one language's counts, straight from the definition."""
    bits = 0.0
    data = ppm.PAD + text
    values = {g[-1] for table in counts.values() for g in table}
    for at in range(3, len(data)):
        ruled_out, symbol = set(), data[at]
        for order in (3, 2, 1, 0):
            context = data[at - order : at]
            seen = Counter()
            for lang_counts in [counts["own"]]:
                for gram, n in lang_counts.items():
                    if gram[3 - order : 3] == context and gram[3] not in ruled_out:
                        seen[gram[3]] += n
            total, distinct = sum(seen.values()), len(seen)
            if symbol in seen:
                bits += np.log2(total + distinct) - np.log2(seen[symbol])
                break
            if total:
                bits += np.log2(total + distinct) - np.log2(distinct)
            ruled_out |= set(seen)
        else:
            bits += np.log2(256 - len(ruled_out))
    return bits, values


def test_code_lengths_follow_the_definition():
    import pandas as pd

    texts = {"aa": [b"abracadabra", b"abba baab"], "bb": [b"xyzzy plugh", b"xxyz zyx"]}
    grams = {k: Counter(d[i : i + 4] for t in v for d in [ppm.PAD + t] for i in range(len(d) - 3)) for k, v in texts.items()}
    rows = [(k, int.from_bytes(g, "big"), n) for k, c in grams.items() for g, n in c.items()]
    trees = ppm.build_trees(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    samples = [b"abra", b"zyx xyz", b"", b"\xff\x00ab", b"b"]
    got = ppm.code_lengths(trees, samples)
    for k, lang in enumerate(trees.languages):
        for i, s in enumerate(samples):
            assert got[i, k] == pytest.approx(slow_code_length({"own": grams[lang]}, s)[0], abs=1e-3)


def test_scoring_in_short_windows_gives_the_same(monkeypatch):
    import pandas as pd

    text = b"abracadabra alakazam " * 20
    grams = Counter((ppm.PAD + text)[i : i + 4] for i in range(len(text)))
    trees = ppm.build_trees(pd.DataFrame([("aa", int.from_bytes(g, "big"), n) for g, n in grams.items()], columns=["lang", "gram", "n"]))
    whole = ppm.code_lengths(trees, [text, b"", b"abra"])
    monkeypatch.setattr(ppm, "POSITIONS", 7)
    assert np.allclose(ppm.code_lengths(trees, [text, b"", b"abra"]), whole)


def test_languages_of_held_out_documents(spark):
    rows = op9_ppm_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    held = rows.where("held_out").collect()
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_languages_of_odd_documents(spark, odd_docs, no_docs):
    found = ppm.predict_languages(odd_docs, F.lit(True)).collect()
    assert len(found) == len(ODD_TEXTS) + 4
    for r in found:
        lettered = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred in ("en", "de")) == lettered and (r.score > 0) == lettered and (r.bits_per_byte is not None) == lettered
    assert ppm.predict_languages(no_docs, F.lit(True)).collect() == []
    assert {r.lang_pred for r in ppm.predict_languages(odd_docs, F.lit(False)).collect()} == {"und"}


def tokens(line):
    return [("<*>" if re.search("[0-9]", t) else t) for t in re.findall(r"[^ \t\n\x0b\f\r]+", line)]


def brute_lines(docs, depth=3, similarity=0.75):
    """Lines that share a template, by definition: all choices of equal fields of the lines of a leaf."""
    groups = defaultdict(set)
    for doc_id, text in docs:
        for place, line in enumerate((text or "").split("\n")):
            here = (doc_id is not None, doc_id or 0, xxhash64(text), place)
            t, raw = tokens(line), tuple(re.findall(r"[^ \t\n\x0b\f\r]+", line))
            constant = [x for x in t if x != "<*>"]
            if 2 * len(constant) < len(t) or len("".join(constant)) < 8:
                if len(raw) >= 3 or len("".join(raw)) >= 8:
                    groups["as it stands", raw].add(here)
                continue
            groups["whole", tuple(t)].add(here)
            if len(t) < 5:
                continue
            n = min(len(t), 8)
            fields = [tuple(t[i * len(t) // 8 : (i + 1) * len(t) // 8]) for i in range(8)] if n == 8 else t
            leaf = (len(t), *t[: depth if n == 8 else 2])
            for some in combinations(range(n), -int(-similarity * n // 1)):
                groups[leaf, some, tuple(fields[i] for i in some)].add(here)
    dropped = defaultdict(set)
    for seen in groups.values():
        if len({s[:3] for s in seen}) > 1:
            for s in seen - {min(seen)}:
                dropped[s[:3]].add(s[3])
    return dropped


def xxhash64(text):
    return int(np.array([xxhash.xxh64_intdigest(text.encode(), 42)], np.uint64).view(np.int64)[0])


def check_lines(df, got):
    docs = [(r.doc_id, r.text) for r in df.collect()]
    dropped = brute_lines([d for d in docs if d[1] is not None])
    want = Counter()
    for doc_id, text in docs:
        gone = dropped[(doc_id is not None, doc_id or 0, xxhash64(text))] if text is not None else set()
        lines = text.split("\n") if text is not None else []
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want[doc_id, text if not gone else kept, len(lines), tuple(sorted(gone))] += 1
    assert Counter((r.doc_id, r.text, r.n_lines, tuple(r.dropped)) for r in got) == want


def test_line_dedup_matches_brute_force(spark, small_docs):
    check_lines(small_docs, op10_line_templates(spark, SF).collect())


def test_variable_fields_and_first_documents(spark):
    docs = [
        (1, "Page 12 of 90 printed today\nonly in one"),
        (2, "kept words here\nPage 3 of 7 printed today"),
        (3, "user alice logged in from the office network this morning"),
        (4, "user alice logged in from the branch network this morning"),
        (5, "a b\nx y"),
        (6, "a b\nx y"),
        (7, "same line in itself\nsame line in itself"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_recurring_lines(df).collect()}
    assert got == {1: docs[0][1], 2: "kept words here", 3: docs[2][1], 4: "", 5: "a b\nx y", 6: "a b\nx y", 7: docs[6][1]}


@pytest.mark.parametrize(
    "texts, left",
    [
        # Numbers alone are no template; equal rows of numbers are.
        (["1.5 2.5 3.5", "7.1 8.2 9.3", "2020-01-01 5% 17", "7.1 8.2 9.3"], ["1.5 2.5 3.5", "7.1 8.2 9.3", "2020-01-01 5% 17", ""]),
        (["Total 5 6 7", "Total 8 9 10"], ["Total 5 6 7", "Total 8 9 10"]),
        # One foreign line of the same leaf changes nothing.
        (
            [f"Posted on the board by user {x}? in category news today" for x in ("ann", "bob", "cy", "dee", "eve", "flo")]
            + ["Posted on the wall of an old house near the market"],
            ["Posted on the board by user ann? in category news today"] + [""] * 5 + ["Posted on the wall of an old house near the market"],
        ),
        # Short footers, whole lines of one token, short lines with one variable token.
        (["Read more", "Read more", "Yes.", "Yes."], ["Read more", "", "Yes.", "Yes."]),
        (["人人生而自由在尊严和权利上一律平等", "人人生而自由在尊严和权利上一律平等"], ["人人生而自由在尊严和权利上一律平等", ""]),
        (["Posted by alice in news", "Posted by bob in news", "Posted at noon in winter"], ["Posted by alice in news", "", "Posted at noon in winter"]),
    ],
)
def test_templates_of_lines(spark, texts, left):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_recurring_lines(df).collect()}
    assert [got[i] for i in range(len(texts))] == left
    check_lines(df, drop_recurring_lines(df).collect())


def test_a_template_with_most_lines_is_split(spark):
    """One leaf with all lines and one template with most of them."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("the same words in all of these lines but "), F.chr(97 + F.col("id") % 26), F.lit("b")))
                                  .otherwise(F.concat_ws(" ", F.lit("the same words"), *[F.concat(F.chr(97 + F.shiftright("id", k) % 26), F.lit("x")) for k in range(7)])).alias("text"))
    df = df.withColumnRenamed("id", "doc_id")
    check_lines(df, drop_recurring_lines(df).collect())


def test_lines_of_odd_documents(spark, odd_docs, no_docs):
    check_lines(odd_docs, drop_recurring_lines(odd_docs).collect())
    assert drop_recurring_lines(no_docs).collect() == []
    assert drop_recurring_lines(odd_docs).columns[:2] == ["doc_id", "lang"]


def test_a_very_long_token_is_cut_in_linear_time(spark):
    df = spark.createDataFrame([(1, "x" * 2_000_000 + " three tokens"), (2, "9" * 2_000_000 + " three tokens")], "doc_id long, text string")
    assert [r.n_dropped for r in drop_recurring_lines(df).collect()] == [0, 0]


def test_severity_finds_toxic_documents_and_leaves_clean_ones(spark):
    sf = "/root/testdata/sf0.01"
    said = {r.doc_id: r for r in op6_ordinal_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(said) == 1000
    clean = [said[r.doc_id].toxic for r in labels if r.toxic == 0]
    toxic = [said[r.doc_id].toxic for r in labels if r.toxic == 1]
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.7 * len(toxic)
    assert all(0 <= r.expected_severity <= 2 and 0 <= r.grade <= 2 for r in said.values())


def test_ordinal_fit_recovers_ordered_grades():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    grade = rng.integers(0, 3, 900).astype(np.int32)
    lists = [["common", *(["bad"] if g > 0 else []), *(["worse"] if g > 1 else []), f"noise{rng.integers(0, 40)}"] for g in grade]
    sample = pa.table({"grade": pa.array(grade), "weight": pa.array(np.ones(900)), "tokens": pa.array([sorted(x) for x in lists])})
    model = ordinal.fit(sample)
    assert model.thresholds[0] < model.thresholds[1] and model.weights["bad"] > 1 and model.weights["worse"] > 1
    assert all(abs(w) < 1 for t, w in model.weights.items() if t.startswith("noise"))


def test_severity_follows_the_formula(spark, small_docs):
    """Thresholds and token weights give P(grade > k) = 1 - sigmoid(threshold_k - sum of weights)."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = ordinal.fit(ordinal.sample_of(small_docs, ordinal.graded(labels)))
    got = {r.doc_id: r for r in ordinal.grade_toxicity(small_docs, labels).collect()}
    for row in small_docs.collect():
        score = sum(model.weights.get(t, 0.0) for t in set(re.findall(r"[^\W_]+", (row.text or "").lower())))
        above = [1 - 1 / (1 + np.exp(-(t - score))) for t in model.thresholds]
        grades = [1 - above[0], above[0] - above[1], above[1]]
        assert got[row.doc_id].expected_severity == pytest.approx(sum(above), abs=1e-9)
        assert got[row.doc_id].p_toxic == pytest.approx(above[0], abs=1e-9)
        assert grades[got[row.doc_id].grade] == pytest.approx(max(grades), abs=1e-9)


def test_toxicity_reads_no_other_columns(spark, odd_docs):
    labels = spark.createDataFrame([(5, 1, 1), (8, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    clashing = odd_docs.selectExpr("*", "1 as grade", "2D as weight", "'x' as label_id", "0 as toxic")
    key = lambda rows: Counter((r.doc_id, r.expected_severity) for r in rows)
    assert key(ordinal.grade_toxicity(clashing, labels).collect()) == key(ordinal.grade_toxicity(odd_docs, labels).collect())


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 1), (8, 1, 0), (None, 1, 1), (6, 1, None), (9, None, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(ordinal.grade_toxicity(odd_docs, labels).collect()) == len(ODD_TEXTS) + 4
    assert {r.toxic for r in ordinal.grade_toxicity(odd_docs, labels.limit(0)).collect()} == {False}
    assert {r.toxic for r in ordinal.grade_toxicity(odd_docs, labels.where("toxic = 1")).collect()} == {True}
    assert ordinal.grade_toxicity(no_docs, labels).collect() == []
