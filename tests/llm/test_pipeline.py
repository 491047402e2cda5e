from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_text import brute_lines, components, simhash, xxhash64

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out, written and read as in a run."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_stage_order_and_columns(stages):
    assert [s[0] for s in stages] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "SentencePiece"]
    assert all(columns == COLUMNS for *_, columns in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    _, before, after, _ = stages[0]
    kept = {r.doc_id for r in after}
    assert Counter(after) == Counter(r for r in before if r.doc_id in kept)
    gone = [r for r in before if r.doc_id not in kept]
    assert len(gone) <= 0.01 * len(before) + sum(not any(map(str.isalpha, r.text or "")) for r in before)


def test_line_stage_matches_brute_force(stages):
    _, before, after, _ = stages[1]
    dropped = brute_lines([(r.doc_id, r.text) for r in before])
    want = {}
    for r in before:
        gone = dropped[(True, r.doc_id, xxhash64(r.text))]
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone)
        if not gone or text.strip(" \t\n\x0b\f\r"):
            want[r.doc_id] = (text, len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in after} == want


def test_simhash_stage_keeps_the_first_of_each_group(stages):
    _, before, after, _ = stages[2]
    first = components([(r.doc_id, r.text) for r in before], [simhash(r.text) for r in before])
    assert Counter(after) == Counter(r for r in before if first[r.doc_id] == r.doc_id)


def test_mixing_stage_keeps_every_document(stages):
    _, before, after, _ = stages[3]
    assert set(before) == set(after)
    # Sources of one block each have equal weights, so nothing is repeated.
    assert Counter(after) == Counter(before)


def test_last_stage_has_the_ids_of_the_library(stages):
    _, before, after, _ = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before}
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.round_trip and r.text == texts[r.doc_id] for r in after)


def test_run_is_the_stages_in_turn(spark, stages):
    key = lambda r: (r.doc_id, tuple(r.ids), r.lang, r.source)
    assert Counter(map(key, corpus_pipeline.run(spark, SF).collect())) == Counter(map(key, stages[-1][2]))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, stage):
    odd = odd_docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")
    rows = stage(spark, odd, SF).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in odd.collect()} and rows
    assert stage(spark, no_docs, SF).collect() == []
