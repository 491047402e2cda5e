from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None,
    "",
    "   ",
    "\n\n",
    "12 + 3 = 15",
    "the same words in the same order once more",
    "the same words in the same order once more",
    "the same words in the same order once more!",
    "One line here.\nAnother line there.\nOne line here.",
    "tab\tand\x0bother\x0cwhite\r\nspace   and ▁ marks  twice ",
    "ÄÖÜ straße ñandú çà 世界 😀 \x00 end",
    "word " * 4000,
    "x" * 30_000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, repeated rows, tied and NULL ids, NULL languages, and columns with clashing names."""
    rows = [(i, t, None if i % 4 == 0 else ("en", "de")[i % 2], None if i % 5 == 0 else f"s{i % 3}", -1, 7, "k") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (5, "another text under a tied id", "en", "s1", -1, 7, "k"), (None, "a text without an id", "en", "s1", -1, 7, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot long, _found long, lang_pred string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()
