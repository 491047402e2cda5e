from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from surveyloom.llm import byte_pairs, repair
from surveyloom.llm.byte_pairs import encoder
from surveyloom.llm.piece_trie import decode_pieces, encode_pieces, model_of
from surveyloom.llm.repair import Shard, compress, read_shards, write_shards
from surveyloom.sources.staging import new_folder
from tests.llm.conftest import ODD_TEXTS

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = st.text(st.sampled_from("abcthe THE  \n\t.,'!é世▁ \x1f\x85<|>#0123"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=5))
def test_pieces_encode_as_the_library_does(texts):
    library = Tokenizer.from_file(BYTES)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder(BYTES).encode(texts) == want


ODD_LETTERS = st.lists(st.sampled_from([*"aé世ß ªº½²’'.,;:!?\n\t\x0b\x1c\x85\xa0\u180e\u2003\u2028\u3000\ufeff\u0301😀#-_()<|>", "<|endoftext|>", "'s", "  "]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD_LETTERS, max_size=5))
def test_white_space_marks_and_special_tokens_encode_as_the_library_does(texts):
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder(BYTES).tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder(BYTES).encode(texts) == want


def test_every_neighbour_of_a_space_or_a_mark_encodes_as_the_library_does():
    library, of = Tokenizer.from_file(BYTES), byte_pairs.PieceEncoder(BYTES)
    points = [chr(c) for c in [*range(0x3100), *range(0xD000, 0xD800), *range(0xE000, 0x10500)]]
    for low in range(0, len(points), 4096):
        texts = [f"{a}{c}{b}" for c in points[low : low + 4096] for a, b in (("a", " b"), ("a ", ", x"), ("!", "\n c"))]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert of.encode(texts) == want


def test_the_library_sees_a_word_once_whatever_stands_around_it(monkeypatch):
    of, given_bytes = byte_pairs.PieceEncoder(BYTES), []
    library = of._encode
    monkeypatch.setattr(of, "_encode", lambda texts: given_bytes.extend(len(t.encode()) for t in texts) or library(texts))
    words = [f"w{a}o{b}rdé" for a in "abcdefgh" for b in "abcdefgh"]
    texts = [f"{around.join(words)}  {around.join(reversed(words))}" for around in (" ", ", ", "; ", "! ", ".\n ", "  ")] * 20
    assert of.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in of.tokenizer.encode_batch(texts, add_special_tokens=False)]
    # With one space, two spaces, a line break or at the start of a text: four forms of a word, beside a few marks.
    assert sum(given_bytes) < 5 * sum(len(w.encode()) + 3 for w in words)


def test_long_pieces_are_not_remembered():
    of = byte_pairs.PieceEncoder(BYTES)
    texts = [f"{i}{'世' * 5000} and a word" for i in range(20)]
    for _ in range(3):
        assert of.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in of.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert sorted(of.known) == [" a", " and", " word"] and len(of.flat) == of.n.sum() == 3


def test_other_ways_to_cut_words_get_whole_texts(tmp_path):
    library = Tokenizer.from_file(BYTES)
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    library.save(str(tmp_path / "prefix.json"))
    texts = ["the word, the word", "", " the  word\n", "the"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert byte_pairs.PieceEncoder(str(tmp_path / "prefix.json")).encode(texts) == want


def test_portions_hold_all_rows_and_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(byte_pairs, "BYTES_AT_ONCE", 10)
    texts = pa.array(["", None, "aaaa", "é" * 20, None, "b", "c" * 9, "d", None])
    found = byte_pairs.portions(texts)
    assert [i for low, high in found for i in range(low, high)] == list(range(len(texts)))
    sizes = [[len((t or "").encode()) for t in texts.slice(low, high - low).to_pylist()] for low, high in found]
    assert all(sum(s) - max(s) <= 10 for s in sizes) and len(found) > 2
    assert byte_pairs.portions(texts.slice(0, 0)) == []


def shard_of(documents, base=50):
    doc_tokens = np.array([len(d) for d in documents])
    tokens = np.array([t for d in documents for t in d], np.uint32)
    rules, lengths, symbols, doc_symbols = compress(tokens, doc_tokens, base)
    n = len(documents)
    return tokens, Shard(np.arange(n), np.zeros(n, np.uint8), doc_symbols, doc_tokens, base, rules, lengths, symbols)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=12), st.data())
def test_grammar_round_trip_and_random_access(documents, data):
    tokens, shard = shard_of(documents * 3)
    again = Shard.from_bytes(shard.to_bytes())
    assert again.tokens().tolist() == tokens.tolist()
    a = data.draw(st.integers(0, len(tokens)))
    b = data.draw(st.integers(a, len(tokens)))
    assert again.tokens(a, b).tolist() == tokens[a:b].tolist()
    assert again.doc_symbols.sum() == len(again.symbols)


def test_grammar_compresses_repeats_and_never_crosses_documents():
    tokens, shard = shard_of([[1, 2, 3, 4]] * 500)
    assert len(shard.symbols) == 500 and shard.doc_symbols.tolist() == [1] * 500
    assert shard.lengths.max() == 4


def test_wide_symbols():
    tokens, shard = shard_of([[70_000, 70_001] * 20] * 3, base=70_002)
    assert Shard.from_bytes(shard.to_bytes()).tokens().tolist() == tokens.tolist()


def files_and_rows(spark, docs):
    folder = new_folder(spark, "test-shards")
    files = write_shards(docs, folder, BYTES, 2)
    return files.collect(), sorted(read_shards(spark, folder, files).collect(), key=lambda r: r.start)


def test_token_files_of_odd_documents(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(repair, "TOKENS_PER_SHARD", 64)
    files, rows = files_and_rows(spark, odd_docs)
    library = Tokenizer.from_file(BYTES)
    texts = odd_docs.select("doc_id", "text").collect()
    want = sorted((str(t.doc_id), len(i := library.encode(t.text or "", add_special_tokens=False).ids + [2]), zlib.crc32(np.array(i, "<u4").tobytes())) for t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert sum(f.n_docs for f in files) == len(texts)


def test_token_files_of_nothing(spark, no_docs):
    assert files_and_rows(spark, no_docs) == ([], [])


def test_query_reads_back_what_the_library_gives(spark, small_docs):
    from surveyloom.llm.queries import op2_repair_token_files
    from tests.llm.conftest import SF

    rows = sorted(op2_repair_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    library, start = Tokenizer.from_file(BYTES), 0
    for doc, row in zip(sorted(small_docs.collect(), key=lambda d: d.doc_id), rows, strict=True):
        ids = library.encode(doc.text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@settings(max_examples=300, deadline=None)
@given(LETTERS | st.text(max_size=40))
def test_trie_gives_the_ids_of_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = library.encode(text)
    assert np.frombuffer(model_of(PIECES).encode([text])[0], "<i4").tolist() == want
    assert model_of(PIECES).decode(want) == library.decode(want) == text.replace("▁", " ")


def test_pieces_of_odd_documents(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = odd_docs.select("text", encode_pieces(F.col("text"), PIECES).alias("ids")).withColumn("back", decode_pieces(F.col("ids"), PIECES)).collect()
    assert len(rows) == len(ODD_TEXTS) + 4
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.back == (r.text or "").replace("▁", " ")
    assert no_docs.select(encode_pieces(F.col("text"), PIECES)).collect() == []


def test_piece_query(spark, small_docs):
    from surveyloom.llm.queries import op3_piece_trie_round_trip
    from tests.llm.conftest import SF

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r.doc_id: r for r in op3_piece_trie_round_trip(spark, SF).collect()}
    for doc in small_docs.collect():
        assert rows[doc.doc_id].ids == library.encode(doc.text or "") and rows[doc.doc_id].round_trip
