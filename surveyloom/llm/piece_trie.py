"""SentencePiece encoding with one Viterbi pass over a trie of the distinct marked words.

A BPE model has one right segmentation, the one its merges lead to. A sequence of
pieces is that segmentation exactly if each piece and each pair of neighbours is what
the merges make of its own text. So a Viterbi pass in which a transition between two
pieces that merges would not leave side by side scores minus infinity reaches
every prefix of a word over one path only, and the last piece of that path is all the
state that a longer word needs. (Summing the piece scores of a BPE model, as for a
unigram model, would give other ids than the library.)

Texts are cut before each white-space mark; no piece goes across such a cut. The
distinct marked words of a batch are sorted, which is the depth-first order of their
trie: a word keeps the states of the prefix it shares with the word before and adds
only the rest. Words of earlier batches are remembered up to a bound. Runs of several
marks, whose merges have equal scores, are left to the library itself.

Decoding joins the bytes of the pieces, byte pieces included, and turns marks to spaces.

Rules for odd input: NULL text encodes to an empty list and decodes to the empty text;
a character that is in no piece becomes byte pieces; the mark character itself in a
text reads as a space, as in the library; texts and words of any length are worked on
whole; repeated rows are encoded each; other columns are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# Words and pairs that a worker remembers; beyond this it forgets all and starts anew.
WORDS_KEPT = 200_000
PAIRS_KEPT = 300_000
TEXTS_AT_ONCE = 1000
TEXTS_HANDED_ON = 500


class PieceModel:
    """A SentencePiece BPE model with an identity normalizer, read from its public file."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model, n = self.library, self.library.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {piece: model.get_score(i) for piece, i in self.ids.items()}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece goes across a white-space mark")
        self.byte_id = {}
        self.bytes_of = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(b"" if special[i] else piece.replace(MARK, " ").encode())
        # Finds every piece that ends at a character, with its id; longer pieces come first.
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.matcher.add_word(piece, i)
        self.matcher.make_automaton()
        self.longest = max(map(len, self.ids))
        self.piece_of = [model.id_to_piece(i) for i in range(n)] + [""]
        self.nothing = n
        self.words: dict[str, bytes] = {}
        self.side_by_side: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merges leave two pieces side by side; after nothing, whether they can make the piece at all."""
        if len(self.side_by_side) > PAIRS_KEPT:
            self.side_by_side.clear()
        pair = [p for p in (self.piece_of[left], self.piece_of[right]) if p]
        known = self.side_by_side[left << 32 | right] = self.merged("".join(pair)) == pair
        return known

    def _learn(self, words: list[str]) -> None:
        """Depth-first over the trie of the words; ``last[i]`` is the last piece of the path to the prefix of length i.

        A character that is in no piece takes part in no merge; the path goes over it
        and what follows stands as after nothing.
        """
        matches, known_pairs, may_follow, nothing = self.matcher.iter, self.side_by_side, self.may_follow, self.nothing
        sizes = [len(p) for p in self.piece_of]
        reach = self.longest - 1
        previous, last = "", [nothing]
        for word in sorted(words):
            done, most = 0, min(len(previous), len(word))
            while done < most and previous[done] == word[done]:
                done += 1
            del last[done + 1 :]
            previous = word
            for at, piece in matches(word, max(0, done - reach)):
                if at < done:
                    continue
                while done < at:
                    last.append(nothing)
                    done += 1
                before = last[at + 1 - sizes[piece]]
                fits = known_pairs.get(before << 32 | piece)
                if fits or (fits is None and may_follow(before, piece)):
                    last.append(piece)
                    done += 1
            end = len(word)
            while done < end:
                last.append(nothing)
                done += 1
            path: list[int] = []
            while end:
                piece = last[end]
                if piece == nothing:
                    path += [self.byte_id[b] for b in reversed(word[end - 1].encode("utf-8", "surrogatepass"))]
                    end -= 1
                else:
                    path.append(piece)
                    end -= sizes[piece]
            self.words[word] = array("i", path[::-1]).tobytes()

    def _several_marks(self, word: str) -> bytes:
        # The library puts one mark in front of what it is given.
        return np.array(self.library.encode(word[1:].replace(MARK, " ")), "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif MARK in text or "  " in text or text[0] == " ":
                cut.append(WORD.findall(MARK + text.replace(" ", MARK)))
            else:
                cut.append([MARK + w for w in text.split(" ")])
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        wanted: set[str] = set()
        for words in cut:
            wanted.update(words)
        new = [w for w in wanted if w not in self.words]
        self._learn([w for w in new if not w.startswith(MARK * 2)])
        for w in new:
            if w.startswith(MARK * 2):
                self.words[w] = self._several_marks(w)
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in cut]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """The model of a file, made once in each Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _list_array(encoded: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_documents(docs: DataFrame, model_file: str, decoded: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``ids``, ``n_pieces`` and ``round_trip``: whether the ids decode to the text.

    With ``decoded``, ``text`` is what the ids decode to. One Python worker encodes and
    decodes, and hands on some hundred documents at a time, whatever comes in.
    """
    results = {"ids": T.ArrayType(T.IntegerType()), "n_pieces": T.IntegerType(), "round_trip": T.BooleanType()}
    if decoded:
        results["text"] = T.StringType()
    kept = [c for c in docs.columns if c not in results and c != "text"]
    shape = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, kind) for n, kind in results.items())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_HANDED_ON):
                some = batch.slice(low, TEXTS_HANDED_ON)
                texts = [t or "" for t in some[len(kept)].to_pylist()]
                encoded = model.encode(texts)
                back = [model.decode(np.frombuffer(e, "<i4").tolist()) for e in encoded]
                same = [a == b.replace(MARK, " ") for a, b in zip(back, texts)]
                columns = [some[i] for i in range(len(kept))]
                columns += [_list_array(encoded), pa.array([len(e) // 4 for e in encoded], pa.int32()), pa.array(same)]
                columns += [pa.array(back, pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *results])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias("_text")).mapInArrow(encode, shape)


def encode_pieces(text: Column, model_file: str) -> Column:
    """Piece ids of a text column."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(model_file)
        for batch in batches:
            encoded: list[bytes] = []
            for low in range(0, len(batch), TEXTS_AT_ONCE):
                encoded += model.encode([t or "" for t in batch.slice(low, TEXTS_AT_ONCE).to_pylist()])
            yield _list_array(encoded)

    return encode(text)


def decode_pieces(ids: Column, model_file: str) -> Column:
    """Text of a column of piece ids; NULL stays NULL."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(model_file)
        for batch in batches:
            yield pa.array([None if x is None else model.decode(x) for x in (v.as_py() for v in batch)], pa.string())

    return decode(ids)
