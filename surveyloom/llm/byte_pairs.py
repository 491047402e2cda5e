"""Fast encoding of many whole texts with a byte-level tokenizer of the tokenizers library.

The library cuts a text into words before it merges bytes. A cut always lies between
a character that is not white space and one that is, and between a letter and a
character that is no letter. So a text may be split at such places, each distinct
piece encoded once by the library, and the ids strung together again. Places are
found on the bytes of a whole Arrow column, distinct pieces by Arrow's dictionaries,
and short pieces are remembered for the texts that follow. Places of doubt (behind letters
that Unicode 3.2 did not know, inside what may be a special token) are not split. With
another way to cut words, texts are given to the library whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Pieces that a worker remembers; beyond this it forgets all and starts anew.
REMEMBERED = 500_000
# Longer pieces, such as a text without any space, are forgotten at once.
LONGEST = 64
# Pieces that are encoded in one call.
AT_ONCE = 2000
# Bytes of text that are split in one go.
BYTES_AT_ONCE = 4 << 20
OTHER, LETTER, SPACE = range(3)
WHITE = "\t\n\x0b\x0c\r "


def _kind(point: int) -> int:
    char, then = chr(point), unicodedata.ucd_3_2_0.category(chr(point))[0]
    if char.isspace() or then == "Z":
        return SPACE
    return LETTER if char.isalpha() and then == "L" else OTHER


def portions(texts: pa.Array) -> list[tuple[int, int]]:
    """First and last (exclusive) row of parts of about ``BYTES_AT_ONCE`` of text."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BYTES_AT_ONCE
    first = np.unique(part, return_index=True)[1].tolist()
    return list(zip(first, [*first[1:], len(texts)]))


def concatenated(flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The parts ``flat[starts[i] : starts[i] + n[i]]``, one behind the other."""
    began = np.cumsum(n) - n
    return flat[np.repeat(starts - began, n) + np.arange(int(n.sum()))]


class PieceEncoder:
    """Texts to ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        settings = json.loads(self.tokenizer.to_str())
        added = settings["added_tokens"]
        words = settings["pre_tokenizer"] or {}
        self.splits = (
            words.get("type") == "ByteLevel"
            and words["use_regex"]
            and not words["add_prefix_space"]
            and not settings["normalizer"]
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        )
        # Bytes that an id stands for: byte-level tokens have one character for each.
        self.n_bytes = np.zeros(self.size, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        for token in added:
            self.n_bytes[token["id"]] = len(token["content"].encode())
        self.kinds = np.array([_kind(i) for i in range(1 << 16)], np.uint8)
        self.white, self.ends_word = np.zeros(256, bool), np.zeros(256, bool)
        self.ends_word[:128] = self.kinds[:128] != LETTER
        for token in added:
            self.ends_word[list(token["content"].encode())] = False
        white = list(WHITE.encode())
        self.white[white] = self.ends_word[white]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.n = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin in the UTF-8 bytes of texts."""
        start = np.zeros(len(raw) + 1, bool)
        start[offsets] = True
        if self.splits:
            at = np.flatnonzero(self.ends_word[raw])
            at = at[at > 0]
            before = raw[at - 1].astype(np.int64)
            wide = np.flatnonzero(before >= 128)
            # The code point before; what takes four bytes is no white space and counts as no letter.
            place = at[wide]
            one, two, three = (np.where(place >= k, raw[place - k], 0).astype(np.int64) for k in (1, 2, 3))
            point = np.where(two >= 0xC0, (two & 0x1F) << 6 | one & 0x3F, (three & 0x0F) << 12 | (two & 0x3F) << 6 | one & 0x3F)
            kind = self.kinds[before]
            kind[wide] = np.where((two >= 0xC0) | (three >= 0xE0), self.kinds[point], OTHER)
            start[at[(kind == LETTER) | (self.white[raw[at]] & (kind != SPACE))]] = True
        return np.flatnonzero(start[:-1])

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces; those that may follow one another go to the library many in one text."""
        plain, odd = [], []
        for p in pieces:
            (plain if self.splits and p[0] in WHITE and not p[-1].isspace() else odd).append(p)
        names, flat, n = [], [self.flat], [self.n]
        groups = [plain[i : i + AT_ONCE] for i in range(0, len(plain), AT_ONCE)]
        for group, ids in zip(groups, self._encode(["".join(g) for g in groups])):
            reached = np.cumsum(self.n_bytes[ids])
            want = np.cumsum([len(p.encode()) for p in group])
            last = np.searchsorted(reached, want)
            if last[-1] != len(ids) - 1 or (reached[last] != want).any():
                odd += group
                continue
            names += group
            flat.append(ids)
            n.append(np.diff(last, prepend=-1))
        for low in range(0, len(odd), AT_ONCE):
            found = self._encode(odd[low : low + AT_ONCE])
            flat += found
            n.append(np.array([len(f) for f in found], np.int64))
        first = len(self.n)
        self.known.update(zip(names + odd, range(first, first + len(pieces))))
        self.flat, self.n = np.concatenate(flat), np.concatenate(n)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of each text; NULL has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        _, places, content = texts.buffers()
        offsets = np.frombuffer(places, np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(content or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = self._starts(raw, offsets)
        edges = np.append(starts, len(raw))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(raw)).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [p for p in distinct if p not in self.known]
        self._learn([p for p in new if len(p) <= LONGEST])
        n_kept, n_ids_kept = len(self.n), len(self.flat)
        long = [p for p in new if len(p) > LONGEST]
        if long:
            self._learn(long)
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        n = self.n[numbers]
        ids = concatenated(self.flat, (np.cumsum(self.n) - self.n)[numbers], n)
        self.n, self.flat = self.n[:n_kept], self.flat[:n_ids_kept]
        for p in long:
            del self.known[p]
        before = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(before[np.searchsorted(starts, offsets)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, n = self.encode_column(pa.array(texts, pa.large_string()))
        return [part.astype("<u4").tobytes() for part in np.split(ids, np.cumsum(n)[:-1])] if texts else []


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of a vocabulary file, made once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
