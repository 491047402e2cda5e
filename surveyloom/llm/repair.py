"""Token files compressed by Re-Pair: frequent pairs of ids become rules, shard by shard.

Documents are dealt into ranges of ascending ``doc_id``; each task writes its range as
shards of about ``TOKENS_PER_SHARD`` ids. In a shard, the most frequent pairs of
neighbouring symbols are replaced by new symbols, again and again, until no pair is
frequent enough to pay for its rule. A rule never spans two documents. The file keeps
the rules, the number of ids that each rule stands for, and the symbols, so that any
range of ids is decoded without expanding what lies before it.

A shard is written under another name and then renamed, so a task that runs twice
leaves one whole file. Files are read back with Spark's binary source.

File, all little-endian: ``RPR1``; n_docs u4, n_rules u4, base u4, width u4, n_symbols
u8, n_tokens u8; doc_id i8[n_docs]; null ids u1[n_docs]; symbols of each document
u4[n_docs]; ids of each document u4[n_docs]; rules u4[n_rules, 2]; lengths
u4[n_rules]; symbols u2 or u4[n_symbols].

Rules for odd input: NULL text is an empty document, which still has its end id; a
NULL doc_id sorts first and comes back as NULL; repeated rows are documents of their
own, tied ids in the order of their hashed text; an empty table gives no file and no
row. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.llm.byte_pairs import encoder, portions
from surveyloom.sources.staging import stage

MAGIC = b"RPR1"
HEAD = struct.Struct("<4s4I2Q")
TOKENS_PER_SHARD = 1 << 21
# A rule takes 12 bytes and saves one symbol of 2 bytes wherever it is used.
LEAST_USES = 8
RULES_PER_ROUND = 6000
# Slots of the table that finds a chosen pair, and the odd factor that spreads pairs over it.
SLOT_BITS = 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS_OF_TWO_BYTES = 1 << 16


@dataclass
class Shard:
    doc_ids: np.ndarray
    null_ids: np.ndarray
    doc_symbols: np.ndarray
    doc_tokens: np.ndarray
    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def to_bytes(self) -> bytes:
        width = 2 if self.base + len(self.rules) <= SYMBOLS_OF_TWO_BYTES else 4
        head = HEAD.pack(MAGIC, len(self.doc_ids), len(self.rules), self.base, width, len(self.symbols), int(self.doc_tokens.sum()))
        parts = [(self.doc_ids, "<i8"), (self.null_ids, "u1"), (self.doc_symbols, "<u4"), (self.doc_tokens, "<u4")]
        parts += [(self.rules, "<u4"), (self.lengths, "<u4"), (self.symbols, f"<u{width}")]
        return head + b"".join(np.ascontiguousarray(a, kind).tobytes() for a, kind in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, n_docs, n_rules, base, width, n_symbols, _ = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair token file")
        at, out = HEAD.size, []
        for n, kind in ((n_docs, "<i8"), (n_docs, "u1"), (n_docs, "<u4"), (n_docs, "<u4"), (2 * n_rules, "<u4"), (n_rules, "<u4"), (n_symbols, f"<u{width}")):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        ids, nulls, doc_symbols, doc_tokens, rules, lengths, symbols = out
        return cls(ids, nulls, doc_symbols, doc_tokens, base, rules.reshape(-1, 2), lengths, symbols)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of every symbol in one array, with the place and length of each symbol's part."""
        length = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        place = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), np.uint32)
        flat[: self.base] = np.arange(self.base)
        starts, sizes = place.tolist(), length.tolist()
        for rule, (a, b) in enumerate(self.rules.tolist(), self.base):
            at, n = starts[rule], sizes[a]
            flat[at : at + n] = flat[starts[a] : starts[a] + n]
            flat[at + n : at + n + sizes[b]] = flat[starts[b] : starts[b] + sizes[b]]
        return flat, place, length

    def tokens(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; only the symbols that cover them are expanded."""
        flat, place, length = self._expansions()
        ends = np.cumsum(length[self.symbols])
        stop = (int(ends[-1]) if len(ends) else 0) if stop is None else stop
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        part = self.symbols[first : last + 1]
        n = length[part]
        began = np.cumsum(n) - n
        out = flat[np.repeat(place[part] - began, n) + np.arange(int(n.sum()))]
        skip = start - (int(ends[first - 1]) if first else 0)
        return out[skip : skip + stop - start]


def compress(tokens: np.ndarray, doc_tokens: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules, their lengths, the symbols, and the symbols of each document.

    ``base`` is above every id. In one round the most frequent pairs are replaced
    together, from left to right where they overlap.
    """
    room = max(SYMBOLS_OF_TWO_BYTES - base, 0) or (1 << 20)
    # A pair fits into 32 bits as long as symbols fit into 16.
    kind, half = (np.uint32, 16) if base + room <= SYMBOLS_OF_TWO_BYTES else (np.uint64, 32)
    seq = tokens.astype(kind)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(doc_tokens.astype(np.int64))[doc_tokens > 0] - 1] = True
    rules, lengths = np.empty((0, 2), np.int64), np.ones(base, np.int64)
    slot_of_pair = np.empty(1 << SLOT_BITS, np.int32)

    def slots(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * SPREAD) >> np.uint64(64 - SLOT_BITS)

    while room > 0 and len(seq) > 1:
        pair = (seq[:-1] << kind(half)) | seq[1:]
        inside = np.flatnonzero(~last[:-1])
        pair = pair[inside]
        found, n = np.unique(pair, return_counts=True)
        frequent = np.flatnonzero(n >= LEAST_USES)
        if not len(frequent):
            break
        # The rarest first, so that of two pairs in one slot the more frequent one stays; the other has its turn later.
        chosen = found[frequent[np.argsort(-n[frequent], kind="stable")[: min(RULES_PER_ROUND, room)]][::-1]]
        slot_of_pair.fill(0)
        slot_of_pair[slots(chosen)] = np.arange(len(chosen))
        rule = slot_of_pair[slots(pair)]
        hit = np.flatnonzero(chosen[rule] == pair)
        at, rule = inside[hit], rule[hit]
        # Of pairs that overlap in a run, every other one is taken.
        run_start = np.ones(len(at), bool)
        run_start[1:] = at[1:] != at[:-1] + 1
        place = np.arange(len(at))
        even = (place - np.maximum.accumulate(np.where(run_start, place, 0))) % 2 == 0
        at, rule = at[even], rule[even]
        worth = np.bincount(rule, minlength=len(chosen)) >= LEAST_USES
        if not worth.any():
            break
        at, rule = at[worth[rule]], rule[worth[rule]]
        number = np.cumsum(worth) - 1 + base + len(rules)
        made = np.stack([chosen[worth] >> kind(half), chosen[worth] & kind((1 << half) - 1)], axis=1).astype(np.int64)
        seq[at] = number[rule]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        last[at] = last[at + 1]
        seq, last = seq[keep], last[keep]
        rules = np.concatenate([rules, made])
        lengths = np.concatenate([lengths, lengths[made[:, 0]] + lengths[made[:, 1]]])
        room -= len(made)
    ends = np.flatnonzero(last)
    doc_symbols = np.zeros(len(doc_tokens), np.int64)
    doc_symbols[doc_tokens > 0] = np.diff(ends, prepend=-1)
    return rules, lengths[base:], seq, doc_symbols


FILES = pa.schema(
    [("part", pa.int32()), ("number", pa.int32()), ("file", pa.string())]
    + [(c, pa.int64()) for c in ("n_docs", "n_tokens", "n_symbols", "n_rules", "n_bytes")]
)
FILES_DDL = "part int, number int, file string, n_docs long, n_tokens long, n_symbols long, n_rules long, n_bytes long"
READ = pa.schema([("file", pa.string()), ("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("start", "n_tokens", "ids_crc32")])
READ_DDL = "file string, doc_id long, start long, n_tokens long, ids_crc32 long"


def _put(folder: str, file: str, data: bytes) -> None:
    """Write a file so that it appears whole or not at all."""
    target, root = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    target.create_dir(root, recursive=True)
    draft = f"{root}/_{uuid.uuid4().hex}"
    with target.open_output_stream(draft) as out:
        out.write(data)
    target.move(draft, f"{root}/{file}")


def _shard(doc_ids: list[pa.Array], doc_tokens: np.ndarray, tokens: np.ndarray, base: int) -> Shard:
    rules, lengths, symbols, doc_symbols = compress(tokens, doc_tokens, base)
    ids = pa.concat_arrays(doc_ids)
    nulls = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    return Shard(ids.fill_null(0).to_numpy(), nulls, doc_symbols, doc_tokens, base, rules, lengths, symbols)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Encode and write all documents in ascending ``doc_id`` order; returns the staged list of files.

    Spark chooses the number of ranges and joins small ones; a task holds the ids of
    one shard, one Arrow batch, and what a part of its texts is encoded with.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        to_ids = encoder(vocabulary)
        base = max(to_ids.size, end_id + 1)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, n_held
            doc_ids, sizes, tokens = zip(*held)
            shard, file = _shard(list(doc_ids), np.concatenate(sizes), np.concatenate(tokens), base), f"{part:06d}-{number:06d}.rpr"
            data = shard.to_bytes()
            _put(folder, file, data)
            row = [part, number, file, len(shard.doc_ids), n_held, len(shard.symbols), len(shard.rules), len(data)]
            number, n_held = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(FILES.names, row))], FILES)

        for batch in batches:
            for low, high in portions(batch["text"]):
                ids, n = to_ids.encode_column(batch["text"].slice(low, high - low))
                doc_ids, ids = batch["doc_id"].slice(low, high - low), np.insert(ids, np.cumsum(n), end_id)
                ends = np.concatenate([[0], np.cumsum(n + 1)])
                first = 0
                while first < len(n):
                    # Up to the document that fills the shard.
                    last = min(int(np.searchsorted(ends, ends[first] + TOKENS_PER_SHARD - n_held)), len(n))
                    held.append((doc_ids.slice(first, last - first), n[first:last] + 1, ids[ends[first] : ends[last]]))
                    n_held += int(ends[last] - ends[first])
                    first = last
                    if n_held >= TOKENS_PER_SHARD:
                        yield flush()
        if held:
            yield flush()

    # The hash deals out and orders documents that share an id.
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*place).sortWithinPartitions(*place)
    return stage(ordered.mapInArrow(write, FILES_DDL), "repair-files")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            shard = Shard.from_bytes(content.as_py())
            raw = memoryview(shard.tokens().astype("<u4", copy=False)).cast("B")
            ends = np.cumsum(shard.doc_tokens.astype(np.int64))
            starts = ends - shard.doc_tokens
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            doc_ids = pa.array(shard.doc_ids, mask=shard.null_ids.astype(bool))
            names = pa.array([path.as_py().rsplit("/", 1)[-1]] * len(crcs))
            columns = [names, doc_ids, pa.array(starts, pa.int64()), pa.array(shard.doc_tokens.astype(np.int64)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=READ)


def read_shards(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32, file``.

    ``start`` counts the ids of all documents before it: those of earlier files, from
    the list of files (one row for each), and those before it in its file.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(F.col("file").alias("_file"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    contents = spark.read.format("binaryFile").option("pathGlobFilter", "*.rpr").load(folder).select("path", "content")
    docs = contents.mapInArrow(_decode, READ_DDL)
    joined = docs.join(offsets, docs["file"] == offsets["_file"])
    return joined.select("doc_id", (F.col("_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "file")
