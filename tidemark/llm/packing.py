"""Packing along a space-filling curve.

Each document's hashed word vector is projected to a few dimensions, the projection gets a Hilbert key, and documents
are range-sorted by that key, so neighbours on the curve share sequences. Every range partition packs its own stretch
of the curve in one pass; what is left at its end goes into sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordTable, gather, plain_and_whole
from .common import cut, parts_of
from .splitting import lower_parts

DIMS, BITS = 3, 16
#: Ids in a row of the range sort, at most.
STRETCH = 4096
#: Outside these characters lower case and normal forms aren't plain; such texts go whole to the tokenizer.
PLAIN = r"[^\x{0}-\x{12F}\x{131}-\x{17F}\x{2010}-\x{2027}\x{20AC}]"

class PartTable(WordTable):
    """A word table whose words are parts as the pre-tokenizer makes them, so the merges apply to each directly; with
    each part's projection."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.tokenizer.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(kept)]
        self.printable = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}

    def clear(self) -> None:
        super().clear()
        self.places = np.zeros((0, DIMS), np.float32)
        self.more: list[np.ndarray] = []

    def encode_new(self, words: list[str]) -> list[list[int]]:
        tokens, printable = self.model.tokenize, self.printable
        self.more.append(project(words))
        return [[t.id for t in tokens(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(printable))] for w in words]

    def projections(self) -> np.ndarray:
        if self.more:
            self.places = np.concatenate([self.places, *self.more])
            self.more = []
        return self.places


_tables: dict[str, PartTable] = {}


def project(words: list[str]) -> np.ndarray:
    """A row of DIMS numbers in [-1, 1] for each word, by its hash: a random projection of one-hot hashed vectors."""
    h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    out = np.empty((len(words), DIMS), np.float32)
    for k in range(DIMS):
        x = (h + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (x >> np.uint64(40)).astype(np.float32) / (1 << 23) - 1
    return out


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows of ``cells``, each below 2 ** bits)."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:  # undo the turns of each level, from the coarsest on
        p = np.uint32(q - 1)
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turn, p, np.uint32(0)) ^ swap
            if i:
                x[i] ^= swap
        q = np.uint32(q >> 1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q = np.uint32(q >> 1)
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> np.uint32(b)) & 1).astype(np.int64)
    return key


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, special: tuple[str, ...]) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 16-bit, the document's end id last), n_ids of the whole document and its
    place on the curve. A document of more than STRETCH ids has a row for each stretch, so rows are alike in size and a range
    sort deals out bytes, not documents."""
    path = tokenizer_path
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("n_ids", pa.int64()), ("key", pa.int64())])

    def place(total: np.ndarray, parts: np.ndarray) -> np.ndarray:
        spot = 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(parts, 1))[:, None], -30, 30)))
        return hilbert_key(np.minimum((spot * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))

    def made(keys: pa.Array, ids: np.ndarray, size: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        rows = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(size)), rows)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)) * STRETCH
        offsets = np.append((np.repeat(np.cumsum(size) - size, rows) + start) * 2, 2 * len(ids)).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.array(start), packed, pa.array(size[doc]), pa.array(key[doc])], schema=schema)

    def by_table(table: PartTable, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """Texts of plain characters: each distinct part is encoded once, ids come back by position."""
        values, parts = lower_parts(texts)
        coded = values.dictionary_encode()
        start, count, flat, spot = table.encode(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy(zero_copy_only=False)
        bounds = np.append(0, np.cumsum(parts))
        n = count[at]
        size = np.diff(np.append(0, np.cumsum(n))[bounds]) + 1
        last = np.cumsum(size)
        ids = np.empty(int(last[-1]), np.uint16)
        body = np.ones(len(ids), bool)
        body[last - 1] = False
        ids[body] = gather(start[at], n, flat)
        ids[last - 1] = end_id
        total, some = np.zeros((len(keys), DIMS)), parts > 0
        if some.any():
            total[some] = np.add.reduceat(table.projections()[spot][at], bounds[:-1][some], axis=0)
        return made(keys, ids, size, place(total, parts))

    def by_library(table: PartTable, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """Other texts: the tokenizer takes them whole; their place comes from their parts like that of any other."""
        lists = [[*table.tokenizer.encode(t, add_special_tokens=False).ids, end_id] for t in texts.to_pylist()]
        values, parts = lower_parts(texts)
        total, some = np.zeros((len(keys), DIMS)), parts > 0
        if some.any():
            total[some] = np.add.reduceat(project(values.to_pylist()), np.append(0, np.cumsum(parts))[:-1][some], axis=0)
        return made(keys, np.concatenate(lists).astype(np.uint16), np.array([len(x) for x in lists]), place(total, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tables:
            _tables[path] = PartTable(path)
            if _tables[path].tokenizer.get_vocab_size() > 1 << 16:
                raise ValueError("ids of this vocabulary need more than 16 bits")
        table = _tables[path]
        for whole, part in plain_and_whole(batches, special, PLAIN):
            yield (by_library if whole else by_table)(table, part.column("doc_id"), part.column("text"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, ids binary, n_ids long, key long")


def powers(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, special: tuple[str, ...] = ("<|startoftext|>", "<|endoftext|>")) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids: doc_id, start, length, ids (16-bit), ids_crc32,
    doc_tokens, sequence_id, offset. ``capacity`` is a power of two, so full sequences and the tails need no padding.

    A null or empty text is the end id alone. Ties on the curve go by doc_id and start; repeated rows are packed as often as
    they occur; a null doc_id stays null; a very long text is sorted in stretches; other columns are dropped; an empty table
    gives no piece.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    columns = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(columns, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held: list[tuple] = []  # pieces of the open sequence: doc_id, start, ids, doc_tokens
        fill = 0

        def close(pieces: list[tuple], lengths: list[int]) -> None:
            """Deal the pieces out to sequences of these lengths."""
            nonlocal sequence
            left, offset = list(lengths), 0
            for doc, start, ids, total in pieces:
                while len(ids):
                    take = min(len(ids), left[0] - offset)
                    part = ids[:take]
                    rows.append((doc, start, take, part.tobytes(), zlib.crc32(part.astype("<u4").tobytes()), total, sequence, offset))
                    ids, start, offset = ids[take:], start + take, offset + take
                    if offset == left[0]:
                        left.pop(0)
                        offset = 0
                        sequence += 1

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for doc, start, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_ids")), batch.column("ids"), strict=True):
                ids, at = np.frombuffer(raw.as_buffer(), "<u2"), 0
                while at < len(ids):
                    take = min(capacity - fill, len(ids) - at)
                    held.append((doc, start + at, ids[at : at + take], total))
                    at, fill = at + take, fill + take
                    if fill == capacity:
                        close(held, [capacity])
                        held, fill = [], 0
                if len(rows) > 2000:
                    yield flush()
        close(held, powers(fill))
        if rows:
            yield flush()

    placed = cut(tokenize(docs, tokenizer_path, end_id, special), "packing")
    size = placed.agg(F.sum(F.length("ids"))).first()[0] or 0
    along = placed.repartitionByRange(parts_of(docs.sparkSession, size), "key", "doc_id", "start").sortWithinPartitions("key", "doc_id", "start")
    return along.mapInArrow(run, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
