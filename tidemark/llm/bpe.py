"""BPE encoding and decoding with a table of distinct words.

A first pass splits every text into words and counts each distinct word in Spark. The most frequent ones, of a fixed
number, make the distinct-word table: every word of it is encoded once, and tasks join its ids to their words by position.
The rest (mostly invented or misspelt words that occur once) is encoded once for each block of texts, as sending each such
word to a table and its ids back would cost more than it saves; see README for figures. Decoding joins ids to the
vocabulary's byte pieces by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices
from .splitting import byte_level_words, holds, matches

#: Scripts whose letters are assigned alike in every Unicode version in use; other texts go whole to the tokenizer.
SETTLED = r"[^\x{0}-\x{52F}\x{2000}-\x{206F}\x{20A0}-\x{20BF}]"
#: Words in a worker's table before it starts afresh, and bytes of text handled at a time: both bound a worker's memory.
TABLE_WORDS, SLICE_BYTES = 400_000, 1 << 20
#: Words of the distinct-word table, which every executor gets: some 3 MB at any size of the input.
FREQUENT = 1 << 16
LONG_WORD = 64


def piece_bytes(tokenizer) -> pa.Array:
    """The vocabulary's table id -> bytes. Printable stand-ins of byte-level BPE are mapped back to their bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    back = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    pieces = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        piece = tokenizer.id_to_token(i) or ""
        pieces.append(piece.encode() if i in special or any(c not in back for c in piece) else bytes(back[c] for c in piece))
    return pa.array(pieces, pa.binary())


class WordTable:
    """Distinct words of one worker with the ids of each, kept as flat arrays."""

    def __init__(self, path: str, known: pa.Table | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = known
        self.clear()

    def clear(self) -> None:
        """Start afresh, with the words and ids of ``known`` alone."""
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)
        if self.known is not None and len(self.known):
            lists = self.known.column("ids").combine_chunks()
            self.add(self.known.column("word").to_pylist(), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))

    def add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.ends[-1] + np.cumsum(sizes.astype(np.int64))
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.ends[-1] : ends[-1]] = flat
        at = len(self.ends) - 1
        self.slot.update(zip(words, range(at, at + len(words)), strict=True))
        self.ends = np.concatenate([self.ends, ends])

    def encode_new(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For distinct ``words``: where the ids of each start, how many there are, the flat ids, and the words' places."""
        if len(self.slot) > TABLE_WORDS:
            self.clear()
        new = [w for w in words if w not in self.slot]
        if new:
            coded = self.encode_new(new)
            self.add(new, np.fromiter(chain.from_iterable(coded), np.int32), np.fromiter(map(len, coded), np.int64, len(coded)))
        at = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        for w in new:  # whole texts and oddities aren't worth keeping
            if len(w) > LONG_WORD:
                del self.slot[w]
        return self.ends[at], self.ends[at + 1] - self.ends[at], self.ids, at


def gather(start: np.ndarray, count: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + count], one after the other."""
    total = int(count.sum())
    if not total:
        return flat[:0]
    at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return flat[at + np.arange(total)]


def plain_and_whole(batches: Iterator[pa.RecordBatch], special: tuple[str, ...], other: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of bounded bytes with a column ``text``, in two parts: texts whose words encode one by one, and (True) texts that
    hold a special token's string or characters of the pattern ``other``, which the tokenizer has to split itself."""
    for batch in batches:
        for lo, hi in slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            whole = matches(part.column("text"), other) | holds(part.column("text"), special)
            for kind, mask in ((False, ~whole), (True, whole)):
                if mask.any():
                    yield kind, part if mask.all() else part.filter(pa.array(mask))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, special: tuple[str, ...]) -> DataFrame:
    """word, n: how often each distinct word of up to LONG_WORD characters occurs, over all texts that encode by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, part in plain_and_whole(batches, special, SETTLED):
            if not whole:
                counted = byte_level_words(part.column("text"))[0].value_counts()
                short = pc.less_equal(pc.utf8_length(counted.field("values")), LONG_WORD)
                yield pa.RecordBatch.from_arrays([counted.field("values").filter(short), counted.field("counts").filter(short)], names=["word", "n"])

    return _rows(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def distinct_words(docs: DataFrame, tokenizer_path: str, special: tuple[str, ...]) -> DataFrame:
    """word, ids of the FREQUENT most frequent words, each encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(tokenizer_path)
        for batch in batches:
            ids = pa.array(table.encode_new(batch.column("word").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), ids], names=["word", "ids"])

    return word_counts(docs, special).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").mapInArrow(run, "word string, ids array<int>")


_tables: dict[tuple, tuple[WordTable, pa.Array]] = {}


def encode_decode(docs: DataFrame, tokenizer_path: str, special: tuple[str, ...] = ("<|endoftext|>",)) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every document.

    Nulls: a null text encodes as the empty one, no ids; a null doc_id stays null. Repeated rows give repeated rows; ties
    among frequent words go by the word; a very long text is handled alone, whole. Other columns are dropped; an empty table
    gives an empty one.
    """
    path = tokenizer_path
    known = docs.sparkSession.sparkContext.broadcast(distinct_words(docs, path, special).toArrow())
    mark = (path, uuid.uuid4().hex)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def made(keys: pa.Array, ids: np.ndarray, sizes: np.ndarray, pieces: pa.Array) -> pa.RecordBatch:
        till = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        ids = pa.array(ids)
        joined = pc.binary_join(pa.ListArray.from_arrays(till, pieces.take(ids)), pa.scalar(b"", pa.binary()))
        try:
            decoded = joined.cast(pa.string())
        except pa.ArrowInvalid:
            decoded = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(till, ids), decoded], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _tables:
            _tables.clear()  # the last query's
            table = WordTable(path, known.value)
            _tables[mark] = table, piece_bytes(table.tokenizer)
        table, pieces = _tables[mark]
        for whole, part in plain_and_whole(batches, special, SETTLED):
            keys, texts = part.column("doc_id"), part.column("text")
            if whole:
                coded = table.encode_new(texts.to_pylist())
                yield made(keys, np.fromiter(chain.from_iterable(coded), np.int32), np.array([len(c) for c in coded]), pieces)
                continue
            values, words = byte_level_words(texts)
            coded = values.dictionary_encode()
            start, count, flat, _ = table.encode(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            at = coded.indices.to_numpy(zero_copy_only=False)
            n = count[at]
            till = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(words))]
            yield made(keys, gather(start[at], n, flat), np.diff(till), pieces)

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op7_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
