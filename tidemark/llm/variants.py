"""Spelling variants: words one code point apart, found by pivotal bigrams, and each word's better-known form.

Two words at one edit share a bigram that the edit left alone. Of a word's bigrams, ordered rarest first, the first three
are its prefix: an edit touches two at most. Two disjoint ones of these, chosen by dynamic programming over their
positions so that they are the rarest together, are its pivots: an edit touches one at most. Of two words at one edit,
the one whose prefix ends with the rarer bigram has a pivot that is also in the other's prefix, at the same distance
from the words' beginning (the edit is behind it, so all before it is the same too) or from their ends. Pivots are looked
up by these limits, and each pair found is verified once.

Words of over LONG letters may hold one bigram thousands of times. Pairs of these are looked up by their halves instead: one edit
leaves the first or the last half of the shorter word as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, table
from .hashing import LOWER, buffer, slices

#: Of the contract: one in DELETED runs loses a code point; words have LEAST_LENGTH code points and LEAST_COUNT occurrences; a form occurs RATIO
#: times as often.
DELETED, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Letters that words are made of: a to z and the 64 code points from U+00C0. Their bigrams are all there can be.
LETTERS, LATIN = 26 + 64, 0xC0
PREFIX = 3
#: Pairs whose shorter word has more letters are found by halves.
LONG = 64
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def crc_table() -> np.ndarray:
    """CRC-32 of each byte, as zlib has it."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()


def crc32(start: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of data[first : first + size] after texts with the CRC-32 ``start``; all runs advance together."""
    out = ~start.astype(np.uint32)
    order = np.argsort(-size, kind="stable")
    state, at, sorted_size = out[order], first[order], size[order]
    for j in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-sorted_size, -j, "left"))
        state[:n] = CRC[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[order] = state
    return ~out


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lowered, first byte of each run of letters, its bytes, its text) of texts without nulls."""
    raw, offsets = buffer(texts)
    raw = LOWER[raw]
    solid = (raw - np.uint8(97)) < 26
    wide = raw == 0xC3  # the first byte of U+00C0 to U+00FF; its second follows in the same text
    solid |= wide
    solid[1:] |= wide[:-1]
    at = np.flatnonzero(solid)
    if not len(at):
        return raw, *[np.zeros(0, np.int64)] * 3
    owner = np.searchsorted(offsets, at, "right") - 1
    begins = (np.diff(at, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0)
    first = np.flatnonzero(begins)
    return raw, at[first], np.diff(np.append(first, len(at))), owner[first]


def run_counts(texts: pa.Array, ids: list[str]) -> pa.RecordBatch:
    """The contract's words of some texts with their counts there."""
    raw, first, size, owner = runs(texts)
    points = np.add.reduceat(((raw & 0xC0) != 0x80).astype(np.int64), np.stack([first, first + size], axis=1).reshape(-1).clip(max=max(0, len(raw) - 1)))[::2] if len(first) else size
    if len(first) and first[-1] + size[-1] == len(raw):  # reduceat has no end for the last
        points[-1] = int(((raw[first[-1] :] & 0xC0) != 0x80).sum())
    long = points >= LEAST_LENGTH
    first, size, owner, points = first[long], size[long], owner[long], points[long]
    heads = pa.array([f"{i}:" for i in ids], pa.string())
    data, ends = buffer(heads)
    head = crc32(np.zeros(len(ids), np.uint32), data, ends[:-1], np.diff(ends))
    h = crc32(head[owner], raw, first, size)
    struck = h % DELETED == 0
    kept = ~struck
    words = []
    length = size[kept]
    if len(length):
        bounds = np.append(0, np.cumsum(length))
        where = np.repeat(first[kept] - bounds[:-1], length) + np.arange(bounds[-1])
        words.append(pa.StringArray.from_buffers(len(length), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw[where].tobytes())))
    shorter = []
    for lo, n, p, x in zip(first[struck].tolist(), size[struck].tolist(), points[struck].tolist(), h[struck].tolist(), strict=True):
        if p > LEAST_LENGTH:
            run = raw[lo : lo + n].tobytes().decode()
            shorter.append(run[: x % p] + run[x % p + 1 :])
    words.append(pa.array(shorter, pa.string()))
    found = pc.value_counts(pa.concat_arrays(words))
    return pa.RecordBatch.from_arrays([found.field(0), found.field(1).cast(pa.int64())], schema=COUNTS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of ``docs``. A null doc_id counts as the empty text in a run's hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b.column("text").fill_null(""), b.column("id").to_pylist()
            for lo, hi in slices(texts, 1 << 21):
                yield run_counts(texts.slice(lo, hi - lo), ids[lo:hi])

    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each letter, offsets of words), a to z as 0 to 25, then U+00C0 to U+00FF."""
    text = pc.binary_join(pa.array([words.to_pylist()], pa.list_(pa.string())), "")[0].as_py() if len(words) else ""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.append(0, np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))).astype(np.int64)
    return np.where(points < 128, points - 97, points - LATIN + 26), ends


def pivots(cost: np.ndarray) -> np.ndarray:
    """For each row, the two places at least two apart with the least total cost. ``cost`` is infinite outside the prefix;
    dynamic programming over places: the best single one so far, and the best pair that ends here."""
    rows, places = cost.shape
    row = np.arange(rows)
    single, pair = np.full((places, rows), -1), np.full((rows, 2), -1)
    best = np.full(rows, np.inf)
    lone = np.full(rows, np.inf)
    at = np.full(rows, -1)
    for j in range(places):
        if j >= 2:
            c = cost[row, np.maximum(single[j - 2], 0)] + cost[:, j]
            better = (single[j - 2] >= 0) & (c < best)
            best[better] = c[better]
            pair[better] = np.stack([single[j - 2][better], np.full(int(better.sum()), j)], axis=1)
        less = cost[:, j] < lone
        lone[less], at[less] = cost[less, j], j
        single[j] = at
    return pair


ENTRIES = pa.schema([("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("last", pa.int32()), ("asks", pa.bool_())])


def entries(words: pa.Array, n: pa.Array, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a word is found by and what it asks for: a side's letters up to the end of a bigram of the prefix (a pivot) and the other word's
    length. ``rank`` orders bigrams, rarest first."""
    code, ends = letters(words)
    size = np.diff(ends)
    for m in np.unique(size).tolist():
        own = np.flatnonzero(size == m)
        if m > LONG:
            out = []
            for i in own.tolist():
                w, c = words[i].as_py(), n[i].as_py()
                for shorter in {max(m - 1, LONG + 1), m}:
                    for side, half in (("<<", w[: shorter // 2]), (">>", w[-(shorter // 2) :])):
                        key = f"{side}{shorter}:{zlib.crc32(half.encode())}"
                        out += [(key, w, c, 0, False), (key, w, c, 0, True)]
            yield batch_of(out)
        if m > LONG + 1:
            continue
        grid = code[ends[own][:, None] + np.arange(m)]
        ranks = rank[grid[:, :-1] * LETTERS + grid[:, 1:]]
        last = np.sort(ranks, axis=1)[:, PREFIX - 1]
        prefix = ranks <= last[:, None]  # with every bigram like the third
        # the three rarest by place where they tie, for the pivots
        third = np.argsort(ranks, axis=1, kind="stable")[:, :PREFIX]
        cost = np.full(ranks.shape, np.inf)
        np.put_along_axis(cost, third, np.take_along_axis(ranks, third, 1).astype(float), 1)
        pivot = pivots(cost)
        texts = [words[i].as_py() for i in own.tolist()]
        counts = n.take(pa.array(own)).to_pylist()
        out: list[tuple] = []
        for w, c, l, row, two in zip(texts, counts, last.tolist(), prefix, pivot.tolist(), strict=True):
            for p in np.flatnonzero(row).tolist():
                out.append((f"<{m}:{w[: p + 2]}", w, c, l, False))
                out.append((f">{m}:{w[p:]}", w, c, l, False))
            for p in two:
                for other in (m - 1, m, m + 1):
                    out.append((f"<{other}:{w[: p + 2]}", w, c, l, True))
                    out.append((f">{other}:{w[p:]}", w, c, l, True))
        yield batch_of(out)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRIES, strict=True)], schema=ENTRIES)


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """The order of all bigrams by the number of words they are in, times counted; at most LETTERS ** 2 of them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for b in batches:
            code, ends = letters(b.column("word"))
            pairs = np.ones(max(0, len(code) - 1), bool)
            pairs[ends[1:-1] - 1] = False  # a bigram doesn't go from word to word
            total += np.bincount((code[:-1] * LETTERS + code[1:])[pairs], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    found = words.select("word").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(LETTERS * LETTERS, np.int64)
    for r in found:
        total[r.gram] = r.n
    rank = np.empty(len(total), np.int32)
    rank[np.argsort(total, kind="stable")] = np.arange(len(total))
    return rank


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n), once for each two words at one edit, a before b. ``words`` has word and n, each word once."""
    rank = bigram_ranks(words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from entries(b.column("word"), b.column("n"), rank)

    made = cut(words.mapInArrow(emit, "key string, word string, n long, last int, asks boolean"), "variants-entries")
    asks = made.filter("asks").select("key", F.col("word").alias("x"), F.col("n").alias("x_n"), F.col("last").alias("x_last"))
    held = made.filter("not asks").select("key", F.col("word").alias("y"), F.col("n").alias("y_n"), F.col("last").alias("y_last"))
    met = asks.join(held, "key").filter((F.col("x_last") <= F.col("y_last")) & (F.col("x") != F.col("y")))
    near = met.filter(F.levenshtein("x", "y", 1) == 1)
    first = F.col("x") < F.col("y")
    either = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    pairs = near.select(either("x", "y").alias("a"), either("y", "x").alias("b"), either("x_n", "y_n").alias("a_n"), either("y_n", "x_n").alias("b_n"))
    out = cut(pairs.dropDuplicates(["a", "b"]), "variants-pairs")
    remove(made)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each step doubles how far forms are followed. A form occurs RATIO times as often as its word, so
    chains are short (64 bits of counts: 27 steps at most), and this ends."""
    now = cut(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        made = cut(step, "variants-roots")
        moved = made.filter("moved").limit(1).count()
        remove(now)
        now = made.drop("moved") if not moved else cut(made.drop("moved"), "variants-roots")
        if not moved:
            return now
        remove(made)


def group(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each (word, n); every word stays."""
    pairs = near_pairs(words)
    one = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = one.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    of = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = -F.col("best.m") >= RATIO * F.col("n")
    of = cut(of.select("word", "n_near", F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.m")).alias("form_n")), "variants-forms")
    remove(pairs)
    ends = roots(of.filter(F.col("form").isNotNull()).select("word", "form"))
    out = words.select("word", "n").join(of, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` with their near words counted, their form and its root.

    Null and empty texts have no words; a null doc_id counts as the empty text in a run's hash; repeated rows count again;
    a very long text is one like any other; ties between forms go to the smallest word; an empty table, or one without
    a word that occurs often enough, gives an empty one; other columns are not read.
    """
    return group(cut(word_counts(docs), "variants-words"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
