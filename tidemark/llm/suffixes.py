"""Removal of passages that occur twice, by a distributed suffix merge sort.

Sorting every suffix would move each text hundreds of times, so suffixes are thinned exactly. A window of LENGTH bytes is
looked after by its anchor, a place that its own bytes determine; equal windows have equal anchors. An anchor whose next
KEY bytes occur once in the corpus has no repeated window. Anchors with equal bytes around them are one class, as equal
suffixes in a run would be. What is left is sorted:

* every task sorts the suffixes at its classes' anchors into runs, front-coded: a suffix is the length of the prefix that
  it shares with the one before, and the rest;
* runs are cut at sampled splitters of KEY bytes and exchanged, so suffixes that share KEY bytes meet in one place. There
  are at most SPLITTERS of them, whatever the corpus; what lies between two is dealt out further by a hash of the KEY bytes;
* a loser tree merges the runs. It keeps each loser's common prefix with the last winner and compares only beyond it, so
  known prefixes are never compared again, and the merged suffixes come with their common prefixes;
* windows are repeated where suffixes share enough bytes after the anchor and the windows' bytes before it are equal.

KEY bytes that more than CROWD classes share (a licence in many settings) would crowd one task. The windows of such
classes are counted by hash over all tasks instead, which is exact and has no such limit.

Passages of so many words are found the same way in texts of which each word is written as its hash of SYMBOL bytes: a
Rule says how long a window is and by what step windows start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, drawn, partitions, remove, table
from .hashing import BLANK, BYTE, STEP, buffer, mix, slices, word_hashes

#: A passage counts from so many bytes on.
LENGTH = 400
#: Windows of WINDOW k-mers choose an anchor each; so every passage holds the KEY bytes after its anchor.
WINDOW, KMER = 129, 16
KEY = LENGTH - WINDOW + 1
#: Classes that share KEY bytes and still meet in one task; suffixes of one run; stretch of a very long text handled at a time.
CROWD, RUN, STRETCH = 256, 10_000, 1 << 18
#: Classes drawn by hash for each splitter; parts for each shuffle partition, and suffixes in a part on average at most.
SAMPLE, PARTS, PART_ROWS = 16, 4, 10_000
#: Most splitters: the driver sees SAMPLE times as many keys (18 MB), a task's closure holds them (1 MB).
SPLITTERS = 4_096
#: Bytes of a word's hash.
SYMBOL = 8


@dataclass(frozen=True)
class Rule:
    """Windows of ``length`` bytes that start at each byte (step 1), or of ``length`` / SYMBOL words that start at each
    word of a text written in hashes (step SYMBOL). WINDOW and KEY in proportion to the length."""

    length: int = LENGTH
    step: int = 1

    @property
    def window(self) -> int:
        """Places among which a window's anchor is chosen, in steps."""
        return max(1, self.length * WINDOW // (LENGTH * self.step))

    @property
    def key(self) -> int:
        return self.length - (self.window - 1) * self.step

    def read(self, texts: pa.Array) -> pa.Array:
        """The texts as windows see them."""
        if self.step == 1:
            return texts
        hashes, count = word_hashes(texts)
        ends = (np.append(0, np.cumsum(count)) * SYMBOL).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(hashes))])


BYTES = Rule()


def word_rule(words: int) -> Rule:
    return Rule(words * SYMBOL, SYMBOL)


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends."""
    edges = np.flatnonzero(np.diff((~BLANK[np.frombuffer(raw, np.uint8)]).astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


class Hasher:
    """Hashes of any stretch of a byte buffer, from prefix sums modulo 2 ** 64."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if n > len(Hasher.powers):
            size = max(n, 2 << 18)
            step, back = int(STEP[0]), pow(int(STEP[0]), -1, 1 << 64)
            for name, base in (("powers", step), ("inverse", back)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(Hasher, name, np.multiply.accumulate(table))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(BYTE[raw] * Hasher.powers[: n - 1], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Hasher.inverse[start] + (end - start).astype(np.uint64) * STEP[1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(raw: np.ndarray, lo: int, hi: int, hashes: Hasher, rule: Rule = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the text raw[lo:hi]: the anchors' places, and the first and last window start that each one stands for. The
    anchor of a window is the leftmost least k-mer among its first ``rule.window``, so equal windows have it at the same
    place."""
    step = rule.step
    n = (hi - lo - rule.length) // step + 1
    at = np.arange(lo, hi - KMER + 1, step)
    kmers = hashes.stretch(at, at + KMER)
    least = sliding_min((kmers & ~np.uint64(0xFFFFFFFF)) | np.arange(len(at), dtype=np.uint64), rule.window)[:n] & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.diff(least.astype(np.int64), prepend=-1))
    return lo + step * least[first].astype(np.int64), lo + step * first, lo + step * (np.append(first[1:], n) - 1)


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null: empty), a key that rows share only if both are equal, and the named other columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("key"), *[F.col(c).alias(f"_{c}") for c in carry])


def anchor_rows(docs: DataFrame, rule: Rule = BYTES) -> DataFrame:
    """For each anchor: mh and sh (hashes of the KEY bytes at it, and of all bytes of its windows), key, at, back (from
    the first window's start to the anchor) and width (from the first to the last window's start)."""
    names = ["mh", "sh", "key", "at", "back", "width"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text"), STRETCH):
                raw, offsets = buffer(rule.read(batch.column("text").slice(i, j - i)))
                keys = batch.column("key").slice(i, j - i).to_pylist()
                for c in range(0, max(1, len(raw)), STRETCH):  # more than once for a single long text only
                    part = raw[c : c + STRETCH + rule.length - 1] if j - i == 1 else raw
                    hashes, found = Hasher(part), []
                    for k in range(j - i):
                        lo, hi = (0, len(part)) if j - i == 1 else (int(offsets[k]), int(offsets[k + 1]))
                        if hi - lo >= rule.length:
                            found.append((keys[k], lo - c if j - i == 1 else lo, *anchors(part, lo, hi, hashes, rule)))
                    if found:
                        at, first, last = (np.concatenate([f[x] for f in found]) for x in (2, 3, 4))
                        size = [len(f[2]) for f in found]
                        base = np.repeat([f[1] for f in found], size)
                        mh = hashes.stretch(at, at + rule.key).view(np.int64)
                        sh = mix(hashes.stretch(first, last + rule.length) + (at - first).astype(np.uint64) * STEP[2]).view(np.int64)
                        cols = [mh, sh, np.repeat(np.array([f[0] for f in found], np.int64), size), (at - base).astype(np.int32), (at - first).astype(np.int32), (last - first).astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=schema)
                    if j - i > 1:
                        break
        pa.default_memory_pool().release_unused()

    return docs.select("key", "text").mapInArrow(run, "mh long, sh long, key long, at int, back int, width int")


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, of which ``h`` bytes are known."""
    n = min(len(a), len(b))
    while h < n and a[h : h + 32] == b[h : h + 32]:
        h += 32
    if h >= n:
        return n
    while h < n and a[h] == b[h]:
        h += 1
    return h


def front_coded(strings: list[bytes]) -> list[int]:
    """Of sorted strings, each one's common prefix with the one before."""
    return [0, *(common(a, b, 0) for a, b in zip(strings, strings[1:], strict=False))]


def merge(runs: list[list[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge sorted runs of (string, common prefix with the one before in its run, payload) into one such run."""
    runs = [r for r in runs if r]
    k = len(runs)
    if not k:
        return
    size = 1
    while size < k:
        size *= 2
    at = [0] * k
    strings: list[bytes | None] = [r[0][0] for r in runs] + [None] * (size - k)
    shared = [0] * size  # of each run's head with the last winner
    loser = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix becomes that with the winner."""
        x, y = strings[a], strings[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if shared[a] != shared[b]:  # the one that shares more with the last winner is less; the prefixes stay known
            return (a, b) if shared[a] > shared[b] else (b, a)
        h = common(x, y, shared[a])
        first = h == len(x) or (h < len(y) and x[h] < y[h])
        if first:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while strings[winner] is not None:
        yield strings[winner], shared[winner], runs[winner][at[winner]][2]
        at[winner] += 1
        if at[winner] < len(runs[winner]):
            strings[winner], shared[winner] = runs[winner][at[winner]][:2]
        else:
            strings[winner] = None
        node = (winner + size) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def repeated(group: list[tuple[int, tuple]], rule: Rule = BYTES) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of stretches that windows found twice cover, of classes that occur once. ``group``: suffixes
    that share KEY bytes, in order, as (common prefix with the one before, (left, n, key, at, back, width))."""
    seen: dict[tuple, list] = {}
    marks: list[set[int]] = [set() for _ in group]
    for i in sorted({i for _, (_, _, _, _, back, width) in group for i in range(back - width, back + 1, rule.step)}):
        seen.clear()
        part = 0
        for g, (lcp, (left, n, _, _, back, width)) in enumerate(group):
            part += lcp < rule.length - i  # fewer bytes shared than the window has after the anchor
            if back - width <= i <= back:
                seen.setdefault((part, left[back - i :]), []).append(g)
        for same in seen.values():
            if len(same) > 1 or group[same[0]][1][1] > 1:
                for g in same:
                    marks[g].add(i)
    for g, found in enumerate(marks):
        _, (_, n, key, at, _, _) = group[g]
        if n > 1 or not found:
            continue
        for start, end in stretches([(at - i, at - i + rule.length) for i in found]):
            yield key, start, end


def stretches(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal stretches, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


RUN_SCHEMA = "part int, run long, seq int, lcp int, rest binary, left binary, n long, key long, at int, back int, width int"
RUN_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def sorted_runs(texts: DataFrame, splitters: list[bytes], rule: Rule = BYTES, shares: int = 1) -> DataFrame:
    """``texts`` has text and classes (array of n, key, at, back, width, crowded). Rows of runs, front-coded and cut at the
    splitters, each range in ``shares`` by a hash of the KEY bytes: the first suffix of a run in a part is whole. Crowded
    classes give rows with part -1 instead: run is the hash of a window and seq its distance to the anchor."""
    import bisect
    import zlib

    schema = pa.schema(list(zip([c.split()[0] for c in RUN_SCHEMA.split(", ")], RUN_TYPES, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            held.sort(key=lambda x: x[:2])
            lcps, rows, last = front_coded([x[1] for x in held]), [], -1
            for seq, ((part, right, left, *rest), lcp) in enumerate(zip(held, lcps, strict=True)):
                lcp = lcp if part == last else 0
                rows.append((part, number, seq, lcp, right[lcp:], left, *rest))
                last = part
            held.clear()
            number += 1
            return batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN_TYPES, strict=True)], schema=schema)

        crowded: list[tuple] = []
        for batch in batches:
            for k, classes in enumerate(batch.column("classes").to_pylist()):
                raw = rule.read(batch.column("text").slice(k, 1))[0].as_buffer().to_pybytes()
                hashes = Hasher(np.frombuffer(raw, np.uint8)) if any(c["crowded"] for c in classes) else None
                for c in classes:
                    first, last = c["at"] - c["back"], c["at"] - c["back"] + c["width"]
                    if c["crowded"]:
                        start = np.arange(first, last + 1, rule.step)
                        window = hashes.stretch(start, start + rule.length).view(np.int64).tolist()
                        crowded += [(-1, w, c["at"] - s, 0, b"", b"", c["n"], c["key"], c["at"], 0, 0) for s, w in zip(start.tolist(), window, strict=True)]
                    else:
                        key = raw[c["at"] : c["at"] + rule.key]
                        part = bisect.bisect_right(splitters, key) * shares + (zlib.crc32(key) % shares)
                        held.append((part, raw[c["at"] : last + rule.length], raw[first : c["at"]], c["n"], c["key"], c["at"], c["back"], c["width"]))
                if len(held) >= RUN:
                    yield flush()
                if len(crowded) >= RUN:
                    yield batch_of(crowded)
                    crowded = []
        if held:
            yield flush()
        if crowded:
            yield batch_of(crowded)

    return texts.select("text", "classes").mapInArrow(run, RUN_SCHEMA)


def merged(runs: DataFrame, rule: Rule = BYTES) -> DataFrame:
    """(key, start, end) from the runs of each part, merged."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def one_part(rows: list[dict]) -> list[tuple]:
        by: dict[int, list] = {}
        for r in rows:
            own = by.setdefault(r["run"], [])
            right = own[-1][0][: r["lcp"]] + r["rest"] if r["lcp"] else r["rest"]
            own.append((right, r["lcp"], (r["left"], r["n"], r["key"], r["at"], r["back"], r["width"])))
        out, group = [], []
        for _, lcp, payload in merge(list(by.values())):
            if lcp < rule.key and group:
                out += repeated(group, rule)
                group = []
            group.append((lcp, payload))
        if group:
            out += repeated(group, rule)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def done() -> pa.RecordBatch:
            found = one_part(rows)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[-1]["part"] != r["part"]:
                    yield done()
                rows.append(r)
        if rows:
            yield done()

    n = partitions(runs.sparkSession)
    return runs.repartitionByRange(n, "part").sortWithinPartitions("part", "run", "seq").mapInArrow(run, "key long, start int, end int")


def splitters_of(several: DataFrame, docs: DataFrame, parts: int, rule: Rule = BYTES) -> list[bytes]:
    """Quantiles of the KEY bytes at sampled classes' anchors: SAMPLE of them for each of at most SPLITTERS parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, at in enumerate(batch.column("at").to_pylist()):
                raw = rule.read(batch.column("text").slice(k, 1))[0].as_buffer().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[at : at + rule.key]], pa.binary())], names=["k"])

    some = drawn(several, SAMPLE * parts, "mh", "sh").select("key", "at")  # pairs of numbers
    text = docs.select("key", "text").join(F.broadcast(some), "key")
    if rule.step == 1:
        found = text.select(F.substring(F.col("text").cast("binary"), F.col("at") + 1, F.lit(rule.key)))
    else:
        found = text.select("text", "at").mapInArrow(run, "k binary")
    keys = sorted(bytes(r[0]) for r in found.collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def candidates(docs: DataFrame, rule: Rule = BYTES) -> DataFrame:
    """Anchors whose KEY bytes occur at another anchor too."""
    rows = cut(anchor_rows(docs, rule), "suffix-anchors")
    # stored, so that the join below stands right on two exchanges and Spark can split a passage that very many texts share
    twice = cut(rows.groupBy("mh").count().filter("count > 1").select("mh"), "suffix-twice")
    found = cut(rows.join(twice, "mh", "left_semi"), "suffix-candidates")
    remove(rows, twice)
    return found


def repeated_stretches(docs: DataFrame, rule: Rule = BYTES) -> DataFrame:
    """(key, start, end): stretches of keyed texts, as the rule reads them, that repeated windows cover; they may overlap."""
    spark = docs.sparkSession
    cands = candidates(docs, rule)
    rep = F.min(F.struct("key", "at", "back", "width")).alias("rep")
    classes = cut(cands.groupBy("mh", "sh").agg(F.count("*").alias("n"), rep).select("mh", "sh", "n", "rep.*"), "suffix-classes")
    sizes = cut(classes.groupBy("mh").agg(F.count("*").alias("k")).filter("k > 1"), "suffix-sizes")
    several = cut(classes.join(sizes, "mh").withColumn("crowded", F.col("k") > CROWD), "suffix-several")
    lists = several.groupBy("key").agg(F.collect_list(F.struct("n", "key", "at", "back", "width", "crowded")).alias("classes"))
    texts = docs.select("key", "text").join(lists, "key")
    parts = max(PARTS * partitions(spark), several.count() // PART_ROWS)
    splitters = splitters_of(several, docs, min(parts, SPLITTERS), rule)
    runs = cut(sorted_runs(texts, splitters, rule, -(-parts // SPLITTERS)), "suffix-runs")
    once = merged(runs.filter("part >= 0"), rule)
    windows = runs.filter("part < 0").select(F.col("run").alias("window"), "n", "key", F.col("seq").alias("i"), "at")
    twice = windows.groupBy("window").agg(F.sum("n").alias("k")).filter("k > 1").select("window")
    start = F.col("at") - F.col("i")
    crowd = windows.filter("n = 1").join(twice, "window", "left_semi").select("key", start.alias("start"), (start + rule.length).alias("end"))
    first = F.col("at") - F.col("back")
    copies = cands.join(classes.filter("n > 1").select("mh", "sh"), ["mh", "sh"], "left_semi").select("key", first.alias("start"), (first + F.col("width") + rule.length).alias("end"))
    found = cut(copies.unionByName(once).unionByName(crowd), "suffix-stretches")
    remove(cands, classes, sizes, several, runs)
    return found


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), length: int = LENGTH, words: int | None = None, count_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_passages and ``kept`` (the remaining bytes) of every document, and the columns
    named in ``carry`` led by "_": every byte goes that a string of ``length`` bytes covers which starts anywhere else too, in
    whatever document; with ``words`` also what a run of so many words covers that stands anywhere else too, whatever blanks
    are between them and however A to Z are written. n_passages counts the maximal stretches that such runs of words cover;
    with ``count_only`` they are counted but stay. All is judged on the input.

    A null text is empty; a null doc_id stays null. Rows that repeat a document repeat each other, so texts of ``length`` bytes
    or more vanish from both. A very long text is read in stretches. Other columns are dropped; an empty table gives an empty one.
    """
    docs = keyed(docs, carry)
    spans = repeated_stretches(docs, Rule(length)).withColumn("worded", F.lit(False))
    if words is not None:
        spans = spans.unionByName(repeated_stretches(docs, word_rule(words)).withColumn("worded", F.lit(True)))
    # a set: rows that repeat a document find the same stretches
    by = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end", "worded")).alias("spans"))
    made = [pa.field("n_bytes", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_spans", pa.int64()), pa.field("n_passages", pa.int64()), pa.field("kept", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, *spans in zip(batch.column("text"), *(batch.column(c) for c in ("starts", "ends", "worded")), strict=True):
                raw, at, kept = text.as_buffer().to_pybytes(), 0, []
                found = list(zip(*(x.as_py() or [] for x in spans), strict=True))
                worded = []
                if any(w for _, _, w in found):
                    first, last = word_places(raw)
                    worded = stretches([(int(first[a // SYMBOL]), int(last[b // SYMBOL - 1])) for a, b, w in found if w])
                cuts = stretches([(a, b) for a, b, w in found if not w] + (worded if not count_only else []))
                for a, b in cuts:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((len(raw), len(raw) - len(rest), len(cuts), len(worded), rest))
            own = [f for f in batch.schema if f.name not in ("text", "starts", "ends", "worded")]
            new = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), *new], schema=pa.schema([*own, *made]))

    joined = docs.join(by, "key", "left").select("doc_id", *[f"_{c}" for c in carry], "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"), F.col("spans.worded").alias("worded"))
    kinds = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, n_passages long, kept binary")
    schema = StructType([*joined.drop("text", "starts", "ends", "worded").schema.fields, *kinds.fields])
    return joined.mapInArrow(run, schema)


#: A passage of over 50 words.
PASSAGE_WORDS = 51


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passages: stretches covered by runs of over 50 words that stand elsewhere too, of which
    those under 400 bytes stay in the text."""
    found = remove_repeats(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS, count_only=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")
