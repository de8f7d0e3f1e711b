"""Similarity join of documents on the Jaccard index of their word shingles.

Documents with equal sets become one class. Shingles are ordered rare-first by counts over all documents; two sets that
reach the threshold share a shingle in their prefixes, so only prefix shingles are joined. Length, positional and suffix
filters (the last on parity sketches, which bound the symmetric difference from below) come before a pair's one exact
verification on whole sets.

Links are found in two passes, neither of which enumerates the pairs of a group. First every prefix shingle links its
documents to the least of them, of which each document tries the least that the filters leave. Then, where a shingle's documents still lie in several components, those outside the
largest one meet all others of that shingle. Pairs within one component can't change a component, so none is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, table
from .components import components
from .hashing import mix, shingle_sets, slices

#: Shingles are counted by hash in so many counters, 16 MB whatever the input: enough to tell which are frequent. A task
#: counts up to 255 in each, and a counter takes in so many shingles at a time.
COUNTERS, CHUNK, AT_ONCE = 1 << 22, 1 << 12, 1 << 21
SKETCH = 256
#: Rows of one chunk that are summed in one group, about: 4 to 16 KB each.
FAN = 512
#: Bits for each thing that a bit set marks, and bits at most (16 MB). A fuller set lets more pass, and joins do the rest.
BITS_EACH, MOST_BITS = 16, 1 << 27


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        for lo, hi in slices(batch.column("text")):
            yield batch.column("doc_id").slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo)


def _per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values``, modulo 2 ** 64."""
    out = np.zeros(len(sizes), values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def set_hash(hashes: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """One hash of each set, the same whatever the order of its shingles."""
    return _per_text(mix(hashes ^ np.uint64(k)), sizes).view(np.int64)


def slot_of(hashes: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int32)


def fresh(ids: pa.Array, h1: np.ndarray, seen: set) -> np.ndarray:
    """Which rows a task hasn't met before: rows that repeat id and set are worth one."""
    out = np.zeros(len(h1), bool)
    for i, key in enumerate(zip(ids.to_pylist(), h1.tolist(), strict=True)):
        if key not in seen:
            seen.add(key)
            out[i] = True
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), two hashes of the set, its sketch; and rows with ``chunk`` and ``counts``: how often shingles occur."""
    names = ["doc_id", "n", "h1", "h2", "sketch", "chunk", "counts"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting = np.zeros(COUNTERS, np.uint8), []

        def count() -> None:
            slots, n = np.unique(np.concatenate(waiting), return_counts=True)
            counts[slots] = np.minimum(counts[slots] + n, 255)
            waiting.clear()

        for ids, texts in _batches(batches):
            hashes, sizes = shingle_sets(texts, size)
            waiting.append(slot_of(hashes))
            if sum(map(len, waiting)) > AT_ONCE:
                count()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            odd = np.bincount(owner * SKETCH + (hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=len(sizes) * SKETCH) & 1
            bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(bits))
            h1, h2 = (set_hash(hashes, sizes, k) for k in (1, 2))
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(h1), pa.array(h2), sketch, none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if waiting:
            count()
        for at in range(0, COUNTERS, CHUNK * 64):
            rows = [counts[i : i + CHUNK].tobytes() for i in range(at, at + CHUNK * 64, CHUNK)]
            none = pa.nulls(len(rows))
            chunk = pa.array(np.arange(at // CHUNK, at // CHUNK + len(rows), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([none.cast(t) for t in schema.types[:5]] + [chunk, pa.array(rows, pa.binary())], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>, chunk int, counts binary")


def counters(signed: DataFrame) -> np.ndarray:
    """The shingle counters, summed over all tasks; COUNTERS numbers at any size of the input. They are summed as a tree: a group has
    about FAN tasks' counts of one chunk, whatever the number of tasks."""

    def add(kind: type):
        def run(group: pa.Table) -> pa.Table:
            total = np.zeros(CHUNK, np.int64)
            for raw in group.column("counts"):
                total += np.frombuffer(raw.as_buffer(), kind)
            total = np.minimum(total, (1 << 31) - 1).astype(np.int32)
            return pa.table({"chunk": group.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

        return run

    parts, kind = signed.filter(F.col("chunk").isNotNull()).select("chunk", "counts"), np.uint8
    tasks = parts.filter("chunk = 0").count()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        dealt = parts.withColumn("branch", F.floor(F.rand(7) * tasks))
        parts = cut(dealt.groupBy("chunk", "branch").applyInArrow(add(kind), "chunk int, counts binary"), "jaccard-counters")
        kind = np.int32
    out = np.zeros(COUNTERS, np.int32)
    summed = parts.groupBy("chunk").applyInArrow(add(kind), "chunk int, counts binary").toArrow()
    for chunk, raw in zip(summed.column("chunk").to_pylist(), summed.column("counts"), strict=True):
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(raw.as_buffer(), np.int32)
    return out


def prefixes(docs: DataFrame, size: int, percent: int, frequency: np.ndarray) -> DataFrame:
    """doc_id, h1, tokens: each set's rarest shingles, so many that two sets over the threshold must share one."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()
        for ids, texts in _batches(batches):
            hashes, sizes = shingle_sets(texts, size)
            h1 = set_hash(hashes, sizes, 1)
            new = fresh(ids, h1, seen) & (sizes > 0)
            count = often[slot_of(hashes)]
            keep, take, end = [], sizes - -(-percent * sizes // 100) + 1, np.cumsum(sizes)
            take[~new] = 0
            for n, p, e in zip(sizes.tolist(), take.tolist(), end.tolist(), strict=True):
                if p:
                    keep.append(e - n + np.lexsort((hashes[e - n : e], count[e - n : e]))[:p])
            if not keep:
                continue
            tokens = hashes[np.concatenate(keep)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take[new])).astype(np.int32)), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(new)), pa.array(h1[new]), lists], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, h1 long, tokens array<long>")


def marked(keys: DataFrame) -> np.ndarray:
    """A bit set with the bit of the hash of every key (a table of one column of longs), sized by how many there are."""
    bits = 1 << 15
    while bits < min(MOST_BITS, BITS_EACH * keys.count()):
        bits *= 2
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits)) + 1  # bitmap functions count from 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def passing(rows: DataFrame, key: str, marks: np.ndarray) -> DataFrame:
    """The rows whose key (a long) has its bit set, and few others; no row moves."""
    shared, own = rows.sparkSession.sparkContext.broadcast(marks), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _passing(batch, shared.value).select(own)

    return _placed(rows, key, marks).mapInArrow(run, rows.schema)


def _placed(rows: DataFrame, key: str, marks: np.ndarray) -> DataFrame:
    return rows.withColumn("_at", F.pmod(F.xxhash64(key), F.lit(8 * len(marks))))


def _passing(batch: pa.RecordBatch, marks: np.ndarray) -> pa.RecordBatch:
    at = batch.column("_at").to_numpy(zero_copy_only=False)
    return batch.filter(pa.array((marks[at >> 3] >> (at & 7)) & 1 == 1))


def whole_sets(docs: DataFrame, size: int, marks: np.ndarray) -> DataFrame:
    """doc_id, h1 and the whole set of the documents whose id has its bit set, and of few others, from each task once for each
    distinct pair of id and set."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for ids, texts in _batches(_passing(batch, shared.value) for batch in batches):
            hashes, sizes = shingle_sets(texts, size)
            h1 = set_hash(hashes, sizes, 1)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h1), lists], schema=schema).filter(pa.array(fresh(ids, h1, seen)))

    return _placed(docs, "doc_id", marks).mapInArrow(run, "doc_id long, h1 long, set array<long>")


def may_link(percent: int) -> Column:
    """Length and positional filter of a pair (doc, n, pos) and (doc2, n2, pos2) that shares a prefix shingle."""
    length = (100 * F.least("n", "n2")) >= (percent * F.greatest("n", "n2"))
    most = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1)
    return length & ((100 + percent) * most >= percent * (F.col("n") + F.col("n2")))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, one_each: bool = False) -> DataFrame:
    """The pairs (a, b) of nodes that reach the threshold: suffix filter on sketches, then whole sets, once for each pair.
    With ``one_each`` only the pair with the least b is looked at for each a."""
    side = lambda x: classes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "doc_id", "h1", "sketch")])
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    apart = sum((F.bit_count(F.get("sketch_a", i).bitwiseXOR(F.get("sketch_b", i))) for i in range(1, SKETCH // 64)), F.bit_count(F.get("sketch_a", 0).bitwiseXOR(F.get("sketch_b", 0))))
    close = both.filter((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).drop("sketch_a", "sketch_b")
    if one_each:
        close = close.groupBy("a").agg(F.min(F.struct("b", *[c for c in close.columns if c not in "ab"])).alias("m")).select("a", "m.*")
    close = cut(close, "jaccard-pairs")
    ids = cut(close.select(F.col("doc_id_a").alias("doc_id")).union(close.select("doc_id_b")).distinct(), "jaccard-wanted")
    sets = cut(whole_sets(_texts(docs), size, marked(ids)), "jaccard-sets")
    of = lambda x: sets.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("h1").alias(f"h1_{x}"), F.col("set").alias(f"set_{x}"))
    full = close.join(of("a"), ["doc_id_a", "h1_a"]).join(of("b"), ["doc_id_b", "h1_b"])
    shared = full.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("i"))
    links = cut(shared.filter(100 * F.col("i") >= percent * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b"), "jaccard-links")
    remove(close, ids, sets)
    return links


def classes_of(usable: DataFrame) -> DataFrame:
    """One row for each distinct set: h1, h2, n, doc_id (the least with it), sketch and node, a number of its own: doc_id, or
    a hash where a doc_id comes with several sets."""
    groups = cut(usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "jaccard-groups")
    several = groups.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1")
    node = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "h1", "h2", "n"))
    classes = cut(groups.join(several, "doc_id", "left").withColumn("node", node).drop("k"), "jaccard-classes")
    remove(groups)
    return classes


def met_again(shared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that share a prefix shingle across components, of lengths that may link. Documents outside a shingle's
    largest component meet all others of it whose length is in their own class of lengths or the next."""
    placed = shared.select("token", "node", "n", "pos").join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed, "jaccard-placed")
    by = placed.groupBy("token", "component").count()
    largest = by.groupBy("token").agg(F.count("*").alias("k"), F.max_by("component", F.struct("count", "component")).alias("largest")).filter("k > 1").drop("k")
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)) if percent < 100 else F.col("n").cast("long")
    open_rows = cut(placed.join(largest, "token").withColumn("level", level), "jaccard-open")
    minor = open_rows.filter(F.col("component") != F.col("largest")).select("token", F.explode(F.array(*[F.col("level") + i for i in (-1, 0, 1)])).alias("level"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("component").alias("component2"))
    once = (F.col("component") == F.col("largest")) | (F.col("node") < F.col("node2"))
    across = open_rows.join(minor, ["token", "level"]).filter((F.col("component") != F.col("component2")) & once & may_link(percent))
    pairs = cut(across.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct(), "jaccard-across")
    remove(placed, open_rows)
    return pairs


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: documents link where 100 * intersection >= percent * union of
    their sets of ``size``-word shingles, and component_id is the least doc_id reachable by links, the own one included.

    Null or wordless texts have no shingle and link with nothing. Rows that repeat a doc_id with the same text are each
    returned, and so are rows with one doc_id and several texts, each with the links of its own text. A null doc_id stays
    null and links with nothing. A very long text is handled alone. Other columns are dropped; an empty table gives an empty
    one.
    """
    signed = cut(signatures(docs, size), "jaccard-signatures")
    frequency = counters(signed)
    seen = cut(signed.filter(F.col("chunk").isNull()).drop("chunk", "counts"), "jaccard-seen")
    remove(signed)
    usable = seen.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = classes_of(usable)
    # of each class one document's prefix
    rows = prefixes(docs, size, percent, frequency).join(classes.select("doc_id", "h1", "node", "n"), ["doc_id", "h1"]).select("node", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    prefix = cut(rows, "jaccard-prefixes")
    # most shingles stand in one prefix only; they go where they lie
    twice = cut(prefix.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token"), "jaccard-twice")
    able = cut(passing(prefix, "token", marked(twice)), "jaccard-able")
    remove(prefix, twice)
    least = F.min(F.struct("node", "n", "pos")).alias("l")
    leaders = cut(able.groupBy("token").agg(F.count("*").alias("k"), least).filter("k > 1").select("token", F.col("l.node").alias("node2"), F.col("l.n").alias("n2"), F.col("l.pos").alias("pos2")), "jaccard-leaders")
    shared = cut(able.join(leaders, "token"), "jaccard-shared")
    remove(able, leaders)
    stars = shared.filter((F.col("node") != F.col("node2")) & may_link(percent)).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    first = verified(stars, docs, classes, size, percent, one_each=True)
    # second pass: shingles whose documents lie in several components
    found = components(first)
    across = met_again(shared, found, percent)
    remove(shared)
    second = verified(across, docs, classes, size, percent)
    remove(across)
    joined = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second))
    linked = cut(joined.join(classes.select("node", "doc_id"), "node").select("node", "component", "doc_id"), "jaccard-linked")
    names = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    roots = classes.join(linked.join(names, "component").select("node", "component_id"), "node", "left").select("h1", "h2", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    ids = usable.select("h1", "h2", "n", "doc_id").join(roots, ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = seen.filter(~((F.col("n") > 0) & F.col("doc_id").isNotNull())).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return ids.unionByName(rest)


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)
