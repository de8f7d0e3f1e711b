"""Near duplicates among embeddings with an inverted multi-index.

Two codebooks, one for each half of the vectors, make a grid of cells. Each vector visits the cells in order of its
distance to their centroids (multi-sequence traversal) until the share of links is reached that a set of queries against all vectors calls for;
what it finds there is verified by cosine in double precision. Equal vectors are one entry with a multiplicity.

A cell's vectors are dealt to blocks of bounded size, and so are the vectors that visit it; each block of residents is
compared with each block of visitors as matrices, so a vector meets the residents of its own visits and no others. Two
vectors that visit each other's cells meet twice, and the lesser id's visit counts. A comparison gives counts and the links of a
spanning forest, never all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drawn, remove, table
from .components import components

#: Vectors that codebooks are fitted on, at most (chosen by hash). All vectors with an id divisible by EVERY ask all vectors for
#: their links, ASKING at a time, to measure how many cells must be visited.
SAMPLE_ROWS, ASKING, EVERY = 20_000, 4_096, 50
#: Share of the asked vectors' links that visits from their side alone must find (a link is found from either side); vectors of a label in a cell aimed at; vectors in a block.
TARGET_RECALL, PER_CELL, BLOCK = 0.97, 64, 128
#: A centroid needs so many vectors of the sample, so codebooks have up to SAMPLE_ROWS / LEAST_ROWS of them.
LEAST_ROWS = 8
#: So many made neighbours at the least cosine, of MADE asking vectors, must be found from one side too, however many links there are.
MADE, MADE_RECALL = 1_000, 0.85


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids, from evenly spaced starts in a fixed random order."""
    start = np.random.Generator(np.random.PCG64(7)).permutation(len(x))[:k]
    c = x[np.sort(start)].copy()
    for _ in range(rounds):
        near = np.concatenate([nearest(x[i : i + 1000], c).argmin(axis=1) for i in range(0, len(x), 1000)])
        for j in np.unique(near):
            c[j] = x[near == j].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c."""
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


@dataclass
class Index:
    """Codebooks of the halves for each vector length, and how many cells to visit."""

    books: dict[int, tuple[np.ndarray, np.ndarray]]
    visits: int
    #: Share of the asking vectors' links, among all vectors, that their own visits find; None if they have no link.
    recall: float | None = None

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.books[x.shape[1]]
        half = x.shape[1] // 2
        return nearest(x[:, :half], a), nearest(x[:, half:], b)

    def cells(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] not in self.books:
            return np.zeros(len(x), np.int64)
        a, b = self.distances(x)
        return a.argmin(axis=1) * b.shape[1] + b.argmin(axis=1)

    def rank(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """As the how manieth each row of x visits the cell that is named beside it."""
        if x.shape[1] not in self.books:
            return np.ones(len(x), np.int64)
        out = np.empty(len(x), np.int64)
        for i, (a, b) in enumerate(zip(*self.distances(x), strict=True)):
            far = a[cells[i] // len(b)] + b[cells[i] % len(b)]
            # for each cell row, how many of the sorted columns are nearer
            out[i] = np.searchsorted(np.sort(b), far - a - 1e-9 * (1 + abs(far)), "left").sum() + 1
        return out

    def traverse(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each vector visits, nearest first."""
        if x.shape[1] not in self.books:
            return [[0]] * len(x)
        return [multi_sequence(a, b, self.visits) for a, b in zip(*self.distances(x), strict=True)]


def multi_sequence(a: np.ndarray, b: np.ndarray, most: int) -> list[int]:
    """The ``most`` cells (i, j), as i * len(b) + j, with the least a[i] + b[j], in order, without looking at the rest."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, pushed, out = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append(int(oa[i]) * len(b) + int(ob[j]))
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in pushed:
                pushed.add((u, v))
                heapq.heappush(heap, (a[oa[u]] + b[ob[v]], u, v))
    return out


def unit(raw: list[bytes] | pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(r.as_buffer().to_pybytes() if hasattr(r, "as_buffer") else r for r in raw), "<f8").reshape(-1, dim).copy()
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(raw: pa.Array, dim: int) -> np.ndarray:
    """Binary rows of doubles as they lie in memory."""
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<f8").reshape(-1, dim) if len(raw) else np.zeros((0, dim))


def codebooks(entries: DataFrame) -> Index:
    """Two codebooks for each vector length, from a sample."""
    sizes = entries.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n"))
    sizes = {r.dim: r.n for r in sizes.orderBy(F.desc("n"), "dim").limit(1000).collect()}
    rows = drawn(entries.filter(F.col("dim") > 1), SAMPLE_ROWS, "id").select("dim", "raw").collect()
    index = Index({}, 1)
    for dim in {r.dim for r in rows}:
        x = unit([bytes(r.raw) for r in rows if r.dim == dim], dim)
        k = int(max(1, min(len(x) // LEAST_ROWS, round((sizes.get(dim, 1) / PER_CELL) ** 0.5))))
        index.books[dim] = kmeans(x[:, : dim // 2], k), kmeans(x[:, dim // 2 :], k)
    return index


def asked(entries: DataFrame, part: int, parts: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of one of ``parts`` blocks of the asking vectors, by label and length; a block has about ASKING."""
    own = (F.col("dim") > 1) & (F.pmod("id", F.lit(EVERY)) == 0) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
    few = entries.filter(own).select("id", "label", "dim", "raw").orderBy("id").collect()
    out = {}
    for key in sorted({(r.label, r.dim) for r in few}):
        of = [r for r in few if (r.label, r.dim) == key]
        out[key] = np.array([r.id for r in of]), unit([bytes(r.raw) for r in of], key[1])
    return out


def ranks(placed: DataFrame, index: Index, asking: dict, least: float) -> DataFrame:
    """rank, n: how many links of the asking vectors, among all vectors, lie in the cell that they visit as the rank-th.
    Ranks are rounded up to powers of 1.1."""
    shared = placed.sparkSession.sparkContext.broadcast((index, asking))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, asking = shared.value
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            for key in sorted(set(keys) & set(asking)):
                of = np.array([i for i, k in enumerate(keys) if k == key])
                x, ids, cells = unit(batch.column("raw").take(pa.array(of)), key[1]), *(np.array(batch.column(c).to_pylist())[of] for c in ("id", "cell"))
                own, q = asking[key]
                i, j = np.nonzero((q @ x.T >= least) & (own[:, None] != ids))
                if len(i):
                    rank = np.ceil(1.1 ** np.ceil(np.log(index.rank(q[i], cells[j])) / np.log(1.1))).astype(np.int64)
                    found, n = np.unique(rank, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["rank", "n"])

    return placed.select("id", "label", "dim", "raw", "cell").mapInArrow(run, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n"))


def made_ranks(index: Index, asking: dict, least: float) -> np.ndarray:
    """The ranks of the cells of made neighbours: each asking vector turned to the least cosine in a random direction."""
    out, rng, left = [1], np.random.Generator(np.random.PCG64(11)), MADE
    for _, q in asking.values():
        q, left = q[:left], left - len(q[:left])
        side = rng.normal(size=q.shape)
        side -= (side * q).sum(axis=1, keepdims=True) * q
        side /= np.sqrt((side * side).sum(axis=1, keepdims=True))
        near = least * q + np.sqrt(1 - least**2) * side
        out += index.rank(q, index.cells(near)).tolist()
    return np.array(out)


def measured_visits(placed: DataFrame, index: Index, least: float) -> tuple[int, float | None]:
    """(cells to visit so that TARGET_RECALL of the asking vectors' links among all vectors are found from their side alone,
    and MADE_RECALL of made neighbours' too; the share of the links that so many visits find, or None without a link)."""
    parts = max(1, -(-placed.filter((F.col("dim") > 1) & (F.pmod("id", F.lit(EVERY)) == 0)).count() // ASKING))
    found: dict[int, int] = {}
    made = 1
    for part in range(parts):
        asking = asked(placed, part, parts)
        if not part:
            made = int(np.quantile(made_ranks(index, asking, least), MADE_RECALL, method="higher"))
        for r in ranks(placed, index, asking, least).collect():
            found[r["rank"]] = found.get(r["rank"], 0) + r["n"]
    if not found:
        return made, None
    at = np.array(sorted(found))
    n = np.cumsum([found[r] for r in at])
    visits = max(made, int(at[np.searchsorted(n, TARGET_RECALL * n[-1])]))
    return visits, float(n[at <= visits][-1] / n[-1])


def entries_of(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: id (the least vec_id of equal ones), label, dim, n (how many are equal), raw (doubles), and two hashes."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "label", x.alias("x")).filter(F.coalesce(fine, F.lit(False)))
    rows = rows.select("vec_id", "label", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))
    return rows.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("x").alias("x"))


def packed(entries: DataFrame) -> DataFrame:
    schema = pa.schema([("label", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, "<f8").tobytes() for v in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "h1", "h2", "id", "n")), pa.array([len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())], schema=schema)

    return entries.withColumn("label", F.col("label").cast("string")).mapInArrow(run, "label string, h1 long, h2 long, id long, n long, dim int, raw binary")


def with_cells(entries: DataFrame, index: Index) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = np.array(batch.column("dim").to_pylist(), np.int64), np.zeros(len(batch), np.int64)
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                cells[of] = index.cells(unit(batch.column("raw").take(pa.array(of)), int(dim)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "id", "n", "raw")), pa.array(cells)], names=["label", "dim", "id", "n", "raw", "cell"])

    return entries.select("label", "dim", "id", "n", "raw").mapInArrow(run, "label string, dim int, id long, n long, raw binary, cell long")


PLACE, MEMBER = ["label", "dim", "cell"], ["id", "n", "home", "visits", "raw"]


def blocks_of(placed: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """(residents, visitors): blocks of the vectors that lie in a cell, and of those that visit it, as one row each with the
    members' ids, ns, homes (the cells they lie in), visits and unit vectors."""

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, visits, rows = np.array(batch.column("dim").to_pylist(), np.int64), [None] * len(batch), [b""] * len(batch)
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                x = unit(batch.column("raw").take(pa.array(of)), dim)
                for i, v, row in zip(of.tolist(), index.traverse(x), x, strict=True):
                    visits[i], rows[i] = v, row.astype("<f8").tobytes()
            own = [batch.column(c) for c in ("label", "dim", "id", "n", "cell")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.binary()), pa.array(visits, pa.list_(pa.int64()))], names=["label", "dim", "id", "n", "cell", "raw", "visits"])

    travelled = cut(placed.mapInArrow(travel, "label string, dim int, id long, n long, cell long, raw binary, visits array<long>"), "neighbours-visits")

    def dealt(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy(*PLACE).agg(F.ceil(F.count("*") / (BLOCK // 2)).alias("blocks"))
        own = rows.join(sizes, PLACE).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
        own = own.repartition(*PLACE, "block")  # else a cell's blocks stay together where the join put them
        blocks = own.groupBy(*PLACE, "block").agg(F.collect_list(F.struct("id", "n", "home", "visits", "raw")).alias("m"))
        return blocks.select(*PLACE, *[F.col(f"m.{c}").alias(c) for c in MEMBER])

    residents = dealt(travelled.withColumn("home", F.col("cell")))
    visitors = dealt(travelled.withColumnRenamed("cell", "home").withColumn("cell", F.explode("visits")))
    return cut(residents, "neighbours-residents"), cut(visitors, "neighbours-visitors")


def compare(pairs: DataFrame, least: float) -> DataFrame:
    """(id, links, root, compared) of each entry with a link, for each pair of a residents' and a visitors' block: ``links`` counts
    multiplicities of entries met, ``root`` is the least entry of its component within the pair. A row with a null id
    has the number of pairs compared."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("compared", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, dim in enumerate(batch.column("dim").to_pylist()):
                here, there = ({c: batch.column(f"{side}{c}")[k].values for c in MEMBER} for side in ("r_", "v_"))
                x, y = (matrix(side["raw"], dim) for side in (here, there))
                i, j = (side["id"].to_numpy() for side in (here, there))
                near = x @ y.T >= least
                near &= i[:, None] != j
                # where the resident visits the visitor's home too, they meet there again, and one of the two counts
                for b in np.flatnonzero(near.any(axis=0)).tolist():
                    home = there["home"][b].as_py()
                    for a in np.flatnonzero(near[:, b] & (i < j[b])).tolist():
                        near[a, b] = home not in here["visits"][a].as_py()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([near.size])], schema=schema)
                if not near.any():
                    continue
                n, m = (side["n"].to_numpy() for side in (here, there))
                rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                links = np.concatenate([near[rows] @ m, near[:, cols].T @ n])
                # entries on both sides are one
                ids, at = np.unique(np.concatenate([i[rows], j[cols]]), return_inverse=True)
                total = np.bincount(at, links, len(ids)).astype(np.int64)
                a, b = np.nonzero(near[np.ix_(rows, cols)])
                a, b, root = at[a], at[len(rows) + b], np.arange(len(ids))
                while True:
                    new = root.copy()
                    np.minimum.at(new, a, root[b])
                    np.minimum.at(new, b, root[a])
                    if (new == root).all():
                        break
                    root = new
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(ids[root]), pa.nulls(len(ids), pa.int64())], schema=schema)

    return pairs.mapInArrow(run, "id long, links long, root long, compared long")


def linked(placed: DataFrame, index: Index, least: float) -> DataFrame:
    """What ``compare`` gives for all visits, as a stored table."""
    residents, visitors = blocks_of(placed, index)
    side = lambda rows, mark: rows.select(*PLACE, *[F.col(c).alias(f"{mark}{c}") for c in MEMBER])
    pairs = side(residents, "r_").join(side(visitors, "v_"), PLACE).drop("label", "cell")
    found = cut(compare(pairs, least), "neighbours-links")
    remove(residents, visitors)
    return found


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector: links are pairs of one label with a cosine of at least ``least``.

    Unusable vectors (null, empty, zero, with null or non-finite components, or without a label) link with nothing; nor do
    vectors of different lengths. Rows that repeat a vec_id count as vectors of their own but share their links. A row with a null
    vec_id stays, links with nothing, and nothing links with it. A very long vector is one entry like any other: a block
    holds BLOCK of them, so memory grows with their length. Other columns are dropped; an empty table gives an empty one.
    """
    entries = cut(packed(entries_of(vectors)), "neighbours-entries")
    index = codebooks(entries)
    placed = cut(with_cells(entries, index), "neighbours-cells")
    index.visits, index.recall = measured_visits(placed, index, least)
    found = linked(placed, index, least).filter(F.col("id").isNotNull())
    remove(placed)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "component")
    known = entries.select("label", "h1", "h2", "id", "n").join(links, "id", "left").join(parts, "id", "left")
    known = known.select(F.col("label").alias("_label"), "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("_label"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))
    joined = rows.join(known, ["_label", "h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    own = F.when(F.col("vec_id").isNotNull(), F.col("n_links"))
    return joined.select("vec_id", F.coalesce(own, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_multi_index(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
