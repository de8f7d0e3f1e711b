"""Jaccard join, suffix dedup, embeddings, components and the pipeline against plain versions."""

import collections
import hashlib
import random
import re
import string

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import components, jaccard, neighbours, suffixes

from .conftest import ODD, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_groups(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed):
    """Near copies of one text, some of which only link through others, and copies with other case and blanks."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(200)}" for _ in range(120)]
    docs, text = [], list(base)
    for i in range(25):
        docs.append((100 + i, " ".join(text)))
        text[rng.randrange(len(text))] = f"v{i}"
        if i % 6 == 0:
            text = list(base)
    return [*docs, (200, "  ".join(base).upper()), (201, " ".join(base))]


def test_jaccard_join(make):
    docs = [x for x in ODD if x[0] is not None] + [(12, "ONE"), (13, "É two"), (14, "é two")] + family(1)
    for size, percent in ((3, 90), (5, 80)):
        got = collections.defaultdict(set)
        for r in jaccard.near_duplicates(make(docs), size, percent).collect():
            got[r.doc_id].add((r.n_shingles, r.component_id))
        expected = plain_groups(docs, size, percent)
        assert got == {i: {v} for i, v in expected.items()}
    assert len({v[1] for v in expected.values()}) < len(expected)


def test_jaccard_on_the_sample_and_nothing(make, sf_docs):
    docs = [(r.doc_id, r.text) for r in sf_docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(sf_docs, 3, 90).collect()}
    assert got == plain_groups(docs, 3, 90)
    assert jaccard.near_duplicates(make(ODD).limit(0)).count() == 0
    none = jaccard.near_duplicates(make([(None, "a b c d e"), (None, "a b c d e"), (1, None)])).collect()
    assert sorted(map(tuple, none), key=str) == [(1, 0, 1), (None, 1, None), (None, 1, None)]


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(i, 200 + (i - 199) % 7) for i in range(200, 207)] + [(300, 300), (5, 6), (6, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 207)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(docs, length=400):
    count = collections.Counter(b[i : i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = collections.Counter()
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def passages():
    rng = random.Random(3)
    r = ["".join(rng.choices("abcdefgh ", k=500)) for _ in range(5)]
    common = "".join(rng.choices("abc ", k=330))
    setting = lambda: "".join(rng.choices("xyz ", k=200))
    crowd = [(500 + i, setting() + common + setting()) for i in range(12)]
    return crowd + [
        (None, r[0] + "X" + r[1]), (40, "a" * 1000), (41, r[0] + r[0]), (42, r[1][:399] + "q"), (43, r[1][:400] + "q"), (44, "é" * 600 + r[2]),
        (45, r[2] + r[3][:450]), (46, r[3]), (46, r[3]), (47, "ab" * 700), (48, r[4][:250] + "!" + r[4][251:]), (49, r[4]), (50, crowd[0][1][150:600]),
    ]


def digest(df):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def test_repeated_passages(make, sf_docs, monkeypatch):
    docs = make(ODD + passages()).select("doc_id", "text").union(sf_docs.select("doc_id", "text"))
    expected = plain_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    assert digest(suffixes.remove_repeats(docs)) == expected
    monkeypatch.setattr(suffixes, "SPLITTERS", 3)  # so that ranges are dealt out by hash too
    assert digest(suffixes.remove_repeats(docs)) == expected
    monkeypatch.setattr(suffixes, "CROWD", 2)
    assert digest(suffixes.remove_repeats(docs)) == expected
    assert suffixes.remove_repeats(make(ODD).limit(0)).count() == 0


def plain_word_repeats(docs, words, length=400):
    """What stays of each text: no byte of a repeated string of ``length`` bytes, none of a repeated run of ``words`` words."""
    raw = [t.encode() for _, t in docs]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    places = [[(len(t[: m.start()].encode()), len(t[: m.end()].encode()), m.group().translate(LOWER)) for m in WORD.finditer(t)] for _, t in docs]
    runs = collections.Counter(tuple(x[2] for x in w[i : i + words]) for w in places for i in range(len(w) - words + 1))
    out = collections.Counter()
    for (i, _), b, w in zip(docs, raw, places, strict=True):
        gone = bytearray(len(b))
        spans = [(p, p + length) for p in range(len(b) - length + 1) if count[b[p : p + length]] > 1]
        spans += [(w[k][0], w[k + words - 1][1]) for k in range(len(w) - words + 1) if runs[tuple(x[2] for x in w[k : k + words])] > 1]
        for a, z in spans:
            gone[a:z] = b"\1" * (z - a)
        out[(i, bytes(x for x, g in zip(b, gone, strict=True) if not g))] += 1
    return out


def test_passages_of_over_50_words_go(spark, make, sf_docs, monkeypatch):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefé", k=rng.randint(1, 5)))
    some = lambda n: " ".join(word() for _ in range(n))
    p51, p50, p90, crowd = some(51), some(50), some(90), some(53)
    assert len(p51.encode()) < 400
    docs = [(1, f"{some(9)} {p51} {some(30)}"), (2, f"{some(4)} {p51} {some(70)}"), (3, f"{some(9)} {p50} {some(8)}"), (4, f"{some(2)} {p50} {some(5)}"),
            (5, some(3) + " \n " + p90.upper().replace(" ", "\n ") + " end"), (6, p90), (7, f"{p90[:150]}x{p90[150:]} {some(3)}"),
            (8, "x" * 450 + some(5)), (9, "y " + "x" * 450), (10, p51 + "s"), (11, ""), (12, " \n")]
    docs += [(20 + i, f"{some(i + 1)} {crowd} {some(12)}") for i in range(12)]
    both = make(docs).select("doc_id", "text").union(sf_docs.select("doc_id", "text"))
    expected = plain_word_repeats([(r.doc_id, r.text) for r in both.collect()], 51)
    kept = lambda: collections.Counter((r.doc_id, bytes(r.kept)) for r in suffixes.remove_repeats(both, words=51).collect())
    assert kept() == expected
    monkeypatch.setattr(suffixes, "CROWD", 2)
    assert kept() == expected
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, make(docs), SF).collect()}
    assert p51 not in out[1] and p51 not in out[2] and out[3] == docs[2][1] and out[4] == docs[3][1] and "x" * 400 not in out[8]
    assert all(crowd not in out[20 + i] for i in range(12))


def test_long_texts_are_handled_in_stretches(monkeypatch):
    """The anchors of a text's windows are the same whether it is handled at once or in stretches."""
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 101, 5000, dtype=np.uint8)

    def owners(stretch):
        out = {}
        for c in range(0, len(raw), stretch):
            part = raw[c : c + stretch + suffixes.LENGTH - 1]
            if len(part) >= suffixes.LENGTH:
                for a, f, z in zip(*suffixes.anchors(part, 0, len(part), suffixes.Hasher(part)), strict=True):
                    out |= {c + p: c + int(a) for p in range(f, z + 1)}
        return out

    assert owners(10_000) == owners(700)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=8), max_size=9))
def test_merge_is_a_sort_with_common_prefixes(parts):
    runs = []
    for k, strings in enumerate(parts):
        strings = sorted(strings)
        runs.append([(s, h, (k, i)) for i, (s, h) in enumerate(zip(strings, suffixes.front_coded(strings) if strings else [], strict=True))])
    got = list(suffixes.merge(runs))
    strings = [s for s, _, _ in got]
    assert strings == sorted(s for p in parts for s in p)
    assert [h for _, h, _ in got][1:] == suffixes.front_coded(strings)[1:]


def plain_neighbours(rows, least):
    by, out = collections.defaultdict(list), {}
    for i, v, label in rows:
        out[i] = (0, i, True)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[label, len(v)].append((i, v))
    for group in by.values():
        ids, x = np.array([g[0] for g in group]), np.array([g[1] for g in group], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near, root = x @ x.T >= least, np.array([g[0] for g in group])
        for _ in ids:
            root = np.where(near, root, 1 << 62).min(axis=1)
        out |= {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1) - 1, root, strict=True)}
    return out


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 16))
    out = [(i, (centres[i % 30] + rng.normal(size=16) * 0.05).tolist(), i % 3) for i in range(240)]
    one = rng.normal(size=16)
    out += [(1000 + i, (one + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(300)]
    same = rng.normal(size=16).tolist()
    return out + [(2000 + i, same, 2) for i in range(50)] + [
        (3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, same, None), (3004, [3 * x for x in same], 2),
        (3005, [1.0, 2.0], 1), (3006, [2.0, 4.0], 1), (3007, [None] + [1.0] * 15, 1), (3008, [], 1), (3009, [1e200] * 16, 0), (3010, [2e200] * 16, 0), (3011, [5.0], 0),
    ]


def test_neighbours(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n long, id string")
    df = df.unionByName(spark.createDataFrame([(None, rows[0][1], rows[0][2], 1, "x")], df.schema))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect()}
    assert got.pop(None) == (0, None, True)
    expected = plain_neighbours(rows, 0.93)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(e[0] for e in expected.values())
    assert all(got[i][0] <= expected[i][0] for i in expected) and got.keys() == expected.keys()
    assert np.mean([got[i] == expected[i] for i in expected]) > 0.97
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_index_finds_links_across_cells(spark, monkeypatch):
    """A grid of at least 16 x 16 cells, links of cosines close to the least one across cell borders, fewer visits than cells."""
    monkeypatch.setattr(neighbours, "PER_CELL", 4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.99, (1500, 1))
    near = cosine * x + np.sqrt(1 - cosine**2) * side
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    entries = neighbours.packed(neighbours.entries_of(df)).cache()
    index = neighbours.codebooks(entries)
    assert all(len(c) >= 16 for c in index.books[12])
    placed = neighbours.with_cells(entries, index).cache()
    index.visits, recall = neighbours.measured_visits(placed, index, 0.93)
    assert recall >= neighbours.TARGET_RECALL
    assert 1 < index.visits < len(index.books[12][0]) * len(index.books[12][1])
    # ranks are places in the traversal
    cells = index.cells(near[:20])
    assert index.rank(x[:20], cells).tolist() == [1 + t.index(c) for t, c in zip([neighbours.multi_sequence(a, b, 10**6) for a, b in zip(*index.distances(x[:20]), strict=True)], cells, strict=True)]
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(df).collect()}
    expected = plain_neighbours(rows, 0.93)
    crossing = (index.cells(x) != index.cells(near)).sum()
    assert crossing > 500 and all(got[i] <= expected[i][0] for i in got)
    assert sum(got.values()) >= 0.9 * sum(e[0] for e in expected.values()) > 2000


def test_index_compares_few_pairs_and_finds_close_links(spark, monkeypatch):
    """12,600 vectors of 32 numbers, 600 of them planted next to others just above the least cosine; a grid of over 16 x 16
    cells, of which a vector meets the residents of those that it visits itself."""
    monkeypatch.setattr(neighbours, "PER_CELL", 32)
    monkeypatch.setattr(neighbours, "TARGET_RECALL", 0.9)  # of 24 links that are asked for, two may be left to the other side
    rng = np.random.default_rng(21)
    x = rng.normal(size=(12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(600, 32))
    side -= (side * x[:600]).sum(axis=1, keepdims=True) * x[:600]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, (600, 1))
    x = np.concatenate([x, cosine * x[:600] + np.sqrt(1 - cosine**2) * side])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    entries = neighbours.packed(neighbours.entries_of(df)).cache()
    index = neighbours.codebooks(entries)
    assert all(len(c) >= 16 for c in index.books[32])
    placed = neighbours.cut(neighbours.with_cells(entries, index), "test-cells")
    index.visits, index.recall = neighbours.measured_visits(placed, index, 0.93)
    found = neighbours.linked(placed, index, 0.93)
    links, compared = found.agg(F.sum("links"), F.sum("compared")).first()
    want = sum(int((x[i : i + 1000] @ x.T >= 0.93).sum()) for i in range(0, len(x), 1000)) - len(x)
    assert index.recall >= 0.9 and want >= 1200 and 0.95 * want <= links <= want
    assert compared < 0.1 * len(rows) * (len(rows) - 1) / 2, compared / (len(rows) * (len(rows) - 1) / 2)


def test_multi_sequence_is_in_order_of_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    grid = (a[:, None] + b).ravel()
    assert neighbours.multi_sequence(a, b, 20) == np.argsort(grid)[:20].tolist()


def test_language_stage_without_languages(spark, make):
    import corpus_pipeline

    docs = make([(1, None), (2, ""), (3, "12 34"), (4, "a clean text"), (5, "é")]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} == {4, 5}


def test_pipeline(spark, make):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = make([(10**6, None), (10**6 + 1, "12 34"), (10**6 + 2, "a clean short text of its own with mail me@here.org in it")]).select(docs.columns)
    docs = docs.union(more)
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        now = {r.doc_id: r.text for r in out.collect()}
        if name == "language":
            assert set(seen) - set(now) == {i for i, t in seen.items() if not re.search(r"[^\W\d_]", t or "")}
        if name == "near_duplicates":
            groups = plain_groups(seen.items(), 5, 80)
            assert set(now) == {i for i in seen if groups[i][1] == i}
        if name == "repeated_passages":
            kept = dict(plain_word_repeats(list(seen.items()), corpus_pipeline.PASSAGE_WORDS).keys())
            assert set(now) == {i for i, b in kept.items() if b == seen[i].encode() or b.strip(b" \t\n\x0b\x0c\r")}
            assert all(now[i] == t for i, t in seen.items() if kept[i] == t.encode())
            assert all(len(now[i].encode()) <= len(kept[i]) for i in now)
        if name == "personal_data":
            assert "[email]" in now[10**6 + 2] and not any(re.search(r"\w@\w+\.\w", t) for t in now.values())
        docs, seen = spark.createDataFrame(out.collect(), out.schema), now
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == set(seen)


def test_jaccard_of_one_id_with_several_texts(make):
    rng = random.Random(6)
    v, w = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "vw")
    near = lambda t: t + " end"
    rows = [(1, w), (1, v), (1, w), (2, near(w)), (3, near(v)), (4, None)]
    for order in (rows, rows[::-1]):
        got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(make(order), 3, 90).collect())
        assert got == {(1, 1): 3, (2, 1): 1, (3, 1): 1, (4, 4): 1}


def test_pipeline_stages_take_odd_tables(spark, make):
    """Empty tables, repeated rows, nulls, very long texts and columns whose names the operators use inside."""
    import corpus_pipeline

    names = ["email", "spans", "base", "score", "margin", "component_id", "_h", "n_removed", "kept", "key", "node", "token"]
    long = "quiet words of a long text " * 3000
    rows = ODD + [(70, long), (70, long), (71, "some words of a text that stands alone in here")]
    docs = make(rows).withColumns({c: F.lit(1) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        if name in ("near_duplicates", "repeated_passages"):  # their operators have tests of such tables of their own
            continue
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        got = collections.Counter(r[0] for r in out.select("doc_id").collect())
        if name == "language":
            assert out.columns == corpus_pipeline.COLUMNS and got[9] == 2 and got[70] == 2 and not got[1] and not got[2] and not got[3]
        if name == "personal_data":
            assert out.columns == corpus_pipeline.COLUMNS and got == collections.Counter(i for i, _ in rows)


def test_language_stage_rejects_what_no_language_explains(spark, make):
    """A text of another alphabet than any that was learned goes; lang becomes the language found."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = "\u0442\u0435\u043a\u0441\u0442 \u043d\u0430 \u0434\u0440\u0443\u0433\u043e\u043c \u044f\u0437\u044b\u043a\u0435 " * 20
    german = docs.filter("lang = 'de'").orderBy(F.desc("n_chars")).first().text
    more = make([(10**6, foreign), (10**6 + 1, german)]).select(docs.columns).withColumn("lang", F.when(F.col("doc_id") > 10**6, "en"))
    out = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs.union(more), SF).collect()}
    assert 10**6 not in out and out[10**6 + 1] == "de" and len(out) == docs.count() + 1


def test_counters_are_summed_as_a_tree(sf_docs, monkeypatch):
    signed = jaccard.cut(jaccard.signatures(sf_docs.repartition(9), 3), "test-signed")
    flat = jaccard.counters(signed)
    monkeypatch.setattr(jaccard, "FAN", 2)
    assert (jaccard.counters(signed) == flat).all() and flat.sum() > 10_000
