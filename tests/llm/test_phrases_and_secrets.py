"""Phrase collocations, spelling variants and secret scans against plain versions."""

import collections
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import automata, collocations, secret_scans, tries, variants

from .conftest import ODD

# ---- secrets


def plain_secrets(text, rules=secret_scans.RULES):
    out = []
    for rank, r in enumerate(rules):
        out += [(m.start(), rank, m.end(), r.kind) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    return sorted(out)


BITS = ["token", "secret", "password", "passwd", "api_key", "apikey", "ToKeN", "=", ":", " ", "'", '"', "a", "0f", "é", "😀", "\n", "AKIA", "ABC0", "abcdef0123", "xoxb-", "ghp_", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "://", "user:", "p@", "@", "Bearer ", "sk_live_", "Z", "_", "-"]


def test_one_automaton_finds_what_each_pattern_finds():
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts += ["", "a" * 40_000, "é" * 3000 + "token = abcdefghijklmnop" + "0" * 40_000, "token=secret: abcdefghijklmnop", "eyJ" * 5000]
    got = secret_scans.spans_of(pa.array(texts), secret_scans.scanner()).to_pylist()
    assert sum(map(len, got)) > 800
    for text, spans in zip(texts, got, strict=True):
        assert [tuple(s.values()) for s in spans] == plain_secrets(text), text[:200]


@pytest.mark.parametrize("pattern", ["a(b|cd)+e?", r"[^a-y\x0A]{2,3}x", "(?i:ab)c*d", r"a\.b", "x{3}y{0,2}z", "[]a-]+", r"\x41b+"])
def test_compiled_patterns_accept_what_re_does(pattern):
    whole, back = automata.compile_patterns([pattern], anchored=True), automata.compile_patterns([pattern], reverse=True)
    letters = "abcdexyzA\n]-."
    for size in range(1, 5):
        for chars in itertools.product(letters if size < 4 else "abxz", repeat=size):
            text, state = "".join(chars), 1
            for b in text.encode():
                state = int(whole.table[state * whole.width + whole.kind[b]])
            assert bool(whole.ends[state]) == bool(re.fullmatch(pattern, text)), text
            states = back.states(np.frombuffer(text.encode()[::-1], np.uint8))
            begins = [bool(back.ends[s]) for s in states[::-1]]
            assert begins == [any(re.compile(pattern).fullmatch(text, i, j) for j in range(i + 1, size + 1)) for i in range(size)], text


def test_automaton_is_minimal_and_odd_patterns_are_errors():
    # a followed by any number of b or c: nothing begun, within the match
    assert len(automata.compile_patterns(["a(b|c)*"]).ends) == 2
    assert len(automata.compile_patterns(["ax|bx", "cx"]).ends) == 5
    for bad in ("a*", "(a", "a)", r"\d", "é", "^a", "(?=a)"):
        with pytest.raises((ValueError, IndexError)):
            automata.compile_patterns([bad])


def test_secret_columns_and_odd_tables(make):
    docs = make([*ODD, (30, 'é token = "abcdef0123456789abcd" AKIAABCDEFGHIJKLMN'), (31, "x sk_live_abcdefghijklmnopqrstuv")])
    got = secret_scans.with_secrets(docs)
    assert got.columns == [*docs.columns, "spans"] and got.count() == docs.count()
    for r in got.collect():
        assert [tuple(s) for s in r.spans] == plain_secrets(r.text)
    clean = {r.doc_id: r.text for r in secret_scans.redact(docs.withColumn("spans", F.lit(1))).filter("doc_id >= 30").collect()}
    assert clean == {30: "é [assign]\" [access]", 31: "x [payment]"}
    assert secret_scans.with_secrets(docs.limit(0)).count() == 0


# ---- spelling variants


def plain_variants(docs):
    count = collections.Counter()
    for i, text in docs:
        for m in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            x = re.sub("[A-Z]", lambda z: z[0].lower(), m)
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            if h % 199 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            if len(x) >= 6:
                count[x] += 1
    count = {w: n for w, n in count.items() if n >= 5}

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in count if one_apart(w, x)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return sorted(out)


def some_words(rng):
    letters = "abcdeéÿß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(40)]
    for w in list(words):
        for _ in range(3):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    # chains of forms, repeated bigrams, and words whose bigrams tie
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "abababa", "bababa", "ÀÀÀÀÀÀ", "÷×÷×÷×"]
    return words


def test_variants_match_a_plain_version(make):
    rng = random.Random(3)
    words = some_words(rng)
    docs = [(i, " ".join(rng.choice(words).upper().replace("SS", "ß") if rng.random() < 0.2 else words[int(len(words) * rng.random() ** 3)] for _ in range(300)) + "-tail9") for i in range(30)]
    docs += [(d, t) for d, t in ODD] + [(40, "chained " * 500 + "chaineds " * 80 + "chainedss " * 12 + "chainedsss " * 9), (41, "bbbbbbb")]
    got = variants.spelling_variants(make(docs))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_variants(docs), key=str)
    rows = {r.word: r for r in got.collect()}
    assert rows["chainedss"].form == "chaineds" and rows["chainedss"].root == "chained"
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_every_two_words_at_one_edit_meet(spark):
    """Whatever the order of bigrams, a pivot of one is in the other's prefix."""
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(300)})
    got = variants.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    same = {(r.a, r.b) for r in got.collect()}
    deleted = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    want = {(a, b) for a in words for b in words if a < b and ((len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or a in deleted(b) or b in deleted(a))}
    assert same == want and got.count() == len(want)


def test_pivots_are_disjoint_and_cheapest():
    rng = np.random.default_rng(2)
    for places in (5, 6, 9):
        cost = np.full((200, places), np.inf)
        for row in cost:
            row[rng.choice(places, 3, replace=False)] = rng.integers(0, 50, 3)
        for row, (a, b) in zip(cost, variants.pivots(cost), strict=True):
            best = min(row[i] + row[j] for i in range(places) for j in range(i + 2, places))
            assert b - a >= 2 and row[a] + row[b] == best


def test_crc32_of_runs_after_a_head():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    head = np.array([zlib.crc32(str(i).encode()) for i in range(200)], np.uint32)
    got = variants.crc32(head, data, np.cumsum(size) - size, size)
    assert got.tolist() == [zlib.crc32(f"{i}".encode() + p) for i, p in enumerate(parts)]


def test_variants_of_odd_tables(make):
    assert variants.spelling_variants(make(ODD).limit(0)).count() == 0
    assert variants.spelling_variants(make([(1, "too short to be words"), (2, None)])).count() == 0
    got = variants.spelling_variants(make([(None, "lonely " * 5), (7, "lonely " * 3)])).collect()
    assert sorted(map(tuple, got)) == plain_variants([(None, "lonely " * 5), (7, "lonely " * 3)])


# ---- phrases


def plain_phrases(docs, least, top):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda z: z[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    some = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    longer = collections.Counter()
    for (lang, p), n in some.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], n)
    by = collections.defaultdict(list)
    for (lang, p), a in some.items():
        if longer[lang, p] < a:
            score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, own in by.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def phrase_docs():
    rng = random.Random(9)
    words = ["The", "of", "a", "é", "Ünder", "x-y", "naïve", "zz", "😀", "and"]
    out = []
    for i in range(60):
        text = "".join(words[int(len(words) * rng.random() ** 2)] + rng.choice([" ", " ", "  ", "\t", " . ", ",", "\n", " "]) for _ in range(200))
        out.append((rng.choice(["en", "de", None]), text + "one two three four five six. " * rng.randint(0, 3)))
    return [*out, ("fr", ""), (None, None), ("en", " .\t,"), ("fr", "word " * 4000)]


@pytest.mark.parametrize("block", [1 << 19, 7])
def test_phrases_match_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "LEAST", 20)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 3000)
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({"phrase": F.lit("clash"), "n": F.lit(1), "next": F.lit("x")})
    for top in (2000, 5) if block > 7 else (2000,):
        got = sorted(map(tuple, collocations.collocations(df, top, block).collect()))
        assert got == plain_phrases(docs, 20, top) and len(got) > 10


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [("en", "a b", 10**12 + 1), ("en", "a", 10**12 + 7), ("en", "b", 10**12 + 9)]
    phrases, n = spark.createDataFrame(rows, "lang string, phrase string, f long"), spark.createDataFrame([("en", 10**15 + 3)], "lang string, n long")
    r = collocations.ranked(phrases, n, 10).first()
    assert r.score == 1000 * (10**12 + 1) * (10**15 + 3) // ((10**12 + 7) * (10**12 + 9))


def test_tries_hold_their_paths_and_no_others():
    rng = np.random.default_rng(4)
    for n, symbols, depth in ((1, 3, 2), (400, 30, 3), (3000, 200, 2), (500, 5, 5)):
        paths = np.unique(rng.integers(0, symbols, (n, depth)), axis=0)
        rng.shuffle(paths)
        trie = tries.build(paths, symbols)
        other = rng.integers(0, symbols, (2000, depth))
        for rows in (paths, other):
            want = {tuple(p): i for i, p in enumerate(paths.tolist())}
            node, at = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for d in range(depth):
                have, node = trie.step(node, rows[at, d])
                at = at[have]
            found = np.full(len(rows), -1)
            found[at] = trie.entry[node]
            assert found.tolist() == [want.get(tuple(r), -1) for r in rows.tolist()]


def test_a_trie_is_built_in_time_that_follows_its_nodes():
    rng = np.random.default_rng(6)
    symbols, n = 30_000, 70_000
    often = lambda: (symbols ** rng.random(n)).astype(np.int64).clip(0, symbols - 1)
    paths = np.unique(np.stack([rng.integers(0, 4, n), often(), often()], axis=1), axis=0)
    began = time.process_time()
    trie = tries.build(paths, symbols)
    assert time.process_time() - began < 5
    node, at = np.zeros(len(paths), np.int64), np.arange(len(paths))
    for d in range(3):
        have, node = trie.step(node, paths[at, d])
        at = at[have]
    assert (trie.entry[node] == np.arange(len(paths))).all()


def test_a_node_of_many_children_has_no_others():
    for symbols in (40, 3000):
        own = np.arange(0, symbols, 2)
        trie = tries.build(np.stack([np.zeros(len(own), np.int64), own], axis=1), symbols)
        _, node = trie.step(np.zeros(1, np.int64), np.zeros(1, np.int64))
        have, to = trie.step(np.repeat(node, symbols), np.arange(symbols))
        assert have.tolist() == own.tolist() and trie.entry[to].tolist() == list(range(len(own)))
        assert not len(trie.step(np.repeat(to, symbols), np.tile(np.arange(symbols), len(to)))[0])


def test_words_are_found_by_hash_as_by_text():
    words = [f"w{i}é" for i in range(500)]
    rows = pa.table({"id": range(500), "lang": ["en"] * 500, "phrase": words})
    block, asked = collocations.block_of(rows, 1), pa.array(["none", "w7é", "w499é", "w7", "other", "w0é"])
    got = block.symbols_of(asked).tolist()
    assert len(block.hashes) == 500 and [block.words[k].as_py() if k >= 0 else None for k in got] == [None, "w7é", "w499é", None, None, "w0é"]
    block.hashes = block.hashes[:0]
    assert block.symbols_of(asked).tolist() == got


def test_phrases_of_odd_tables(spark, make):
    assert collocations.collocations(make(ODD).limit(0)).count() == 0
    assert collocations.collocations(make([(1, "a b c"), (2, None)])).count() == 0
    top = collocations.collocations(make(ODD)).collect()
    assert [(r.phrase, r.a) for r in top] == [(p, a) for _, _, p, a, *_ in plain_phrases([("en", t) for _, t in ODD], 100, 2000)]


def test_very_long_words_are_found_by_halves(spark):
    rng = random.Random(8)
    words = {"a" * n for n in (63, 64, 65, 66, 67, 20_000, 20_001)}
    for n in (64, 65, 66, 200):
        w = "".join(rng.choice("abc") for _ in range(n))
        words |= {w, w[: n // 2] + "z" + w[n // 2 :], w[1:], w[:-1] + "y", w[:40] + "x" + w[41:], "q" + w}
    words = sorted(words)
    got = {(r.a, r.b) for r in variants.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()}

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]

    assert got == {(a, b) for a in words for b in words if a < b and one_apart(a, b)} and len(got) > 20
