"""Phrase collocations: phrases of words that occur together more often than their parts would by chance.

Phrases are counted by length. A pass over the texts takes a double-array trie of the candidates of one length, which
holds every phrase that can still be frequent, as a phrase is at most as frequent as its parts. In each task numpy moves
all text positions through the trie at once, word by word, and counts the entries reached; shards are summed in Spark.
The same pass proposes candidates of the next length, from overlapping entries at neighbouring positions, by the numbers of
both; those that occur often enough go into the next trie. Many candidates are split by hash into tries of a bounded size, one
pass each; these propose by an entry and the word after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, give_back, table
from .hashing import LOWER, buffer, slices, word_hashes
from .tries import Trie, build

#: Of the contract: occurrences that a candidate needs, its words at most, and phrases reported for each language.
LEAST, WORDS, TOP = 100, 5, 2000
#: Candidates of up to two words in one trie, about, and of longer ones so many fewer: it is sent to every executor.
BLOCK = 1 << 21
#: Languages whose sums are broadcast; more are joined by a shuffle.
FEW_LANGS = 1 << 16
#: Bytes of text handled at a time.
SLICE_BYTES = 1 << 21
SPLIT, GAP = 2, 1
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = GAP
KIND[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = SPLIT


@dataclass
class Words:
    """The words of some texts in order: number of each in ``distinct``, its piece, its text."""

    code: np.ndarray
    distinct: pa.Array
    piece: np.ndarray
    text: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Words of texts without nulls; texts begin pieces of their own."""
    raw, offsets = buffer(texts)
    n = len(texts)
    wide, own = np.full(len(raw) + n + 1, 10, np.uint8), np.ones(len(raw) + n + 1, bool)
    own[offsets + np.arange(n + 1)] = False  # a break before each text and at the end
    wide[own] = LOWER[raw]
    kind = KIND[wide]
    solid = kind == 0
    begin = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    size = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1 - begin
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends.tobytes()), pa.py_buffer(wide[solid].tobytes()))
    coded = words.dictionary_encode()
    piece = np.cumsum(kind == SPLIT, dtype=np.int32)[begin]
    text = np.searchsorted(offsets[1:] + np.arange(1, n + 1), begin, "right")
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, piece, text)


def each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, pa.Array]]:
    """(words, number of each word's language, languages) for slices of (lang, text)."""
    for b in batches:
        texts, langs = b.column("text").fill_null(""), b.column("lang").dictionary_encode()
        for lo, hi in slices(texts, SLICE_BYTES):
            w = words_of(texts.slice(lo, hi - lo))
            yield w, langs.indices.to_numpy(zero_copy_only=False)[lo:hi][w.text].astype(np.int64), langs.dictionary


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, lang, langs in each_slice(batches):
            both, n = np.unique(lang * len(w.distinct) + w.code, return_counts=True)
            if len(both):
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(both // len(w.distinct))), w.distinct.take(pa.array(both % len(w.distinct))), pa.array(n.astype(np.int64))], names=["lang", "word", "f"])

    return _given(docs).mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


@dataclass
class Block:
    """A trie of candidates of ``length`` words, after their language, the id of each entry, and the words in it: by symbol, and their
    hashes in order with the symbol of each. Without hashes (if two are equal) words are looked up as texts."""

    length: int
    trie: Trie
    langs: pa.Array
    words: pa.Array
    ids: np.ndarray
    hashes: np.ndarray
    symbols: np.ndarray

    def symbols_of(self, distinct: pa.Array) -> np.ndarray:
        """The symbol of each word, or -1. A hash table of all own words, made for each slice, costs more than the slice where
        they are many."""
        if not len(self.hashes) or len(self.words) <= 2 * len(distinct):
            return pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        h, _ = word_hashes(distinct)
        order, at = np.argsort(h), np.empty(len(h), np.int64)
        at[order] = np.searchsorted(self.hashes, h[order])  # in order, which is several times as fast
        at = np.minimum(at, len(self.hashes) - 1)
        maybe = np.flatnonzero(self.hashes[at] == h)
        symbol = self.symbols[at[maybe]]
        same = pc.equal(self.words.take(pa.array(symbol)), distinct.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
        out = np.full(len(distinct), -1, np.int32)
        out[maybe[same]] = symbol[same]
        return out

    def entries_at(self, w: Words, lang: np.ndarray, langs: pa.Array) -> np.ndarray:
        """For each position the entry of the phrase that begins there, or -1: all positions take a step at a time."""
        out = np.full(len(w.code), -1, np.int64)
        lang_symbol = pc.index_in(langs, value_set=self.langs).fill_null(-1).to_numpy(zero_copy_only=False)
        symbol = self.symbols_of(w.distinct)[w.code]
        at = np.flatnonzero((symbol >= 0) & (lang_symbol[lang] >= 0))
        node = np.zeros(len(at), np.int64)
        have, node = self.trie.step(node, lang_symbol[lang[at]])
        at = at[have]
        for d in range(self.length):
            if d:  # the next word of the same piece
                on = at + d
                there = on < len(symbol)
                there[there] = (symbol[on[there]] >= 0) & (w.piece[on[there]] == w.piece[at[there]])
                at, node = at[there], node[there]
            have, node = self.trie.step(node, len(self.langs) + symbol[at + d])
            at = at[have]
        out[at] = self.trie.entry[node]
        return out


def block_of(rows: pa.Table, length: int) -> Block:
    """A block of (id, lang, phrase)."""
    lang = rows["lang"].combine_chunks().dictionary_encode()
    flat = pc.split_pattern(rows["phrase"].combine_chunks(), " ").flatten().dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False)
    # frequent words get small numbers, which pack more tightly
    often = np.argsort(-np.bincount(code, minlength=len(flat.dictionary)), kind="stable")
    number = np.empty(len(often), np.int32)
    number[often] = np.arange(len(lang.dictionary), len(lang.dictionary) + len(often))
    paths = np.concatenate([lang.indices.to_numpy(zero_copy_only=False)[:, None], number[code].reshape(-1, length)], axis=1)
    words, symbols = flat.dictionary.take(pa.array(often)), len(lang.dictionary) + len(often)
    del flat, code
    hashes, _ = word_hashes(words)
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    hashes = hashes[order]
    if (hashes[1:] == hashes[:-1]).any():
        hashes = hashes[:0]
    return Block(length, build(paths, symbols), lang.dictionary, words, rows["id"].to_numpy(), hashes, order)


def counts(id: np.ndarray, after: pa.Array, n: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(id), after, pa.array(n.astype(np.int64))], names=names)


def passed(docs: DataFrame, block: Block, propose: bool, alone: bool) -> DataFrame:
    """One pass with one trie: (id, after, n), with no ``after`` the entry's occurrences. With ``alone`` (the block holds all
    candidates) ``after`` is the id of the entry that begins a word later, else the word after the entry."""
    length, names = block.length, ["id", "after", "n"]
    kind = pa.int64() if alone else pa.string()
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        entries = len(own.ids)
        total = np.zeros(entries, np.int64)
        for w, lang, langs in each_slice(batches):
            entry = own.entries_at(w, lang, langs)
            total += np.bincount(entry[entry >= 0], minlength=entries)
            if propose and len(entry) > length:
                on = entry[:-length] >= 0
                on &= w.piece[:-length] == w.piece[length:]
                if alone:
                    on &= entry[1 : len(entry) - length + 1] >= 0
                at = np.flatnonzero(on)
                far = entries if alone else len(w.distinct)
                both, n = np.unique(entry[at] * far + (entry[at + 1] if alone else w.code[at + length]), return_counts=True)
                yield counts(own.ids[both // far], pa.array(own.ids[both % far]) if alone else w.distinct.take(pa.array(both % far)), n, names)
        some = np.flatnonzero(total)
        yield counts(own.ids[some], pa.nulls(len(some), kind), total[some], names)

    found = _given(docs).mapInArrow(walk, f"id long, after {'long' if alone else 'string'}, n long")
    return found.groupBy("id", "after").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def counted(docs: DataFrame, candidates: DataFrame, length: int, block: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of the frequent candidates, (lang, phrase) of those one word longer). ``candidates`` is a stored
    table of distinct (lang, phrase)."""
    blocks = max(1, -(-candidates.count() * max(2, length) // (2 * block)))
    # stored with their ids, so that the driver need not send back what it collects
    names = cut(candidates.select(F.monotonically_increasing_id().alias("id"), "lang", "phrase"), "phrases-names")
    known, longer = None, None
    for k in range(blocks):
        # bounded: about ``block`` rows of a hash
        rows = names.filter(F.pmod(F.xxhash64("lang", "phrase"), F.lit(blocks)) == k).toArrow()
        if not rows.num_rows:
            continue
        one = block_of(rows, length)
        del rows
        found = passed(docs, one, length < WORDS, blocks == 1)
        del one
        give_back(docs.sparkSession)
        found = cut(found, "phrases-pass")
        own = found.filter(F.col("after").isNull()).join(names, "id").select("lang", "phrase", F.col("n").alias("f"))
        more = found.filter(F.col("after").isNotNull()).join(names, "id")
        if blocks == 1:
            last = names.select(F.col("id").alias("after"), F.substring_index("phrase", " ", -1).alias("last"))
            more = more.join(last, "after").withColumnRenamed("after", "_").withColumnRenamed("last", "after")
        more = more.select("lang", F.concat_ws(" ", "phrase", "after").alias("phrase"))
        known, longer = (own, more) if known is None else (known.unionByName(own), longer.unionByName(more))
    if known is None:
        return candidates.withColumn("f", F.lit(0).cast("long")), candidates
    known = cut(known, f"phrases-{length}")
    if blocks > 1:
        longer = longer.withColumn("rest", F.substring("phrase", F.locate(" ", "phrase") + 1, F.length("phrase")))
        # what is one word longer needs its later part to be frequent too
        longer = longer.join(known.select("lang", F.col("phrase").alias("rest")), ["lang", "rest"], "left_semi").select("lang", "phrase")
    return known, cut(longer, f"phrases-next-{length}")


def frequent_phrases(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of up to WORDS words that occur LEAST times, (lang, n) with all words counted)."""
    words = cut(word_counts(docs), "phrases-words")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    candidates = cut(words.filter(F.col("f") >= LEAST).select("lang", F.col("word").alias("phrase")), "phrases-next-0")
    out = None
    for length in range(1, WORDS + 1):
        known, longer = counted(docs, candidates, length, block)
        out = known if out is None else out.unionByName(known)
        candidates = longer
    return out, n


def collocations(docs: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Each language's ``top`` candidates that no longer one covers, by score: (lang, rank, phrase, a, l, r, n, score).

    A null lang is ``und``; null and empty texts have no words; repeated rows count again; a very long text is one like any
    other; ties go to the smaller phrase; an empty table, or one where no phrase occurs often enough, gives an empty
    one; other columns are not read.
    """
    return ranked(*frequent_phrases(docs, block), top)


def ranked(phrases: DataFrame, n: DataFrame, top: int) -> DataFrame:
    """The report from (lang, phrase, f) of all frequent phrases and (lang, n)."""
    split = phrases.withColumn("w", F.split("phrase", " "))
    several = split.filter(F.size("w") > 1)
    part = lambda lo, size: F.array_join(F.slice("w", lo, size), " ")
    # parts of a frequent phrase are frequent, so all are there
    cuts = several.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    of = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    # languages are few: their sums are broadcast, if their size allows it
    n = F.broadcast(n) if n.limit(FEW_LANGS).count() < FEW_LANGS else n
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(n, "lang")
    big = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    wide = cuts.withColumn("up", (big("a", 16) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * big("n", 18)).withColumn("down", big("l", 18) * big("r", 18))
    scored = wide.withColumn("score", F.expr("up div down"))
    lowest = F.min(F.struct("score", "k", "l", "r", "n")).alias("b")
    best = scored.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "b.l", "b.r", "b.n", "b.score")
    # of each phrase within longer ones, the most frequent of these
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    covers = split.filter(F.size("w") > 2).select("lang", "f", F.explode(F.array_distinct(within)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(covers, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first within slices of a language, so that no task sorts a whole one
    sliced = left.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = sliced.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
