"""Language identification as a mixture: each document's words come from a few languages in unknown shares.

A word's likelihood under a language is that of its byte trigrams, counted over all training texts. For each document
expectation-maximisation estimates the languages' shares; the set of languages is the one of the nested sets (by share)
with the highest likelihood less a penalty for each further language. Sets grow up to all learned languages; a document
leaves early only when a bound on every set's likelihood, less the next penalty, is below its best value so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, table

BUCKETS = 1 << 15
ROUNDS = 6
#: Bytes handled at a time in a task, which bounds its memory; a single longer text is handled alone.
SLICE_BYTES = 1 << 18
#: A further language must gain this many times half the log of the number of words.
PENALTY = 6.0
#: Trigrams overlap; their log likelihoods are scaled so that a letter counts about once.
TEMPER = 1 / 3


def letter_bytes() -> np.ndarray:
    """ASCII letters in lower case, other ASCII as blank (0), other bytes as they are."""
    lut = np.zeros(256, np.uint8)
    lut[ord("a") : ord("z") + 1] = lut[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    lut[128:] = np.arange(128, 256)
    return lut


LETTERS = letter_bytes()


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, index of its text, whether it begins a word) of all texts (no nulls); a trigram begins
    at a blank or a letter byte and never crosses texts, and blanks alone are none."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    n = len(texts)
    # two blanks around each text keep trigrams apart
    at = offsets[:-1] - offsets[0] + 2 * np.arange(1, n + 1)
    size = np.diff(offsets)
    wide = np.zeros(len(raw) + 2 * (n + 1), np.uint8)
    where = np.arange(len(raw)) + 2 * np.repeat(np.arange(1, n + 1), size)
    wide[where] = LETTERS[raw]
    x = wide.astype(np.uint32)
    code = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    solid = wide != 0
    used = solid[1:-1]  # the middle byte is a letter
    begins = used & ~solid[:-2]
    owner = np.repeat(np.arange(n), size + 2)
    # position p of ``code`` has its middle byte at p + 1; text i fills wide[at[i] : at[i] + size[i]]
    spot = np.flatnonzero(used)
    del at
    return code[spot], owner[np.minimum(spot + 1 - 2, len(owner) - 1)] if n else spot, begins[spot]


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # BUCKETS x languages


def fit(labelled: DataFrame) -> Model:
    """Trigram counts of every text with a language, over all such rows. The model has 128 KB for each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                langs = batch.column("lang").slice(lo, hi - lo).dictionary_encode()
                code, owner, _ = trigrams(batch.column("text").slice(lo, hi - lo))
                of = langs.indices.to_numpy(zero_copy_only=False)[owner] if len(code) else code
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    n = np.bincount(code[of == k], minlength=BUCKETS)
                    total[lang] = total.get(lang, 0) + n
        for lang, n in total.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(n[b].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(langs)))
    if langs:
        of = {x: i for i, x in enumerate(langs)}
        table[counts.column("bucket").to_numpy(), [of[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
        table = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS))
    return Model(langs, table.astype(np.float32))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_BYTES, "right")) - 1))
        yield lo, hi
        lo = hi


def mixtures(log_w: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each of ``n`` documents (documents x languages), of the full set and of the chosen
    set. log_w: words x languages; doc: the document of each word, ascending."""
    langs = log_w.shape[1]
    words = np.bincount(doc, minlength=n).astype(np.float64)
    top = log_w.max(axis=1, keepdims=True)
    e = np.exp(log_w - top)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    present = doc[first]

    def per_doc(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, x.shape[1]))
        out[present] = np.add.reduceat(x, first, axis=0) if len(first) else 0
        return out

    def em(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            r = share.astype(np.float32)[doc] * e
            r /= r.sum(axis=1, keepdims=True) + 1e-30
            share = per_doc(r) / np.maximum(words, 1)[:, None]
        return share, np.log((share.astype(np.float32)[doc] * e).sum(axis=1, keepdims=True) + 1e-30)

    full, full_ll = em(np.ones((n, langs)))
    single = per_doc(np.log(e + 1e-30))
    order = np.argsort(-single, axis=1, kind="stable")
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best = np.zeros((n, langs))
    best[np.arange(n), order[:, 0]] = 1
    value = single[np.arange(n), order[:, 0]]
    penalty = PENALTY * 0.5 * np.log(np.maximum(words, 2))
    # the likelihood is concave in the shares, so its tangent at the full set's shares bounds that of every set; what
    # rounding may add is far below the slack
    slope = per_doc(e / ((full.astype(np.float32)[doc] * e).sum(axis=1, keepdims=True) + 1e-30)).max(axis=1)
    bound = np.minimum(0, per_doc(full_ll)[:, 0] + slope - words) + 1e-3 * (1 + words)
    rows = np.arange(n)  # the documents that a further language can still improve
    for k in range(2, langs + 1):
        left = bound[rows] - (k - 1) * penalty[rows] > value[rows]
        if not left.all():
            keep = left[np.searchsorted(rows, doc)]
            e, doc, rows = e[keep], doc[keep], rows[left]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            present = doc[first]
        if not len(rows):
            break
        share, ll = em((rank < k).astype(float))
        gain = per_doc(ll)[:, 0] - (k - 1) * penalty
        better = np.zeros(n, bool)
        better[rows] = gain[rows] > value[rows]
        best[better], value = share[better], np.where(better, gain, value)
    return full, best


MIXTURE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())), ("margin", pa.float64())])
KINDS = "struct<lang_pred string, score double, langs array<string>, shares array<double>, margin double>"


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (share of that language among all learned), langs and shares of the chosen set, and
    margin: by how much a trigram's mean log likelihood under that mixture is above that of no language at all, where every
    trigram is as likely as any other. All columns of ``docs`` stay, but for columns of these names, which are replaced.

    ``und`` with score and margin 0 and empty arrays: a null text, one without a letter, or no language learned. Repeated
    rows stay, ties go to the language first by name, a very long text is handled alone, an empty table gives an empty one.
    """
    langs, log_p = model.langs, model.log_p

    def rated(texts: pa.Array) -> pa.Array:
        n, names = len(texts), np.array(langs, object)
        code, owner, begins = trigrams(texts)
        margin = np.zeros(n)
        if not len(code) or not langs:
            best = full = np.full((n, max(1, len(langs))), 1 / max(1, len(langs)))
        else:
            word = np.flatnonzero(begins)
            log_w = np.add.reduceat(log_p[code], word, axis=0) * np.float32(TEMPER)
            doc = owner[word]
            full, best = mixtures(log_w, doc, n)
            top = log_w.max(axis=1)
            likely = np.log((best.astype(np.float32)[doc] * np.exp(log_w - top[:, None])).sum(axis=1) + 1e-30) + top
            size = np.maximum(1, np.bincount(owner, minlength=n))
            margin = np.bincount(doc, likely, n) / TEMPER / size + np.log(BUCKETS)
        top = best.argmax(axis=1)
        known = np.bincount(owner, minlength=n) > 0 if langs else np.zeros(n, bool)
        pred = np.where(known, names[top], "und") if langs else np.full(n, "und", object)
        score = np.where(known, np.clip(full[np.arange(n), top], 0, 1), 0.0)
        kept = [[(names[k], float(row[k])) for k in np.argsort(-row, kind="stable") if row[k] > 0] if ok else [] for row, ok in zip(best, known, strict=True)]
        columns = [pred, score, [[a for a, _ in x] for x in kept], [[b for _, b in x] for x in kept], np.where(known, margin, 0.0)]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MIXTURE, strict=True)], fields=list(MIXTURE))

    def mixture(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.fill_null("")
            parts = [rated(texts.slice(lo, hi - lo)) for lo, hi in slices(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], MIXTURE)

    # a text without a letter goes as the empty one, so it has no trigram
    lettered = F.when(F.regexp("text", F.lit(r"\p{L}")), F.col("text"))
    # marked so, it isn't moved into filters and run again
    found = docs.withColumn("_mixture", F.arrow_udf(mixture, KINDS).asNondeterministic()(lettered))
    return found.withColumns({f.name: F.col("_mixture")[f.name] for f in MIXTURE}).drop("_mixture")


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with what ``with_language`` finds; a null doc_id stays null."""
    return with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def fit_and_detect(train: DataFrame, docs: DataFrame) -> DataFrame:
    return detect(docs, fit(train))


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: all but the held-out quarter."""
    return docs.filter(fold("doc_id", 4) != 2)


def op5_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = fit_and_detect(training_rows(docs), docs)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "langs", "shares")
