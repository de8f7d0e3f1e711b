"""Toxicity by weak supervision.

Many voters look at a text: one for each lexicon word and one for each writing pattern. A generative label model
estimates, from how they agree on labelled and unlabelled texts alike, each voter's rates under either class, the rates
of the given labels, and the voters' correlations within a class; it turns the votes of a bounded sample into posterior
labels. Given labels are one more voter, silent on unlabelled texts, and anchor which class is which. A linear classifier
learns from those posteriors and scores every text as one Spark expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drawn, fold, remove, table

#: Labelled rows that lexicon and models are fitted on, at most, and as many unlabelled ones; chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000
#: Words learned for the lexicon, at most; each is in so many of the sample's toxic documents, and in such a share of them.
LEARNED_WORDS, LEAST_DOCS, LEAST_SHARE = 400, 8, 0.01

#: How often a given label is 1 under either class, to begin with, and how many documents this counts for.
GIVEN, GIVEN_ROWS = (0.8, 0.01), 50
#: Correlations below this many standard errors count as none; what is added to the diagonal before they are inverted.
NOISE, RIDGE = 4.0, 0.02
#: Unlabelled documents teach the classifier where their posterior is this near to 0 or 1.
DOUBT = 0.02

# A general lexicon of insults, by language.
LEXICON = {
    "en": "idiot idiots stupid moron morons loser losers worthless pathetic disgusting scum trash clown dumb fool imbecile jerk creep filth filthy garbage vermin hate ugly shut liar coward bastard bitch crap damn hell",
    "de": "idiot dumm trottel versager wertlos widerlich abschaum dreck arschloch hässlich feigling lügner hass",
    "fr": "idiot imbécile crétin minable dégoûtant ordure salaud connard débile lâche menteur haine nul",
    "es": "idiota estúpido imbécil basura asqueroso patético escoria payaso cobarde mentiroso odio tonto",
}
PATTERNS = {
    "shouting": r"\p{Lu}{4,}[^\p{L}]+\p{Lu}{4,}[^\p{L}]+\p{Lu}{4,}",
    "exclaiming": r"!{2,}",
    "masked_word": r"\p{L}[*#@$]{2,}\p{L}?",
    "you_are": r"(?i)\b(?:you are|you're|du bist|tu es|eres)\b",
    "go_away": r"(?i)\b(?:shut up|get lost|go away|hau ab|va-t'en|lárgate)\b",
    "stretched": r"(\p{L})\1{3,}",
}


#: Rows of votes that are numbers of full width at a time; votes are kept as bytes.
CHUNK = 2048


def chunks(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The rows in turn, as doubles."""
    for lo in range(0, len(x), CHUNK):
        yield slice(lo, lo + CHUNK), x[lo : lo + CHUNK].astype(np.float64)


def lexicon() -> list[str]:
    return sorted({w for words in LEXICON.values() for w in words.split()})


def distinct_words(text: Column) -> Column:
    """Distinct lower-case runs of letters."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+"))


def votes(text: Column, words: list[str]) -> list[Column]:
    """What the voters see: the lexicon words that a text holds, and one boolean for each pattern."""
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    safe = F.coalesce(text, F.lit(""))
    return [F.array_intersect(distinct_words(text), known).alias("hits"), *[F.regexp(safe, F.lit(p)).alias(name) for name, p in PATTERNS.items()]]


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE_ROWS labelled rows and SAMPLE_ROWS others, with doc_id, text and toxic (null: no label). Where a
    document has several labels the highest counts."""
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    labelled = drawn(ids, SAMPLE_ROWS, "doc_id")  # pairs of numbers: under half a megabyte
    labelled = texts.join(F.broadcast(labelled), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # of the rest, each document that has no label at all
    others = drawn(texts.join(ids, "doc_id", "left_anti").select("doc_id").distinct(), SAMPLE_ROWS, "doc_id")
    others = texts.join(F.broadcast(others), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    return cut(labelled.select("doc_id", "text", "toxic").unionByName(others.select("doc_id", "text", F.lit(None).cast("int").alias("toxic"))), "toxicity-sample")


def learned_words(sample: DataFrame) -> list[str]:
    """Words that mark toxic sample documents: by how surely, over how many."""
    sample = sample.filter(F.col("toxic").isNotNull())
    total = sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n = {r.toxic: r.n for r in total}
    if not n.get(1) or not n.get(0):
        return []
    seen = sample.select("toxic", F.explode(distinct_words(F.col("text"))).alias("word")).filter("word <> ''")
    counts = seen.groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("hot"), F.count("*").alias("all")).filter(F.col("hot") >= max(LEAST_DOCS, LEAST_SHARE * n[1]))
    hot, cold = (F.col("hot") + 0.5) / (n[1] + 1), (F.col("all") - F.col("hot") + 0.5) / (n[0] + 1)
    weight = hot * F.log(hot / cold)
    best = counts.filter(hot > 8 * cold).orderBy(F.desc(weight), "word").limit(LEARNED_WORDS).collect()
    return [r.word for r in best]


@dataclass
class LabelModel:
    """A voter that doesn't vote abstains, which is no evidence; the last voter speaks where all others abstain."""

    prior: float
    on: np.ndarray  # P(voter votes | toxic)
    off: np.ndarray  # P(voter votes | not toxic)
    share: np.ndarray  # weight of each voter beside those that it is correlated with
    given: tuple[float, float]  # P(given label is 1 | toxic), P(given label is 1 | not toxic)

    def posterior(self, x: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Of votes (rows x voters) and given labels (1, 0, or nan where none is given)."""
        on, off = self.given
        label = np.where(np.isnan(given), 0.0, np.where(given == 1, np.log(on / off), np.log((1 - on) / (1 - off))))
        voice = self.share * np.log(self.on / self.off)
        z = np.log(self.prior / (1 - self.prior)) + np.concatenate([part @ voice for _, part in chunks(x)]) + label
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def shares(gram: np.ndarray, n: int) -> np.ndarray:
    """Each voter's weight from the correlations R of what is left of votes within the classes: R^-1 1, between 0 and 1. A
    voter without a correlation weighs 1, each of k that always agree 1 / k. ``gram`` has the products of what is left, summed over n rows."""
    scale = np.sqrt(np.diag(gram) / n)
    alive = scale > 1e-3  # a voter that is always or never right has no rest to compare
    r = gram / n / np.outer(np.maximum(scale, 1e-9), np.maximum(scale, 1e-9))
    r[r < NOISE / np.sqrt(n)] = 0  # voters that exclude each other add no weight
    r[~alive, :], r[:, ~alive] = 0, 0
    np.fill_diagonal(r, 1)
    k = r.shape[0]
    return np.clip(np.linalg.solve(r + RIDGE * np.eye(k), np.full(k, 1 + RIDGE)), 0, 1)


def label_model(x: np.ndarray, given: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation over votes (rows x voters, the last of which speaks where the text's voters are silent) and
    given labels. It starts where voters' rates are those among given labels; prior, rates, the labels' own rates and the
    correlations are all estimated again in each round."""
    labelled = ~np.isnan(given)
    known = given[labelled]
    share = np.ones(x.shape[1])
    prior = float(np.clip(known.mean() if len(known) else 0.01, 1e-3, 0.5))
    q = np.where(labelled, np.where(given == 1, 0.95, 0.02), prior)
    weight = labelled.astype(float)  # the first estimates are from labelled rows alone
    model = None
    for k in range(rounds):
        hot, cold = q * weight, (1 - q) * weight
        seen = sum((np.stack([hot[at], cold[at]]) @ part for at, part in chunks(x)), np.zeros((2, x.shape[1])))
        on = np.clip((seen[0] + 0.5) / (hot.sum() + 1), 1e-5, 1 - 1e-5)
        off = np.clip((seen[1] + 0.1) / (cold.sum() + 1), 1e-5, 1 - 1e-5)
        rate = [float((w[labelled] @ known + GIVEN_ROWS * g) / (w[labelled].sum() + GIVEN_ROWS)) for w, g in ((q, GIVEN[0]), (1 - q, GIVEN[1]))]
        prior = float(np.clip(hot.sum() / max(weight.sum(), 1e-9), 1e-3, 0.999))
        if k:
            gram = np.zeros((x.shape[1] - 1,) * 2)
            for at, part in chunks(x):
                rest = (part - np.outer(q[at], on) - np.outer(1 - q[at], off))[:, :-1]
                gram += rest.T @ rest
            share = np.append(shares(gram, len(x)), 1.0)
        model = LabelModel(prior, on, off, share, tuple(np.clip(rate, 1e-4, 1 - 1e-4)))
        new = model.posterior(x, given)
        weight = np.ones(len(x))
        if k and np.abs(new - q).max() < 1e-3:
            break
        q = new
    return model


def logistic(x: np.ndarray, q: np.ndarray, decay: float = 1e-5, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton steps; rare toxicity isn't reweighted."""
    w = np.zeros(x.shape[1] + 1)
    penalty = np.full(len(w), decay * len(x))
    penalty[-1] = 1e-6
    for _ in range(steps):
        bend, slope = np.diag(penalty), penalty * w
        for at, part in chunks(x):
            z = np.hstack([part, np.ones((len(part), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            bend = bend + (z * (p * (1 - p) + 1e-6)[:, None]).T @ z
            slope = slope + z.T @ (p - q[at])
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Classifier:
    words: list[str]
    weights: np.ndarray  # of the words, then of the patterns
    bias: float

    def score(self) -> Column:
        """Of the columns that ``votes`` makes."""
        z = F.lit(self.bias)
        if self.words:
            table = F.create_map(*[F.lit(v) for w, k in zip(self.words, self.weights, strict=False) for v in (w, float(k))])
            z = z + F.aggregate("hits", F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
        for name, k in zip(PATTERNS, self.weights[len(self.words) :], strict=True):
            z = z + F.col(name).cast("double") * float(k)
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From a bounded sample of labelled and unlabelled documents; without any toxic label every score is near 0. ``labels`` has
    the labels to learn from; documents that have none of them are unlabelled here."""
    sample = sampled(docs, labels)
    words = sorted({*lexicon(), *learned_words(sample)})
    at = {w: i for i, w in enumerate([*words, *PATTERNS])}
    seen, toxic = [], []
    for r in sample.select("doc_id", "toxic", *votes(F.col("text"), words)).orderBy("doc_id").toLocalIterator():
        seen.append(np.array([at[w] for w in r.hits] + [at[name] for name in PATTERNS if r[name]], np.int32))
        toxic.append(r.toxic)
    remove(sample)
    x = np.zeros((len(seen), len(at)), np.uint8)
    for row, own in zip(x, seen, strict=True):
        row[own] = 1
    if not any(toxic):
        return Classifier(words, np.zeros(x.shape[1]), -5.0)
    given = np.array([np.nan if t is None else float(t == 1) for t in toxic])
    voters = np.hstack([x, ~x.any(axis=1, keepdims=True)])
    q = label_model(voters, given).posterior(voters, given)
    sure = ~np.isnan(given) | (np.minimum(q, 1 - q) < DOUBT)
    weights, bias = logistic(x[sure], q[sure])
    return Classifier(words, weights, bias)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score and hits of every document. A null or empty text scores what a text without any vote scores; a null
    doc_id stays null; repeated rows stay; a very long text is one text like any other; other columns are dropped; an empty
    table gives an empty one."""
    seen = docs.select("doc_id", *votes(F.col("text"), model.words))
    return seen.select("doc_id", model.score().alias("score"), "hits")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(fold("doc_id", 5) != 0))
    held = (fold("doc_id", 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")
