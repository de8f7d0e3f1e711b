"""Quality rules: a learned decision list.

Statistics of every text come from Spark expressions alone. Sequential covering learns, from the statistics of labelled
documents, an ordered list of rules: each rule grows a conjunction of thresholds by information gain on two thirds of
them, is pruned on the rest, and takes the documents that it covers out of play. The list is one Spark conditional.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, table, words

WINDOW = 8
#: Quantiles of all and of bad documents that are tried as thresholds of each statistic.
QUANTILES = 24
#: What a rule must reach on the documents that prune it: a precision (smoothed by Laplace's rule), and a share of bad
#: documents that chance gives with no more than this probability.
LEAST_PRECISION, CHANCE = 0.8, 0.01


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the text's statistics. Null or empty text: no words. A null doc_id stays null; repeated rows stay; a very long
    text is one text like any other; other columns are dropped; an empty table gives an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp(x, F.lit(r"[^\x20\x09-\x0D]")))
    one = split.select("*", F.size("words").alias("n"), lines.alias("lines"))
    wins = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW))))
    two = one.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"[0-9]")).alias("n_digits"),
        F.regexp_count("text", F.lit(r"[!?]")).alias("n_loud"),
        wins.alias("wins"),
    )
    # a text whose windows all differ has no repeated word; the others sort (hash, place) and look at neighbours
    three = two.withColumn("ranked", F.when(F.size(F.array_distinct("wins")) < F.size("wins"), F.array_sort(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    ranked, n = F.col("ranked"), F.size("ranked")
    twice = F.filter(ranked, lambda x, j: ((j > 0) & (F.get(ranked, j - 1)["h"] == x["h"])) | ((j + 1 < n) & (F.get(ranked, j + 1)["h"] == x["h"])))
    four = three.withColumn("starts", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("wins", "ranked")
    starts = F.col("starts")
    runs = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
    return four.withColumn("n_repeat_words", F.coalesce(F.aggregate(runs, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("starts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """What rules compare with thresholds; 0 where there is nothing to divide by."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": part("word_chars", "n_words"),
        "symbols_per_word": part("n_symbols", "n_words"),
        "dup_line_share": part("n_dup_lines", "n_lines"),
        "repeat_share": part("n_repeat_words", "n_words"),
        "distinct_share": part("n_distinct", "n_words"),
        "upper_share": part("n_upper", "word_chars"),
        "digit_share": part("n_digits", "word_chars"),
        "loud_per_word": part("n_loud", "n_words"),
        "words_per_line": part("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self, features: dict[str, Column]) -> Column:
        return features[self.feature] > self.threshold if self.above else features[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


@dataclass
class DecisionList:
    """Each rule's documents are of low quality; what no rule covers is kept."""

    rules: list[list[Literal]]

    def keeps(self, features: dict[str, Column]) -> Column:
        chain = None
        for rule in self.rules:
            cond = all_of(rule, features)
            chain = F.when(cond, F.lit(False)) if chain is None else chain.when(cond, F.lit(False))
        return F.lit(True) if chain is None else chain.otherwise(F.lit(True))

    def describe(self) -> list[str]:
        return [" and ".join(map(str, r)) + ": reject" for r in self.rules] + ["otherwise: keep"]


def all_of(rule: list[Literal], features: dict[str, Column]) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.column(features)
    return out


def gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's information gain of narrowing (p0 bad, n0 good) to (p, n)."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else 0.0


def chance(bad: int, good: int, share: float) -> float:
    """Probability that among so many documents at least ``bad`` are bad, where ``share`` of all are: the binomial tail."""
    n, p = bad + good, min(max(share, 1e-12), 1 - 1e-12)
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)
    return min(1.0, sum(math.exp(log(k)) for k in range(bad, n + 1)) if n - bad < 10_000 else math.exp(log(bad)) * n)


def holds(bad: int, good: int, share: float) -> bool:
    """Whether a rule that covers so many is to be believed."""
    return bad > 0 and (bad + 1) / (bad + good + 2) >= LEAST_PRECISION and chance(bad, good, share) <= CHANCE


def learn(labelled: DataFrame) -> DecisionList:
    """``labelled``: statistics with ``doc_id`` and ``quality`` 0 or 1. All its rows count, null qualities aside; no label of
    quality 0, no rule. Covering ends when the best rule left covers too few documents to differ from chance; a rule that
    fails on the documents that prune it is left out, and covering goes on with those that it didn't cover."""
    names = list(ratios())
    rows = labelled.filter(F.col("quality").isNotNull())
    flat = cut(rows.select(*[c.alias(k) for k, c in ratios().items()], (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow")), "quality")
    features = {k: F.col(k) for k in names}
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    cuts = flat.select(*[F.percentile_approx(k, at[1:-1], 10_000).alias(k) for k in names]).first()
    edges = flat.filter("bad").select(*[F.percentile_approx(k, at, 10_000).alias(k) for k in names]).first()
    thresholds = {k: sorted({*(cuts[k] or []), *(edges[k] or [])}) for k in names}
    # bin b of a feature: above its first b thresholds, so bins up to b mean "<= threshold b"

    def bin_of(k: str) -> Column:
        at = F.array(*[F.lit(float(t)) for t in thresholds[k]]) if thresholds[k] else F.array().cast("array<double>")
        return F.size(F.filter(at, lambda t: t < F.col(k)))

    bins = F.array(*map(bin_of, names))
    binned = cut(flat.withColumn("bins", bins), "quality-bins")
    overall = binned.groupBy("grow").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).collect()
    share = {r.grow: r.bad / r.n for r in overall}

    def counts(df: DataFrame) -> dict[tuple[str, int], list[int]]:
        """(bad, good) of each feature and bin."""
        out: dict[tuple[str, int], list[int]] = {}
        for r in df.select("bad", F.posexplode("bins")).groupBy("pos", "col", "bad").count().collect():
            out.setdefault((names[r.pos], r["col"]), [0, 0])[0 if r.bad else 1] += r["count"]
        return out

    def grown(df: DataFrame) -> tuple[list[Literal], int, int]:
        """A rule, and how many bad and good documents it covers."""
        rule: list[Literal] = []
        while True:
            by = counts(df.filter(all_of(rule, features)))
            p0, n0 = (sum(v[i] for (k, _), v in by.items() if k == names[0]) for i in (0, 1))
            best, choice = 0.0, None
            for k in names if p0 and n0 else []:
                p = n = 0
                for b, t in enumerate(thresholds[k]):
                    p, n = p + by.get((k, b), [0, 0])[0], n + by.get((k, b), [0, 0])[1]
                    for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if (g := gain(x, y, p0, n0)) > best + 1e-9:
                            best, choice = g, Literal(k, above, float(t))
            if choice is None:
                return rule, p0, n0
            rule.append(choice)

    rules: list[list[Literal]] = []
    open_rows, held = binned.filter("grow"), binned.filter("not grow")
    while True:
        rule, p, n = grown(open_rows)
        if not rule or chance(p, n, share[True]) > CHANCE:
            break
        tried = held.agg(*[F.sum((all_of(rule[: i + 1], features) & (F.col("bad") == b)).cast("long")).alias(f"{'p' if b else 'n'}{i}") for i in range(len(rule)) for b in (True, False)]).first()
        found = [(tried[f"p{i}"] or 0, tried[f"n{i}"] or 0) for i in range(len(rule))]
        keep = max(range(len(rule)), key=lambda i: (round((found[i][0] - found[i][1]) / max(1, sum(found[i])), 3), -i))  # noqa: B023
        pruned = rule[: keep + 1]
        if holds(*found[keep], share.get(False, 0.0)):
            rules.append(pruned)
            held = held.filter(~all_of(pruned, features))
        open_rows = open_rows.filter(~all_of(pruned, features))
    remove(flat, binned)
    return DecisionList(rules)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    stats = cut(statistics(table(spark, sf_dir, "documents")), "quality-stats")
    labels = table(spark, sf_dir, "labels").filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # rules are for what the base lets through
    rules = learn(stats.filter(~base_failed()).join(labels, "doc_id"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & rules.keeps(ratios())).alias("kept"))
