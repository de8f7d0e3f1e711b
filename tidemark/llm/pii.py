"""Personal data: exact kinds by pattern and check, and further spans by boosted trees over candidates.

Patterns run on the JVM. Their places come from the lengths of the gaps and matches, as code points. High-recall
generators propose further spans, which may overlap; a small ensemble of boosted trees rates each by its format and its
surroundings, and a threshold calibrated on held-out candidates of its kind decides. Trees are Spark conditionals.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remove, table

KINDS = ["email", "ip", "card", "phone"]
#: The same matches as the contract's patterns, written so that no search is quadratic or recurses without bound: runs
#: are possessive and start where they can't be extended to the left (or where the last match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]{12,}[0-9]",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Separators next to separators end a card number; they are masked first, one for one.
DOUBLED = r"[ -](?=[ -])|(?<=[ -])[ -]"
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "handle": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++ ?[\[(]at[\])] ?[a-z0-9-]++ ?(?:[\[(]dot[\])]|\.) ?[a-z]{2,}+",
}
#: Cheap signs that a pattern may match at all.
SIGNS = {"email": "@", "ip": None, "card": None, "phone": "+", "secret": None, "account": None, "handle": None}
BLOCK, CONTEXT = 512, 24
#: Trees, their rate, folds that calibrate, and the precision that a kind must reach, smoothed by one candidate of the
#: kind's own share.
TREES, RATE, FOLDS, PRECISION = 30, 0.3, 3, 0.95
#: Thresholds of a feature at most. Leaves are whole numbers of 1/GRID up to LEAF, so that a kind has at most some 250,000
#: scores; gradients are summed as whole numbers of 1/UNIT, in any order alike. So many trees are added before scores are stored.
CUTS, GRID, LEAF, UNIT, STORED = 32, 1024, 4.0, 1 << 24, 6
FORMAT = ["length", "digits", "letters", "upper", "separators", "turns", "distinct"]
CONTEXT_FEATURES = ["keyword", "assigned", "quoted", "word_left", "word_right", "plus"]
FEATURES = [*FORMAT, *CONTEXT_FEATURES]
#: What tells a kind's weak label is no feature of its trees: secrets and handles are labelled by the words before them,
#: account numbers by their check digits, which no feature shows.
HIDDEN = {"secret": ["keyword"], "handle": ["keyword"], "account": []}


def with_matches(df: DataFrame, patterns: dict[str, tuple[str, str]], around: bool = False) -> DataFrame:
    """Adds for each name an array of (start, end, match), of the pattern in the named text column; empty if none. With ``around``
    also of left and right, up to CONTEXT and 2 characters beside the match, from the gaps and matches next to it."""
    found = {}
    for name, (source, pattern) in patterns.items():
        sign = F.contains(F.col(source), F.lit(SIGNS[name])) if SIGNS.get(name) else F.lit(True)
        here = sign & F.regexp(F.col(source), F.lit(pattern))
        found[f"{name}_m"] = F.when(here, F.regexp_extract_all(source, F.lit(pattern), F.lit(0)))
        found[f"{name}_g"] = F.when(here, F.split(F.col(source), pattern, -1))
    df = df.withColumns(found)
    df = df.withColumns({f"{k}_l": _lengths(k) for k in patterns})
    df = df.withColumns({f"{k}_b": _block_sums(k) for k in patterns})
    return df.withColumns({k: _places(k, around) for k in patterns}).drop(*[f"{k}_{x}" for k in patterns for x in "mglb"])


def _lengths(k: str) -> Column:
    """Of each gap with the match that follows it."""
    gaps = F.col(f"{k}_g")
    return F.transform(f"{k}_m", lambda m, j: F.length(m) + F.length(F.get(gaps, j)))


def _block_sums(k: str) -> Column:
    """Sums of BLOCK lengths each: prefix sums stay cheap in a text with very many matches."""
    lens = F.col(f"{k}_l")
    n = F.ceil(F.size(lens) / BLOCK).cast("int")
    return F.when(F.size(lens) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: _sum(F.slice(lens, b * BLOCK + 1, BLOCK))))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def _places(k: str, around: bool) -> Column:
    lens, blocks, gaps, matches = F.col(f"{k}_l"), F.col(f"{k}_b"), F.col(f"{k}_g"), F.col(f"{k}_m")
    head = lambda x, n: F.substring(F.coalesce(x, F.lit("")), F.lit(1), F.lit(n))
    tail = lambda x, n: F.right(F.coalesce(x, F.lit("")), F.lit(n))

    def beside(j: Column) -> list[Column]:
        left = tail(F.concat(tail(F.get(gaps, j - 1), CONTEXT), tail(F.get(matches, j - 1), CONTEXT), tail(F.get(gaps, j), CONTEXT)), CONTEXT)
        right = head(F.concat(head(F.get(gaps, j + 1), 2), head(F.get(matches, j + 1), 2)), 2)
        return [left.alias("left"), right.alias("right")]

    def place(m: Column, j: Column) -> Column:
        whole = F.floor(j / BLOCK).cast("int")
        start = _sum(F.slice(blocks, 1, whole)) + _sum(F.slice(lens, whole * BLOCK + 1, j % BLOCK)) + F.length(F.get(gaps, j))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), *(beside(j) if around else []))

    empty = F.array().cast(f"array<struct<start:int,end:int,match:string{',left:string,right:string' if around else ''}>>")
    return F.coalesce(F.transform(f"{k}_m", place), empty)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes."""
    def add(a: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return a + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def iban(number: Column) -> Column:
    """Whether the check digits of an international account number are right: letters count from 10, the first four characters last."""
    chars = F.split(F.regexp_replace(number, " ", ""), "")
    turned = F.concat(F.slice(chars, F.lit(5), F.greatest(F.size(chars) - 4, F.lit(0))), F.slice(chars, 1, 4))

    def add(a: Column, c: Column) -> Column:
        v = F.when(F.regexp(c, F.lit("[0-9]")), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return (F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97

    return F.aggregate(turned, F.lit(0), add) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return F.regexp(match, F.lit(rf"\A{part}(?:\.{part}){{3}}\z"))
    if kind == "card":
        d = digits(match)
        return F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def _span(x: Column, kind: str) -> Column:
    order = [*KINDS, *GENERATORS].index(kind)
    return F.struct(x["start"].alias("start"), F.lit(order).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def framed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one, ``_own``, so that no name of theirs clashes, and the text as ``_t``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))


def unframed(df: DataFrame, names: list[str], **made: Column) -> DataFrame:
    """The columns ``names`` of ``_own``, but those in ``made`` replaced or added."""
    kept = [made.pop(c).alias(c) if c in made else F.col("_own")[c].alias(c) for c in names]
    return df.select(*kept, *[v.alias(k) for k, v in made.items()])


def based(df: DataFrame) -> DataFrame:
    """Adds ``base`` to a framed table."""
    masked = F.when(F.regexp("_t", F.lit(PATTERNS["card"])), F.regexp_replace("_t", DOUBLED, "\u0001")).otherwise(F.lit(""))
    df = with_matches(df.withColumn("_c", masked), {k: ("_c" if k == "card" else "_t", PATTERNS[k]) for k in KINDS})
    spans = [F.transform(_checked(k), _as_span(k)) for k in KINDS]
    return df.withColumn("base", F.array_sort(F.concat(*spans))).drop(*KINDS, "_c")


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: the exact kinds' spans as an array of (start, rank, end, kind) in order."""
    return unframed(based(framed(docs)), docs.columns, base=F.col("base"))


def _checked(k: str) -> Column:
    return F.filter(k, lambda x: valid(k, x["match"]))


def _as_span(k: str):
    return lambda x: _span(x, k)


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds ``candidates``: what the generators propose, with features and a weak label (``seed``). Needs ``base``."""
    df = with_matches(df, {k: ("_t", p) for k, p in GENERATORS.items()}, around=True)

    def described(k: str):
        def describe(x: Column) -> Column:
            m, left, right = x["match"], x["left"], x["right"]
            flag = lambda on, p: F.regexp(on, F.lit(p)).cast("int")
            keyword = flag(left, r"(?i)(?:token|key|secret|passw|pwd|auth|credential|iban|ssn|account|card|phone|mail|contact)")
            assigned, quoted = flag(left, r"[=:]\s?[\"']?\z"), flag(left, r"[\"']\z") * flag(right, r"\A[\"']")
            within = F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            return F.struct(
                *[_span(x, k)[c].alias(c) for c in ("start", "rank", "end", "kind")],
                F.length(m).alias("length"),
                F.regexp_count(m, F.lit("[0-9]")).alias("digits"),
                F.regexp_count(m, F.lit("[A-Za-z]")).alias("letters"),
                F.regexp_count(m, F.lit("[^0-9A-Za-z]")).alias("separators"),
                keyword.alias("keyword"),
                assigned.alias("assigned"),
                quoted.alias("quoted"),
                flag(left, r"[\p{L}\p{N}_]\z").alias("word_left"),
                flag(right, r"\A[\p{L}\p{N}_]").alias("word_right"),
                flag(left, r"\+\s?\z").alias("plus"),
                F.regexp_count(m, F.lit("[A-Z]")).alias("upper"),
                F.regexp_count(m, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")).alias("turns"),
                F.size(F.array_distinct(F.split(m, ""))).alias("distinct"),
                (iban(m) if k == "account" else keyword == 1).alias("seed"),
                within.alias("within"),
            )

        return describe

    return df.withColumn("candidates", F.concat(*[F.transform(k, described(k)) for k in GENERATORS])).drop(*GENERATORS)


@dataclass
class Boosted:
    """Trees of two levels over whole-number features: (feature, cut, left split, right split), leaves in order; and the
    least score that is taken."""

    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    threshold: float = np.inf

    def score(self, get) -> Column:
        z = F.lit(self.bias)
        for f, t, (fl, tl, a, b), (fr, tr, c, d) in self.trees:
            low, high = F.when(get(fl) <= tl, a).otherwise(b), F.when(get(fr) <= tr, c).otherwise(d)
            z = z + F.when(get(f) <= t, low).otherwise(high)
        return z

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        at = {k: i for i, k in enumerate(names)}
        z = np.full(len(x), self.bias)
        for f, t, (fl, tl, a, b), (fr, tr, c, d) in self.trees:
            z += np.where(x[:, at[f]] <= t, np.where(x[:, at[fl]] <= tl, a, b), np.where(x[:, at[fr]] <= tr, c, d))
        return z


@dataclass
class Models:
    """The trees of each kind that reached PRECISION."""

    kinds: dict[str, Boosted] = field(default_factory=dict)

    @property
    def thresholds(self) -> dict[str, float]:
        return {k: m.threshold for k, m in self.kinds.items()}

    def takes(self, c: Column) -> Column:
        """Whether a candidate is taken."""
        out = F.lit(False)
        for kind, m in self.kinds.items():
            out = F.when(c["kind"] == kind, m.score(lambda f: c[f]) >= m.threshold).otherwise(out)
        return out


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """At most CUTS thresholds for each feature."""
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        out.append(values[:-1] if len(values) <= CUTS else np.unique(np.quantile(values[:-1], np.linspace(0, 1, CUTS), method="nearest")))
    return out


def _best(sums: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int, float, float]:
    """From sums of gradients and curvatures by feature and bin: the feature and cut with the largest gain of a Newton step,
    and the leaves under and over it. Without a gain all goes under."""
    g, h = sums[0].sum(axis=0)
    best, choice = 1e-9, (0, CUTS, _leaf(g, h), 0.0)
    for j, own in enumerate(cuts):
        if not len(own):
            continue
        gl, hl = sums[j, : len(own)].cumsum(axis=0).T
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        k = int(gain.argmax())
        if gain[k] > best:
            best, choice = float(gain[k]), (j, k, _leaf(gl[k], hl[k]), _leaf(g - gl[k], h - hl[k]))
    return choice


def _leaf(g: float, h: float) -> float:
    return round(float(np.clip(RATE * g / (h + 1), -LEAF, LEAF)) * GRID) / GRID


def _bias(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return round(float(np.log(share / (1 - share))) * GRID) / GRID


def _at(cuts: list[np.ndarray], j: int, k: int) -> float:
    return float(cuts[j][k]) if k < CUTS else np.inf


def _sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.stack([np.stack([np.bincount(b, v, CUTS + 1) for v in (g, h)], axis=1) for b in bins.T])


def _split(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The feature and threshold that ``_best`` finds for rows in memory."""
    j, k, *_ = _best(_sums(bins, g, h), cuts)
    return j, _at(cuts, j, k)


def boost(x: np.ndarray, y: np.ndarray, names: list[str]) -> Boosted:
    """Logistic boosting by Newton steps, of rows in memory: what ``fit`` does in Spark, for tests to hold it against."""
    model = Boosted(_bias(float(y.mean()) if len(y) else 0.0))
    cuts = cuts_of(x)
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    z = np.full(len(x), model.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        if not len(y) or np.abs(g).max() < 0.02:
            break
        j, t = _split(bins, cuts, g, h)
        sides, low = [], x[:, j] <= t
        for part in (low, ~low):
            i, k, *leaf = _best(_sums(bins[part], g[part], h[part]), cuts)
            sides.append((names[i], _at(cuts, i, k), *leaf))
        model.trees.append((names[j], t, *sides))
        z = model.predict(x, names)
    return model


def calibrated(x: np.ndarray, y: np.ndarray, fold: np.ndarray, names: list[str]) -> Boosted:
    """Trees from all rows in memory. The threshold is the lowest at which scores of trees that haven't seen a row, by folds,
    reach PRECISION; none, where they don't."""
    model = boost(x, y, names)
    z = np.zeros(len(x))
    for k in range(FOLDS):
        z[fold == k] = boost(x[fold != k], y[fold != k], names).predict(x[fold == k], names)
    order = np.argsort(-z, kind="stable")
    score, hit, n = z[order], np.cumsum(y[order]), np.arange(1, len(x) + 1)
    last = np.append(np.diff(score) != 0, True) if len(score) else np.zeros(0, bool)
    good = np.flatnonzero(last & ((hit + (y.mean() if len(y) else 0)) / (n + 1) >= PRECISION))
    if len(good):
        model.threshold = float(score[good.max()])
    return model


def _constant(value, kind: str) -> Column:
    """A nested value as a literal, which generated code only refers to: queries that differ in it share their code."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _tree(z: Column, bins: Column, t: Column) -> Column:
    """The score after a tree: feature and bin of the split, then the same and the leaves of both sides."""
    side = lambda i: F.when(F.get(bins, F.get(t, i)) <= F.get(t, i + 1), F.get(t, i + 2)).otherwise(F.get(t, i + 3))
    return z + F.when(F.get(bins, F.get(t, 0)) <= F.get(t, 1), side(2)).otherwise(side(6))


def fit(found: DataFrame) -> Models:
    """Trees from all candidates (``found`` has doc_id and candidates), and thresholds from trees that haven't seen a fold.

    Candidates alike in all features are one row with their number. Spark sums gradients by feature and bin, for all kinds,
    all folds left out and none at once, twice a tree; the driver gets these sums, at most 2 * len(FEATURES) * (CUTS + 1) for
    each kind and fold, and never a candidate. Sums are whole numbers, so the trees don't depend on how rows are dealt out.
    """
    base, models = len(KINDS), Models()
    each = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.explode("candidates").alias("c"))
    each = each.select("fold", (F.col("c.rank") - base).alias("rank"), F.coalesce(F.col("c.seed"), F.lit(False)).cast("int").alias("seed"), F.array(*[F.col(f"c.{k}") for k in FEATURES]).alias("x"))
    rows = cut(each.groupBy("rank", "fold", "seed", "x").agg(F.count("*").alias("n")), "pii-rows")
    by = {(r["rank"], r["fold"]): (r["n"], r["hits"]) for r in rows.groupBy("rank", "fold").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("seed")).alias("hits")).collect()}
    total = lambda r, but=None: np.sum([v for (q, f), v in by.items() if q == r and f != but] or [(0, 0)], axis=0)
    kinds = [(r, kind) for r, kind in enumerate(GENERATORS) if total(r)[1]]
    if not kinds:
        remove(rows)
        return models
    values = rows.select("rank", F.posexplode("x")).distinct()
    at = F.array(*[F.lit(i / (CUTS - 1)) for i in range(CUTS)])
    spread = {(r["rank"], r["pos"]): (r["at"], r["most"]) for r in values.groupBy("rank", "pos").agg(F.percentile("col", at).alias("at"), F.max("col").alias("most")).collect()}

    def cuts_for(r: int, kind: str, j: int) -> np.ndarray:
        found, most = spread[r, j]
        cuts = np.unique(np.floor(found))
        return np.zeros(0) if FEATURES[j] in HIDDEN[kind] else cuts[cuts < most]

    cuts = [[cuts_for(r, kind, j) for j in range(len(FEATURES))] for r, kind in kinds]
    # model m of a kind leaves out fold m; the last one none
    many = FOLDS + 1
    of = [(i, kind, m) for i, (_, kind) in enumerate(kinds) for m in range(many)]
    forest = [Boosted(_bias(float(np.divide(*total(kinds[i][0], m)[::-1])) if total(kinds[i][0], m)[0] else 0.0)) for i, _, m in of]
    own = _constant([[c.tolist() for c in k] for k in cuts], "array<array<array<double>>>")
    place = F.array_position(F.array(*[F.lit(r) for r, _ in kinds]), F.col("rank")).cast("int") - 1
    binned = rows.withColumn("k", place).filter("k >= 0").withColumn("own", F.get(own, F.col("k")))
    bins = F.transform("x", lambda x, j: F.size(F.filter(F.get(F.col("own"), j), lambda t: t < x)))
    start = F.get(_constant([round(b.bias * GRID) for b in forest], "array<int>"), F.col("model"))
    made = binned.select("fold", "seed", "n", bins.alias("bins"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: F.col("k") * many + m)).alias("m", "model"))
    state = cut(made.select("model", (F.col("m") == F.col("fold")).alias("held"), "seed", "n", "bins", start.alias("z")), "pii-state")
    remove(rows)

    pending: list[list[list[int]]] = [[] for _ in of]

    def scored() -> Column:
        trees = F.get(_constant(pending, "array<array<array<int>>>"), F.col("model"))
        return F.aggregate(trees, F.col("z"), lambda z, t: _tree(z, F.col("bins"), t))

    def sums(roots: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """By model, side of its root, feature and bin; and the largest gradient of each model. Done models have no root."""
        root = F.get(_constant(roots, "array<array<int>>"), F.col("model"))
        seen = state.filter(~F.col("held")).withColumn("root", root).filter(F.size("root") > 0).withColumn("p", 1 / (1 + F.exp(-scored() / GRID)))
        whole = lambda x: F.round(x * UNIT).cast("long")
        seen = seen.select("model", "n", "bins", (F.get(F.col("bins"), F.get("root", 0)) <= F.get("root", 1)).alias("under"), whole(F.col("seed") - F.col("p")).alias("g"), whole(F.col("p") * (1 - F.col("p"))).alias("h"))
        cells = seen.select("model", "under", "n", "g", "h", F.posexplode("bins").alias("j", "bin")).groupBy("model", "under", "j", "bin")
        out, top = np.zeros((len(of), 2, len(FEATURES), CUTS + 1, 2)), np.zeros(len(of))
        for r in cells.agg(F.sum(F.col("n") * F.col("g")).alias("g"), F.sum(F.col("n") * F.col("h")).alias("h"), F.max(F.abs("g")).alias("top")).collect():
            out[r["model"], 0 if r["under"] else 1, r["j"], r["bin"]] = r["g"] / UNIT, r["h"] / UNIT
            top[r["model"]] = max(top[r["model"]], r["top"] / UNIT)
        return out, top

    open_models = list(range(len(of)))
    for _ in range(TREES):
        whole, top = sums([[0, CUTS] if i in open_models else [] for i in range(len(of))])
        open_models = [i for i in open_models if top[i] >= 0.02]
        if not open_models:
            break
        roots = {i: _best(whole[i, 0], cuts[of[i][0]])[:2] for i in open_models}
        parts, _ = sums([list(roots[i]) if i in roots else [] for i in range(len(of))])
        for i, (j, k) in roots.items():
            c = cuts[of[i][0]]
            sides = [_best(parts[i, side], c) for side in (0, 1)]
            forest[i].trees.append((FEATURES[j], _at(c, j, k), *[(FEATURES[f], _at(c, f, b), *leaf) for f, b, *leaf in sides]))
            pending[i].append([j, k, *[v for f, b, *leaf in sides for v in (f, b, *[round(x * GRID) for x in leaf])]])
        if max(map(len, pending)) >= STORED:
            new = cut(state.withColumn("z", scored()), "pii-state")
            remove(state)
            state, pending = new, [[] for _ in of]
    # the lowest score at which what lies above it, of candidates that its trees haven't seen, is precise enough
    kind = F.floor(F.col("model") / many).cast("int")
    scores = state.filter("held").select(kind.alias("k"), scored().alias("z"), "n", (F.col("n") * F.col("seed")).alias("hits")).groupBy("k", "z").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    above = Window.partitionBy("k").orderBy(F.desc("z"))
    share = F.get(_constant([float(total(r)[1] / total(r)[0]) for r, _ in kinds], "array<double>"), F.col("k"))
    precise = (F.sum("hits").over(above) + share) / (F.sum("n").over(above) + 1) >= PRECISION
    least = scores.withColumn("good", precise).filter("good").groupBy("k").agg(F.min("z").alias("z")).collect()
    remove(state)
    for r in least:
        models.kinds[kinds[r["k"]][1]] = model = forest[r["k"] * many + FOLDS]
        model.threshold = r["z"] / GRID
    return models


def with_spans(df: DataFrame, model: Models) -> DataFrame:
    """Adds ``spans``: the base spans and the chosen candidates that overlap none of them, in order."""
    if not model.kinds:
        return df.withColumn("spans", F.col("base"))
    chosen = F.filter("candidates", lambda c: ~c["within"] & F.coalesce(model.takes(c), F.lit(False)))
    extra = F.transform(chosen, lambda c: F.struct(c["start"], c["rank"], c["end"], c["kind"]))
    return df.withColumn("spans", F.array_sort(F.concat("base", extra)))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, Models]:
    """(doc_id, base, candidates of every document, as a stored table; the fitted trees). A null text has no span; a null
    doc_id stays null; repeated rows stay; a very long text is searched as a whole; other columns are dropped, but those
    named in ``carry`` are kept together in ``_own``, for ``redact_found``; an empty table gives an empty one and no tree."""
    searched = with_candidates(based(framed(docs.select("doc_id", *[c for c in dict.fromkeys(["text", *carry]) if c != "doc_id"]))))
    own = [F.struct(*[F.col("_own")[c].alias(c) for c in dict.fromkeys(["doc_id", *carry])]).alias("_own")] if carry else []
    found = cut(searched.select(F.col("_own.doc_id").alias("doc_id"), "base", "candidates", *own), "pii")
    return found, fit(found)


def redacted(df: DataFrame, model: Models) -> Column:
    """The text ``_t`` of a framed table with spans, each stretch of overlapping spans replaced by the kind of the first."""
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice("spans", 1, i), lambda s: s["end"])), F.lit(0))  # noqa: E731  how far the spans before i go

    def piece(s: Column, i: Column) -> Column:
        gap = F.substring(F.col("_t"), reach(i) + 1, s["start"] - reach(i))
        return F.when(s["start"] >= reach(i), F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))

    tail = F.substring(F.col("_t"), F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length("_t"))
    return F.when(F.size("spans") == 0, F.col("_own.text")).otherwise(F.concat(F.array_join(F.transform("spans", piece), ""), tail))


def redact(docs: DataFrame, model: Models) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in square brackets; of overlapping spans the first names
    the stretch that they cover together. All other columns stay, whatever their names; a null text stays null; repeated
    rows stay; an empty table gives an empty one."""
    df = with_spans(with_candidates(based(framed(docs))), model)
    return unframed(df, docs.columns, text=redacted(df, model))


def redact_found(found: DataFrame, model: Models) -> DataFrame:
    """The same from what ``find`` stored with ``text`` among the columns carried: nothing is searched again."""
    df = with_spans(found.withColumn("_t", F.coalesce(F.col("_own.text"), F.lit(""))), model)
    return unframed(df, found.schema["_own"].dataType.names, text=redacted(df, model))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_spans: all spans, the chosen candidates included."""
    found, model = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return with_spans(found, model).select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
