"""Secrets in texts: all rules in one automaton, one pass over the bytes.

Rules are regular expressions; subset construction and minimisation turn them into one array of transitions
(``automata``), which runs over the bytes of many texts at once. Where it says that some rule's match ends, the stretch
around it (from where the automaton had begun nothing to where it has begun nothing again) is taken apart rule by rule:
a reversed automaton marks where matches begin, and an anchored one takes the longest from the first of them. So matches
are the leftmost non-overlapping ones of each rule, whatever the other rules match.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automata import FENCE, Automaton, compile_patterns
from .common import table
from .hashing import buffer, slices


@dataclass(frozen=True)
class Rule:
    """A pattern whose match counts if its ``group`` has at least ``least`` bytes; else the match is dropped, and the search
    goes on behind it. The leftmost match must also be the longest from its place, as it is where every part can
    take but one way."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The contract's kinds. Runs of 16 hex digits and more are the same matches as all runs with the short ones
# dropped, as no match of the rule goes beyond its run.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What the method adds: published token formats, keys and credentials in addresses.
ADDED = (
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_.-]+", 60),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]+=*", 27),
    Rule("address", r"://[A-Za-z0-9._%+~-]+:[A-Za-z0-9._%+~!$&*-]+@", 8),
    Rule("private_key", r"-----BEGIN\x20[A-Z0-9\x20]*PRIVATE\x20KEY-----"),
)
RULES = BASE + ADDED
SPANS = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("rank", pa.int32()), pa.field("end", pa.int32()), pa.field("kind", pa.string())]))
SPANS_DDL = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass
class Scanner:
    """All rules as one automaton, and each as one that reads backwards and one that reads from a given place."""

    rules: tuple[Rule, ...]
    all: Automaton
    back: list[Automaton]
    from_here: list[Automaton]

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start and end as bytes of ``wide``, rule) of each match, and ``wide``: the texts, a fence before each."""
        raw, offsets = buffer(texts)
        n = len(texts)
        wide = np.full(len(raw) + n, FENCE, np.uint8)
        head = offsets[:-1] + np.arange(n)
        wide[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
        state = self.all.states(wide)
        hits = np.flatnonzero(self.all.ends[state])
        if not len(hits):
            return wide, head, np.zeros((0, 3), np.int64)
        still = np.flatnonzero(state == 0)  # each fence is one
        place = np.searchsorted(still, hits)
        first = still[place - 1] + 1
        after = np.append(still, len(wide))[place]
        stretch, which = np.unique(first, return_inverse=True)
        last = np.zeros(len(stretch), np.int64)
        last[which] = after
        marks = np.zeros(len(stretch), np.int64)
        np.bitwise_or.at(marks, which, self.all.ends[state[hits]])
        out = [(lo + s, lo + e, k) for lo, hi, mark in zip(stretch.tolist(), last.tolist(), marks.tolist(), strict=True) for k in range(len(self.rules)) if mark >> k & 1 for s, e in self.taken(k, wide[lo:hi])]
        return wide, head, np.array(out, np.int64).reshape(-1, 3)

    def taken(self, k: int, data: np.ndarray) -> list[tuple[int, int]]:
        """The matches of one rule in a stretch of bytes that are long enough."""
        rule, starts = self.rules[k], np.flatnonzero(self.back[k].ends[self.back[k].states(data[::-1])[::-1]])
        here = self.from_here[k]
        rows, kinds, ends, width = here.table.tolist(), here.kind[data].tolist(), here.ends.tolist(), here.width
        out, done, found = [], 0, re.compile(rule.pattern.encode()) if rule.group else None
        for start in starts.tolist():
            if start < done:
                continue
            state, end = 1, start
            for i in range(start, len(kinds)):
                state = rows[state * width + kinds[i]]
                if not state:
                    break
                if ends[state]:
                    end = i + 1
            done = end
            size = len(found.fullmatch(data[start:end].tobytes())[rule.group]) if found else end - start
            if size >= rule.least:
                out.append((start, end))
        return out


@functools.lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    if len({r.kind for r in rules}) < len(rules) or len(rules) > 62:
        raise ValueError("rules need different kinds, and 62 of them at most")
    each = [[r.pattern] for r in rules]
    return Scanner(rules, compile_patterns([r.pattern for r in rules]), [compile_patterns(p, reverse=True) for p in each], [compile_patterns(p, anchored=True) for p in each])


def spans_of(texts: pa.Array, scan: Scanner) -> pa.Array:
    """The spans of each text (no nulls), in code points, by start and then by rule."""
    wide, head, found = scan.found(texts)
    at = np.searchsorted(head, found[:, 0], "right") - 1
    order = np.lexsort((found[:, 2], found[:, 0]))
    found, at = found[order], at[order]
    begun = np.cumsum((wide & 0xC0) != 0x80)  # code points up to and with each byte; a fence counts as one
    point = lambda x: (begun[x - 1] - begun[head[at]]).astype(np.int32)
    kinds = pa.array([r.kind for r in scan.rules], pa.string())
    fields = [point(found[:, 0]), found[:, 2].astype(np.int32), point(found[:, 1])]
    rows = pa.StructArray.from_arrays([*map(pa.array, fields), kinds.take(pa.array(found[:, 2]))], fields=list(SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(texts) + 1)).astype(np.int32)), rows)


def with_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """``docs`` with the spans of its column ``text``: an array of (start, rank, end, kind) by start and then by rank, the
    rule's place among ``rules``; code points, end exclusive.

    A null or empty text has none; repeated rows stay; a very long text is one like any other (its bytes are walked in lanes
    between bytes that no rule passes, in memory of some ten times its size); all other columns stay, whatever their
    names; an empty table gives an empty one.
    """
    scan = scanner(rules)

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.fill_null("")
            parts = [spans_of(texts.slice(lo, hi - lo), scan) for lo, hi in slices(texts, 1 << 20)]
            yield pa.concat_arrays(parts) if parts else pa.array([], SPANS)

    # marked so, it isn't moved into filters and run again
    return docs.withColumn(name, F.arrow_udf(search, SPANS_DDL).asNondeterministic()(F.col("text")))


def redacted(docs: DataFrame, spans: str = "spans") -> Column:
    """The text with each stretch of overlapping spans replaced by the kind of the first, in square brackets."""
    step = lambda a, s: F.struct(
        F.greatest(a["done"], s["end"]).alias("done"),
        F.when(s["start"] >= a["done"], F.concat(a["parts"], F.array(F.substring(F.col("text"), a["done"] + 1, s["start"] - a["done"]), F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(a["parts"]).alias("parts"),
    )
    begin = F.struct(F.lit(0).alias("done"), F.array().cast("array<string>").alias("parts"))
    whole = lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col("text"), a["done"] + 1, F.length("text")))
    return F.when(F.size(spans) == 0, F.col("text")).otherwise(F.aggregate(spans, begin, step, whole))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its secrets replaced by their kinds; nulls, repeats and other columns as ``with_secrets`` has them."""
    name = "_spans"
    while name in docs.columns:
        name += "_"
    found = with_secrets(docs, rules, name)
    return found.withColumn("text", redacted(found, name)).drop(name)


def op13_secret_scans(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_spans: all spans, the added rules' included."""
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
