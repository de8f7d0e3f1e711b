"""Patterns compiled to one deterministic automaton over bytes, and its scan over many texts at once.

A pattern is an ASCII regular expression of literals, classes, groups, ``(?i:...)``, ``|`` and ``? * + {m,n}``. Its positions
(one for each byte set) are the states of a nondeterministic automaton without empty moves; subsets of them are the states
of the deterministic one, which partition refinement then makes as few as possible.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: Between texts; no valid UTF-8 holds it, so no rule passes it.
FENCE = 0xFF
#: Bytes a lane of the scan takes at least, and the number of lanes below which they are walked one by one.
LANE, FEW = 512, 6

Tree = tuple


def _bytes(chars: str) -> int:
    return sum(1 << b for b in set(chars.encode("latin-1")))


def _fold(mask: int) -> int:
    """A byte set with both cases of its letters."""
    upper = (mask >> 97) & ((1 << 26) - 1)
    lower = (mask >> 65) & ((1 << 26) - 1)
    return mask | (upper << 65) | (lower << 97)


class _Reader:
    """Reads a pattern into a tree of (set, mask), (cat, parts), (alt, parts) and (rep, part, least, most or None)."""

    def __init__(self, pattern: str) -> None:
        if not pattern.isascii():
            raise ValueError("patterns are ASCII")
        self.s, self.i = pattern, 0

    def whole(self) -> Tree:
        tree = self.either(False)
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} of {self.s!r}")
        return tree

    def either(self, any_case: bool) -> Tree:
        parts = [self.row(any_case)]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.row(any_case))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def row(self, any_case: bool) -> Tree:
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.counted(self.one(any_case)))
        return ("cat", parts)

    def counted(self, part: Tree) -> Tree:
        while found := re.compile(r"[?*+]|\{(\d+)(,?)(\d*)\}").match(self.s, self.i):
            self.i = found.end()
            if found[1] is None:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[found[0]]
            else:
                least = int(found[1])
                most = int(found[3]) if found[3] else None if found[2] else least
            part = ("rep", part, least, most)
        return part

    def one(self, any_case: bool) -> Tree:
        c = self.s[self.i]
        if c == "(":
            opening = re.compile(r"\((?:\?(i?):|(?!\?))").match(self.s, self.i)
            if not opening:
                raise ValueError(f"unknown group at {self.i} of {self.s!r}")
            self.i = opening.end()
            tree = self.either(any_case or bool(opening[1]))
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError(f"open group in {self.s!r}")
            self.i += 1
            return tree
        if c == "[":
            mask = self.set()
        elif c in "*+?{}.^$":
            raise ValueError(f"{c!r} at {self.i} of {self.s!r} has no place here; escape it")
        else:
            mask = _bytes(self.char())
        return ("set", _fold(mask) if any_case else mask)

    def char(self) -> str:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return c
        if found := re.compile("x([0-9A-Fa-f]{2})").match(self.s, self.i):
            self.i = found.end()
            return chr(int(found[1], 16))
        c = self.s[self.i]
        self.i += 1
        if c.isalnum():
            raise ValueError(f"unknown escape {c!r} in {self.s!r}")
        return c

    def set(self) -> int:
        """A class; a negated one holds the other ASCII characters."""
        self.i += 1
        negated = self.s[self.i] == "^"
        self.i += negated
        mask, first = 0, True
        while first or self.s[self.i] != "]":
            first, low = False, self.char()
            high = low
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = self.char()
            mask |= sum(1 << b for b in range(ord(low), ord(high) + 1))
        self.i += 1
        return mask ^ ((1 << 128) - 1) if negated else mask


def backwards(tree: Tree) -> Tree:
    """The tree of the reversed strings."""
    kind, *rest = tree
    if kind == "cat":
        return ("cat", [backwards(t) for t in reversed(rest[0])])
    if kind == "alt":
        return ("alt", [backwards(t) for t in rest[0]])
    return tree if kind == "set" else ("rep", backwards(rest[0]), *rest[1:])


class _Positions:
    """Positions of several trees: their byte sets, which follow which, which begin a match, which end one of which tree."""

    def __init__(self, trees: list[Tree]) -> None:
        self.masks: list[int] = []
        self.follow: list[int] = []
        self.first, self.last = 0, [0] * len(trees)
        for k, tree in enumerate(trees):
            empty, first, self.last[k] = self.add(tree)
            if empty:
                raise ValueError("a pattern matches the empty string")
            self.first |= first

    def add(self, tree: Tree) -> tuple[bool, int, int]:
        """(whether it may be empty, its first positions, its last ones)"""
        kind, *rest = tree
        if kind == "set":
            self.masks.append(rest[0])
            self.follow.append(0)
            return False, 1 << (len(self.masks) - 1), 1 << (len(self.masks) - 1)
        if kind == "alt":
            parts = [self.add(t) for t in rest[0]]
            return any(p[0] for p in parts), _union(p[1] for p in parts), _union(p[2] for p in parts)
        if kind == "cat":
            out = (True, 0, 0)
            for t in rest[0]:
                out = self.join(out, self.add(t))
            return out
        part, least, most = rest
        out = (True, 0, 0)
        for _ in range(least if most is None else most):
            one = self.add(part)
            if _ >= least:
                one = (True, *one[1:])
            out = self.join(out, one)
        if most is None:
            if least:
                self.link(one[2], one[1])
            else:
                one = self.add(part)
                self.link(one[2], one[1])
                out = (True, *one[1:])
        return out

    def join(self, a: tuple[bool, int, int], b: tuple[bool, int, int]) -> tuple[bool, int, int]:
        self.link(a[2], b[1])
        return a[0] and b[0], a[1] | (b[1] if a[0] else 0), b[2] | (a[2] if b[0] else 0)

    def link(self, ends: int, starts: int) -> None:
        for p in _members(ends):
            self.follow[p] |= starts


def _union(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def _members(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


@dataclass
class Automaton:
    """A minimal deterministic automaton: ``table[state * width + kind[byte]]`` is the next state. State 0 has begun
    nothing; ``ends[state]`` has a bit for each pattern of which a match ends there."""

    kind: np.ndarray
    width: int
    table: np.ndarray
    ends: np.ndarray
    #: Bytes after which every state is state 0.
    fences: np.ndarray

    def states(self, data: np.ndarray) -> np.ndarray:
        """The state after each byte, from state 0. The bytes are cut after fences into lanes, which advance together;
        where no fence comes for long, a lane is as long as that."""
        n, out = len(data), np.zeros(len(data), self.table.dtype)
        kinds = self.kind[data]
        fence = np.flatnonzero(self.fences[data])
        wanted = np.searchsorted(fence, np.arange(LANE, n, LANE))
        begin = np.unique(np.append(fence[wanted[wanted < len(fence)]] + 1, 0))
        size = np.diff(np.append(begin, n))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state = np.zeros(len(begin), np.int64)
        longest, j = int(size[0]) if n else 0, 0
        while j < longest:
            active = int(np.searchsorted(-size, -j, "left"))
            if active < FEW:
                break
            at = begin[:active] + j
            now = self.table[state[:active] * self.width + kinds[at]]
            out[at] = now
            state[:active] = now
            j += 1
        if j < longest:
            table = self.table.tolist()
            for lane in range(int(np.searchsorted(-size, -j, "left"))):
                s, lo, hi = int(state[lane]), int(begin[lane]) + j, int(begin[lane] + size[lane])
                walked = []
                for k in kinds[lo:hi].tolist():
                    s = table[s * self.width + k]
                    walked.append(s)
                out[lo:hi] = walked
        return out


def compile_patterns(patterns: list[str], *, anchored: bool = False, reverse: bool = False) -> Automaton:
    """Subset construction and minimisation. ``anchored`` takes matches from the first byte only, where state 0 is
    dead and state 1 the beginning; ``reverse`` reads matches from their ends."""
    trees = [_Reader(p).whole() for p in patterns]
    nfa = _Positions([backwards(t) for t in trees] if reverse else trees)
    marks = sorted({*nfa.masks})
    sign = np.array([[m >> b & 1 for m in marks] for b in range(256)], np.uint8)
    _, example, kind = np.unique(sign, axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)
    width = len(example)
    # for each class of bytes, the positions that take it
    takes = [_union(1 << p for p, m in enumerate(nfa.masks) if m >> int(b) & 1) for b in example]
    again = 0 if anchored else nfa.first
    begin = -1  # the anchored beginning, which no move reaches
    number, todo, rows, ends = {0: 0}, [0], [], []
    if anchored:
        number[begin] = 1
        todo.append(begin)
    for at in todo:
        after = nfa.first if at == begin else again | _union(nfa.follow[p] for p in _members(at))
        row = []
        for t in takes:
            new = after & t
            if new not in number:
                number[new] = len(number)
                todo.append(new)
            row.append(number[new])
        rows.append(row)
        ends.append(0 if at == begin else sum(1 << k for k, last in enumerate(nfa.last) if at & last))
    moves, ends = np.array(rows, np.int64), np.array(ends, np.int64)
    # states of one class have the same ends and moves to the same classes; nothing is like state 0 or the beginning
    label = np.unique(np.stack([ends, np.minimum(np.arange(len(ends)), 1 + anchored)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.concatenate([label[:, None], label[moves]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    _, one = np.unique(label, return_index=True)
    # classes by their first state, so that 0 (and 1) keep their numbers
    rank = np.empty(len(one), np.int64)
    rank[np.argsort(one, kind="stable")] = np.arange(len(one))
    one = np.sort(one)
    table = rank[label[moves[one]]]
    small = np.uint16 if len(one) <= 1 << 16 else np.uint32
    return Automaton(kind.astype(np.uint8), width, table.reshape(-1).astype(small), ends[one], (table == 0).all(axis=0)[kind])
