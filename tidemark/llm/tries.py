"""Double-array tries over whole numbers, built and walked with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Children of a node that share a base, about; a node with more has several bases, by a hash of the symbol.
SHARE = 2
#: Groups that are placed at a time; after so many tries that place less than such a part of them the array grows by an eighth.
AT_ONCE, TRIES = 1 << 16, 32
#: Multiplier of the hash: 2 ** 32 by the golden ratio.
SPREAD = np.int64(2654435769)


@dataclass
class Trie:
    """Node 0 is the root. The bases of node s begin at first[s], 2 ** bits[s] of them, and a hash of symbol c says which is b. The
    child of s by c is base[b] + c, if check[base[b] + c] is b (not s: other bases of s may reach that place by other symbols).
    ``entry`` is the number of the path that ends at a node, or -1."""

    first: np.ndarray
    bits: np.ndarray
    base: np.ndarray
    check: np.ndarray
    entry: np.ndarray

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes have a child by their symbol, these children); symbols are in range."""
        own = self.first[nodes] + which(symbols, self.bits[nodes])
        to = self.base[own] + symbols
        have = np.flatnonzero(self.check[to] == own)
        return have, to[have]


def which(symbols: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Each symbol's base among 2 ** bits."""
    return ((symbols * SPREAD) & 0xFFFFFFFF) >> (32 - bits.astype(np.int64))


def build(paths: np.ndarray, symbols: int) -> Trie:
    """A trie of distinct paths of one length, as rows of symbols below ``symbols``. Bases are drawn by chance, for all groups of
    children of one size at a time and the largest first, so the work follows the number of nodes."""
    n, depth = paths.shape
    order = np.lexsort(paths.T[::-1]).astype(np.int32)
    # nodes by depth, numbered in the order of the sorted rows: parent and symbol of each; the root is 0
    new, parents, syms, count, node = np.zeros(n, bool), [], [], 1, np.zeros(n, np.int32)
    new[:1] = True
    for d in range(depth):
        column = paths[order, d].astype(np.int32)
        new[1:] |= column[1:] != column[:-1]
        parents.append(node[new])
        syms.append(column[new])
        node = np.cumsum(new, dtype=np.int32) + np.int32(count - 1)
        count += len(syms[-1])
    parent, symbol = np.concatenate(parents), np.concatenate(syms)
    del parents, syms, column, new
    children = np.bincount(parent, minlength=count)
    bits = np.ceil(np.log2(np.maximum(1, children / SHARE))).astype(np.int8)
    many = np.where(children > 0, 1 << bits.astype(np.int64), 0)
    bases = int(many.sum())  # the one after them is of the nodes without children
    first = np.where(children > 0, np.cumsum(many) - many, bases).astype(np.int32)
    # edges by their group, those with the same base
    group = first[parent] + which(symbol, bits[parent]).astype(np.int32)
    del children, many, parent
    by = np.argsort(group, kind="stable").astype(np.int32)
    begin = np.flatnonzero(np.diff(group[by], prepend=-1)).astype(np.int32)
    size = np.diff(begin, append=len(by))
    base = np.zeros(bases + 1, np.int32)
    place = np.zeros(count, np.int32)  # of each node in the array
    room, rng = 2 * count, np.random.Generator(np.random.PCG64(1))
    owner = np.full(room + symbols, -1, np.int32)
    owner[0] = bases
    for c in np.unique(size)[::-1].tolist():
        waiting, tried = begin[size == c], 0
        while len(waiting):
            left = waiting[:AT_ONCE]
            edges = by[left[:, None] + np.arange(c, dtype=np.int32)]
            own = group[edges[:, 0]]
            at = rng.integers(0, room, len(left), np.int32)
            to = at[:, None] + symbol[edges]
            free = np.flatnonzero((owner[to] < 0).all(axis=1))
            # of groups that meet in a place the one written last has it; a group needs all of its places
            owner[to[free]] = own[free, None]
            got = (owner[to[free]] == own[free, None]).all(axis=1)
            lost = to[free[~got]]
            owner[lost[owner[lost] == own[free[~got], None]]] = -1
            done = free[got]
            base[own[done]] = at[done]
            place[edges[done] + 1] = to[done]
            waiting = np.concatenate([waiting[AT_ONCE:], np.delete(left, done)])
            tried += 1 if len(done) * TRIES < len(left) else 0
            if tried == TRIES:
                tried, more = 0, room // 8 + 1
                owner, room = np.append(owner, np.full(more, -1, np.int32)), room + more
    del owner, by, begin, size, symbol
    top = int(base.max()) + symbols + 1
    trie = Trie(np.full(top, bases, np.int32), np.zeros(top, np.int8), base, np.full(top, -1, np.int32), np.full(top, -1, np.int32))
    trie.first[place], trie.bits[place] = first, bits
    trie.check[place[1:]] = group
    trie.entry[place[node]] = order
    return trie
