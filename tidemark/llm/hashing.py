"""Vectorised text helpers for use inside tasks: byte buffers, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time in a task, which take some 80 times as much memory; a single longer text is handled alone.
SLICE_BYTES = 1 << 18


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE, STEP = _random(256, 1), _random(8, 2)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """STEP[0] to the powers 0 to n - 1, modulo 2 ** 64."""
    out = np.full(n, STEP[0], np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    _, ends = buffer(texts)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, how many words each text has)."""
    raw, offsets = buffer(texts)
    n = len(texts)
    wide = np.full(len(raw) + n + 1, 32, np.uint8)  # a blank before each text and at the end
    wide[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = LOWER[raw]
    solid = np.flatnonzero(~BLANK[wide])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    first = np.flatnonzero(np.diff(solid, prepend=-2) != 1)
    length = np.diff(np.append(first, len(solid)))
    place = np.arange(len(solid)) - np.repeat(first, length)
    hashes = mix(np.add.reduceat(BYTE[wide[solid]] * powers(int(length.max()))[place], first) + length.astype(np.uint64) * STEP[1])
    bounds = offsets + np.arange(n + 1)  # where each text's own blank stands
    return hashes, np.diff(np.searchsorted(solid[first], bounds))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; how many each text has). A text with fewer words than
    ``size`` has its whole sequence of words as one shingle; without a word it has none."""
    words, count = word_hashes(texts)
    ends = np.cumsum(count)
    full = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        full += words[k : k + len(full)] * STEP[2 + k]
    full = mix(full)
    sets, sizes = [], np.zeros(len(count), np.int64)
    for i, (n, end) in enumerate(zip(count.tolist(), ends.tolist(), strict=True)):
        if n >= size:
            one = np.unique(full[end - n : end - size + 1])
        elif n:
            one = mix((words[end - n : end] * STEP[2 : 2 + n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            continue
        sets.append(one)
        sizes[i] = len(one)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes
