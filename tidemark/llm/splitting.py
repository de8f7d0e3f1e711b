"""Splitting of many texts at once as the pre-tokenizers of the two vocabularies do, for use inside tasks.

Texts are looked at as bytes. Every byte gets the class of its character (letter, number, white space, other), a part
starts where the class changes, and the parts come back as one string array with the number of parts of each text.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import buffer

LETTER, NUMBER, SPACE, OTHER = range(4)
#: What an apostrophe takes along at the start of a part, and the white space that isn't a separator to Unicode.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
CONTROLS = "\t\n\x0b\x0c\r\x85"


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    of = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[[ord(c) for c in CONTROLS]] = SPACE
    return out


def class_of_bytes(raw: np.ndarray) -> np.ndarray:
    """Of valid UTF-8: for every byte the class of the character that it belongs to."""
    table = classes()
    out = table[:256][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        size = 2 + (raw[lead] >= 0xE0).astype(np.int8) + (raw[lead] >= 0xF0)
        code = raw[lead].astype(np.int32) & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            code[more] = (code[more] << 6) | (raw[lead[more] + k] & 0x3F)
        of = table[code]
        out[lead] = of
        for k in range(1, 4):
            more = size > k
            out[lead[more] + k] = of[more]
    return out


def matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def holds(texts: pa.Array, strings: tuple[str, ...]) -> np.ndarray:
    """Which texts hold one of the strings."""
    out = np.zeros(len(texts), bool)
    for s in strings:
        out |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    return out


def _changes(of: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the class changes or a text begins."""
    first = np.empty(len(of), bool)
    np.not_equal(of[1:], of[:-1], out=first[1:])
    first[begins] = True
    return first


def _contract(raw: np.ndarray, first: np.ndarray, ends: np.ndarray) -> None:
    """Move part starts where an apostrophe that starts a part takes letters along; ``ends`` has where each text ends."""
    at = np.flatnonzero(raw == 39)
    at = at[first[at]]
    if not len(at):
        return
    end = ends[np.searchsorted(ends, at, "right")]
    taken = np.zeros(len(at), np.int64)
    for letters in CONTRACTIONS:
        fits = (taken == 0) & (at + len(letters) < end)
        for k, c in enumerate(letters):
            fits[fits] = raw[at[fits] + 1 + k] == ord(c)
        taken[fits] = len(letters)
    at, end, taken = at[taken > 0], end[taken > 0], taken[taken > 0]
    first[at + 1] = False
    behind = at + taken + 1
    behind = behind[behind < end]
    first[behind] = True  # even within a run of letters


def _array(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def lower_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(parts, how many each text has) as a lower-casing vocabulary of words sees them: letters, contractions, single
    numbers, and runs of what is no letter, number or white space. No nulls; white space is in no part."""
    raw, offsets = buffer(pc.utf8_lower(texts))
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    of, begins, ends = class_of_bytes(raw), offsets[:-1][np.diff(offsets) > 0], offsets[1:]
    first = _changes(of, begins)
    first |= (of == NUMBER) & ((raw & 0xC0) != 0x80)
    _contract(raw, first, ends)
    solid = of != SPACE
    first &= solid
    starts = np.flatnonzero(first)
    before = np.cumsum(solid, dtype=np.int32)  # white space goes, so parts stand side by side
    return _array(raw[solid], before[starts] - 1), np.diff(np.searchsorted(starts, offsets))


def byte_level_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, how many each text has) as byte-level BPE sees them: letters, numbers or others with the space before them,
    contractions, and runs of white space, of which the last joins no run that a word follows. No nulls."""
    raw, offsets = buffer(texts)
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    of, begins, ends = class_of_bytes(raw), offsets[:-1][np.diff(offsets) > 0], offsets[1:]
    first = _changes(of, begins)
    # the last white space before a word stands alone, or with the word if it is a plain space
    word = np.flatnonzero(first & (of != SPACE))
    word = word[word > 0]
    word = word[(of[word - 1] == SPACE) & ~np.isin(word, begins)]
    last = word - 1
    while len(wide := np.flatnonzero((raw[last] & 0xC0) == 0x80)):
        last[wide] -= 1
    first[last] = True
    first[word[raw[last] == 32]] = False
    _contract(raw, first, ends)
    starts = np.flatnonzero(first)
    return _array(raw, starts), np.diff(np.searchsorted(starts, offsets))
