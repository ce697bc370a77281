"""Pre-tokens of whole Arrow text columns, and their encoding once per distinct pre-token.

The pattern of the public byte-level vocabularies splits a text into contractions, runs of letters,
of numbers and of other characters (each with one space before it), and white space. Each boundary
depends on a few characters, so all boundaries of a batch come from array comparisons. Texts with a
character on whose class Unicode versions disagree are left to the caller, as `hard`.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from .common import span_hashes, text_of

OTHER, LETTER, NUMBER, SPACE, HARD = range(5)


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    for p in np.flatnonzero(out != OTHER).tolist():
        if unicodedata.category(chr(p)) == "Cn":
            out[p] = HARD
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B]] = HARD
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of each character of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[at].astype(np.uint32)
    for low, high, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        which = np.flatnonzero((point >= low) & (point < high) & (point < 0x100))
        which = which[data[at[which]] >= 0xC0] if len(which) else which
        if len(which):
            value = point[which] & keep
            for j in range(1, more + 1):
                value = (value << 6) | (data[at[which] + j] & 0x3F)
            point[which] = value + 0x80000000  # marked, so that a later round skips it
    return at, point & 0x7FFFFFFF


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of all pre-tokens, `first` (pre-tokens of text i: first[i] to first[i + 1])
    and `hard` (whether text i needs another way)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64), np.zeros(len(off) - 1, bool)
    at, point = code_points(data)
    kind = classes()[point]
    n = len(at)
    begin = np.searchsorted(at, off)  # each text's first character
    edge = np.zeros(n + 1, bool)
    edge[begin] = True
    hard_at = np.searchsorted(begin, np.flatnonzero(kind == HARD), "right") - 1
    hard = np.zeros(len(off) - 1, bool)
    hard[hard_at] = True
    space = kind == SPACE
    blank = point == 32
    cut = edge[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    # the last white space before something else begins a pre-token; if it is a blank, it takes what follows along
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    cut |= last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & blank[:-1]
    cut &= ~joined | edge[:n]
    # contractions: an apostrophe that begins a pre-token and stands alone before letters
    q = np.flatnonzero(cut & (point == 39))
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == LETTER) & ~edge[q + 1]]
    if len(q):
        one = point[q + 1]
        short = np.isin(one, [115, 116, 109, 100])
        two = np.where((q + 2 < n) & ~edge[np.minimum(q + 2, n)], point[np.minimum(q + 2, n - 1)], 0)
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for some, size in ((short, 2), (pair & ~short, 3)):
            c = q[some]
            cut[c + 1] = False
            after = c + size
            after = after[after < n]
            # what follows the contraction begins anew, unless a text ends there anyway
            cut[after] = True
    starts = np.flatnonzero(cut)
    start = at[starts]
    end = np.append(start[1:], len(data))
    return start, end, np.searchsorted(start, off), hard


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start[0], start[0] + 1, ... of `size` each, one after another."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(start - (ends - size), size)


_KIND = np.zeros(256, np.uint8)  # of ASCII bytes: 1 letters, 2 digits, 3 other printable, 4 white space; else 0
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[9, 10, 13, 32]] = 4
_KIND[39] = 0  # apostrophes may begin a contraction


def places_of(data: np.ndarray, marks: tuple[bytes, ...]) -> np.ndarray:
    """Start and end of each occurrence of the marks, overlapping ones too, in order of their starts."""
    raw, found = data.tobytes() if marks else b"", []
    for mark in marks:
        at = raw.find(mark)
        while at >= 0:
            found.append((at, at + len(mark)))
            at = raw.find(mark, at + 1)
    return np.array(sorted(found), np.int64).reshape(-1, 2)


def safe_cuts(data: np.ndarray, step: int, marks: tuple[bytes, ...] = ()) -> list[int]:
    """Places about `step` bytes apart at which a text can be cut without a change of its pre-tokens:
    between ASCII characters of different kinds, the first of them no white space, and not in or beside
    a mark. Where there is none, a piece is longer."""
    spans = places_of(data, marks)
    reach = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]

    def free(cut: np.ndarray) -> np.ndarray:
        before = np.searchsorted(spans[:, 0], cut, "right")  # marks that begin at or before the place
        return (before == 0) | (reach[before - 1] < cut) if len(spans) else np.ones(len(cut), bool)

    cuts, at = [0], step
    while at < len(data):
        for far in range(at, len(data), 1 << 16):
            kind = _KIND[data[far - 1 : far + (1 << 16)]]
            before, after = kind[:-1], kind[1:]
            found = far + np.flatnonzero((before != after) & (before > 0) & (before < 4) & (after > 0))
            if len(found := found[free(found)]):
                cuts.append(int(found[0]))
                break
        else:
            break
        at = cuts[-1] + step
    return [*cuts, len(data)]


class Encoder:
    """Ids of whole texts: `encode_words` (list of bytes -> list of id lists) is asked once for each
    distinct pre-token, `encode_text` (str -> ids) for texts that are hard or hold one of `marks`
    (strings that are tokens of their own). What is remembered is bounded by `limit` pre-tokens; a
    text of more than `step` bytes is encoded in pieces, so memory follows its ids."""

    def __init__(self, encode_words: Callable, encode_text: Callable, marks: tuple[bytes, ...] = (), limit: int = 1_000_000, step: int = 2 << 20):
        self.encode_words, self.encode_text, self.marks, self.limit, self.step = encode_words, encode_text, marks, limit, step
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids = self.encode_words(pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))
        at = len(self.store) + np.cumsum(size) - size
        self.store = np.concatenate([self.store, flat])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def __call__(self, batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        data, off = text_of(batch, column)
        if len(data) <= 2 * self.step:
            return self._encode(data, off)
        ids, counts = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            cuts = safe_cuts(data[a:b], self.step, self.marks)
            parts = [self._encode(data[a + p : a + q], np.array([0, q - p]))[0] for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
            ids += parts
            counts.append(sum(map(len, parts)))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, first, hard = split(data, off)
        hard[np.searchsorted(off, places_of(data, self.marks)[:, 0], "right") - 1] = True
        if len(self.known) > self.limit:
            self.clear()
        codes, distinct = pd.factorize(span_hashes(data, start, end))
        if len(distinct):
            place = np.searchsorted(self.known, distinct)
            new = np.ones(len(distinct), bool)
            inside = place < len(self.known)
            new[inside] = self.known[place[inside]] != distinct[inside]
            if new.any():
                seen = np.empty(len(distinct), np.int64)
                seen[codes[::-1]] = np.arange(len(codes))[::-1]
                raw = data.tobytes()
                where = seen[new]
                self._learn(distinct[new], [raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
                place = np.searchsorted(self.known, distinct)
            size = self.size[place][codes]
            ids = self.store[ragged(self.at[place][codes], size)]
            total = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=total[1:])
            counts = total[first[1:]] - total[first[:-1]]
        else:
            ids, counts = np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        if hard.any():
            parts, at = [], np.concatenate([[0], np.cumsum(counts)])
            for i in range(len(counts)):
                own = ids[at[i] : at[i + 1]]
                if hard[i]:
                    own = np.asarray(self.encode_text(data[off[i] : off[i + 1]].tobytes().decode()), np.uint32)
                parts.append(own)
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, counts
