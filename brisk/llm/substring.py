"""Substring de-duplication over words by recompression.

Recompression names runs of equal symbols and pairs of neighbours in rounds: a run gets one name,
then a bit of each name splits the alphabet into left and right, and each left-right pair gets one
name. What a symbol becomes depends on its neighbours alone, so equal substrings get equal symbols in
their interior. Names are 64-bit fingerprints of what they stand for and need no table, so they are
the same in every task. With each symbol goes the span of words that it depends on. A window of
`window` words is named by the highest symbol whose span lies within it (of several, the one with
the largest name): equal windows have equal names, wherever they stand.

1. Rows (name, doc_id) are counted; names that stand in one document only are dropped.
2. Windows with a repeated name are compared: (name and fingerprint of all words, document, start),
   pre-aggregated to the smallest doc_id of each.
3. A document loses the words of each window that also starts in a document with a smaller id, or
   earlier in its own text.

Windows count as equal if their 64-bit name and another 64-bit fingerprint of all their words are.

Nothing is grouped by a name or a window: both are counted with partial sums, written, and joined
back, so that Spark can split the join where a third of the documents share a passage. A document's
own list is as long as the document at most.

Defined cases: null and empty texts have no words; texts shorter than the window lose nothing; a null
doc_id comes after all others; rows that share a doc_id (or have none) never remove words from each
other, only from themselves; a very long text is named in overlapping pieces; further columns pass
through, but those named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, freed_shuffles, mix, small_batches, table, widened
from .pretoken import ragged

#: Words of a window, and rounds of pairing (more would give spans wider than a window).
WINDOW, ROUNDS = 20, 5
#: Text bytes of a step; arrays of a step take about 60 times as much.
STEP = 2 << 20
#: Words of a piece of a long text.
PIECE = 1 << 18
_LAST = (1 << 63) - 1
_U = np.uint64
_ODD = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB)


def rolling(names: np.ndarray, base: int) -> np.ndarray:
    """Sums from which `spans` reads the polynomial hash of any span of names."""
    steps = np.full(len(names) + 1, base, np.uint64)
    steps[0] = 1
    up = np.multiply.accumulate(steps)
    sums = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(mix(names + _U(base)) * up[:-1], out=sums[1:])
    return sums


def spans(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    steps = np.full(len(sums), pow(base, -1, 1 << 64), np.uint64)
    steps[0] = 1
    down = np.multiply.accumulate(steps)
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


class Level:
    """Symbols of a batch of texts: names, words [lo, hi) they stand for, words [a, b) they depend
    on, and whether a text begins with them. A dependence on a text's edge reaches beyond it."""

    def __init__(self, name, lo, hi, a, b, new):
        self.name, self.lo, self.hi, self.a, self.b, self.new = name, lo, hi, a, b, new

    def runs(self) -> Level:
        """Name runs of equal symbols; that a run ends depends on its neighbours."""
        n = len(self.name)
        cut = np.ones(n, bool)
        cut[1:] = (self.name[1:] != self.name[:-1]) | self.new[1:]
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n) - 1
        size = (last - first + 1).astype(np.uint64)
        name = np.where(size > 1, mix(self.name[first] + size * _U(_ODD[2])), self.name[first])
        a = np.where(self.new[first], self.lo[first] - 1, self.a[np.maximum(first - 1, 0)])
        ends = (last + 1 == n) | self.new[np.minimum(last + 1, n - 1)]
        b = np.where(ends, self.hi[last] + 1, self.b[np.minimum(last + 1, n - 1)])
        return Level(name, self.lo[first], self.hi[last], a, b, self.new[first])

    def pairs(self, turn: int) -> Level:
        """Name left-right pairs; a symbol that stays alone depends on the one it did not pair with."""
        n = len(self.name)
        right = (mix(self.name ^ _U(_ODD[turn % 4] + turn)) >> _U(63)).astype(bool)
        joins = np.zeros(n + 1, bool)  # whether i and i + 1 pair
        joins[: n - 1] = ~right[:-1] & right[1:] & ~self.new[1:]
        taken = np.zeros(n, bool)
        taken[1:] = joins[: n - 1]
        a, b = self.a.copy(), self.b.copy()
        final = np.ones(n, bool)  # a text ends with the symbol
        final[:-1] = self.new[1:]
        lone_left = np.flatnonzero(~right & ~joins[:n])
        after = np.minimum(lone_left + 1, n - 1)
        b[lone_left] = np.where(final[lone_left], self.hi[lone_left] + 1, np.maximum(self.b[lone_left], self.b[after]))
        a[lone_left] = np.where(final[lone_left], self.a[lone_left], np.minimum(self.a[lone_left], self.a[after]))
        lone_right = np.flatnonzero(right & ~taken)
        before = np.maximum(lone_right - 1, 0)
        a[lone_right] = np.where(self.new[lone_right], self.lo[lone_right] - 1, np.minimum(self.a[lone_right], self.a[before]))
        b[lone_right] = np.where(self.new[lone_right], self.b[lone_right], np.maximum(self.b[lone_right], self.b[before]))
        name = self.name.copy()
        hi = self.hi.copy()
        i = np.flatnonzero(joins[:n])
        name[i] = mix(mix(self.name[i] + _U(turn)) * _U(_ODD[3]) + self.name[i + 1])
        hi[i] = self.hi[i + 1]
        a[i] = np.minimum(self.a[i], self.a[i + 1])
        b[i] = np.maximum(self.b[i], self.b[i + 1])
        stay = ~taken
        return Level(name[stay], self.lo[stay], hi[stay], a[stay], b[stay], self.new[stay])


class Windows:
    """Windows of a batch of texts: where they start, whose they are, names and fingerprints."""

    def __init__(self, words: Words, window: int = WINDOW, names: bool = True):
        n = len(words.start)
        text = words.text_ids()
        self.at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :]) if n >= window else np.zeros(0, np.int64)
        self.text = text[self.at]
        self.start = self.at - words.first[self.text]
        if not len(self.at):
            self.name = self.print = np.zeros(0, np.uint64)
            return
        self.print = spans(rolling(words.hash, _ODD[0]), self.at, self.at + window, _ODD[0])
        if names:
            self.name = self._names(words, window, n)

    def _names(self, words: Words, window: int, n: int) -> np.ndarray:
        place = np.arange(n)
        new = np.zeros(n, bool)
        new[words.first[:-1][words.counts > 0]] = True
        level = Level(words.hash, place, place + 1, place, place + 1, new).runs()
        levels = []
        for turn in range(ROUNDS):
            level = level.pairs(turn)
            levels.append(level)
        sums = rolling(words.hash, _ODD[1])
        best = np.zeros(n, np.uint64)
        open_ = np.zeros(n, bool)
        open_[self.at] = True
        for turn in range(ROUNDS - 1, 0, -1):
            level = levels[turn]
            fit = np.flatnonzero((level.b - level.a <= window) & (level.a >= 0) & (level.b <= n))
            low, high = np.maximum(level.b[fit] - window, 0), level.a[fit]
            fit, low, size = fit[high >= low], low[high >= low], (high - low + 1)[high >= low]
            key = mix(level.name[fit] ^ spans(sums, level.a[fit], level.b[fit], _ODD[1])) | _U(1)
            where = ragged(low, size)
            key = np.repeat(key, size)
            use = open_[where]
            np.maximum.at(best, where[use], key[use])
            open_ &= best == 0
            if not open_.any():
                break
        name = best[self.at]
        # no symbol fits: the window is its own name, by another fingerprint than `print`
        return np.where(name == 0, mix(spans(sums, self.at, self.at + window, _ODD[1])), name)


class Part:
    """Some words of one text, as `Windows` reads them."""

    def __init__(self, words: Words, lo: int, hi: int):
        self.start, self.end, self.hash = words.start[lo:hi], words.end[lo:hi], words.hash[lo:hi]
        self.counts, self.first, self.n_texts = np.array([hi - lo]), np.array([0, hi - lo]), 1

    def text_ids(self) -> np.ndarray:
        return np.zeros(len(self.hash), np.int64)


def windows_of(words: Words, window: int) -> Windows:
    """Windows with names. A name depends on the words of its window alone, so those of a long text
    come from pieces that overlap by a window and a word at each side."""
    if words.n_texts != 1 or len(words.start) <= 2 * PIECE:
        return Windows(words, window)
    n, parts = len(words.start), []
    for begin in range(0, n - window + 1, PIECE):
        lo, hi = max(0, begin - 1), min(n, begin + PIECE + window)
        w = Windows(Part(words, lo, hi), window)
        own = (w.at + lo >= begin) & (w.at + lo < begin + PIECE)
        parts.append((w.at[own] + lo, w.print[own], w.name[own]))
    out = Windows.__new__(Windows)
    out.at, out.print, out.name = (np.concatenate(x) for x in zip(*parts, strict=True))
    out.text, out.start = np.zeros(len(out.at), np.int64), out.at
    return out


def _distinct(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """First index of each distinct (text, value)."""
    both = mix(value + text.astype(np.uint64) * _U(_ODD[2]))
    return np.sort(np.unique(both, return_index=True)[1])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _columns(batch: pa.RecordBatch, names: list[str], which: np.ndarray) -> list[pa.Array]:
    return [batch.column(n).take(pa.array(which)) for n in names]


def name_rows(docs: DataFrame, window: int) -> DataFrame:
    """(ord, th, name): the distinct names of each document's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=STEP):
            w = windows_of(Words(batch), window)
            i = _distinct(w.text, w.name)
            yield pa.RecordBatch.from_arrays([*_columns(batch, ["ord", "th"], w.text[i]), signed(w.name[i])], ["ord", "th", "name"])

    return docs.select("ord", "th", "text").mapInArrow(run, "ord long, th long, name long")


def window_rows(docs: DataFrame, window: int) -> DataFrame:
    """(name, print, ord, th, start): windows whose name is in the document's array `names`, the first of
    equal ones within a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=STEP):
            w = windows_of(Words(batch), window)
            lists = batch.column("names")
            wanted = mix(lists.flatten().to_numpy().view(np.uint64) + np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()).astype(np.uint64) * _U(_ODD[2]))
            i = np.flatnonzero(np.isin(mix(w.name + w.text.astype(np.uint64) * _U(_ODD[2])), wanted))
            i = i[_distinct(w.text[i], mix(w.print[i] ^ mix(w.name[i])))]
            yield pa.RecordBatch.from_arrays([signed(w.name[i]), signed(w.print[i]), *_columns(batch, ["ord", "th"], w.text[i]), pa.array(w.start[i].astype(np.int32))], ["name", "print", "ord", "th", "start"])

    return docs.select("ord", "th", "text", "names").mapInArrow(run, "name long, print long, ord long, th long, start int")


def cut(docs: DataFrame, window: int) -> DataFrame:
    """docs (text, _drop: starts of windows to remove) with n_words, n_removed and kept_text."""
    names = [c for c in docs.columns if c != "_drop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=STEP):
            words = Words(batch)
            n = len(words.start)
            w = Windows(words, window, names=False)
            later = np.ones(len(w.at), bool)
            later[_distinct(w.text, w.print)] = False
            lists = batch.column("_drop")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            begin = np.concatenate([w.at[later], words.first[owner] + lists.flatten().to_numpy()]).astype(np.int64)
            edge = np.zeros(n + window + 1, np.int32)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + window, -1)
            gone = np.cumsum(edge)[:n] > 0
            text = words.text_ids()
            removed = np.bincount(text[gone], minlength=words.n_texts)
            stay = np.flatnonzero(~gone)
            size = words.end[stay] - words.start[stay] + 1
            ends, out = np.cumsum(size), np.empty(int(size.sum()), np.uint8)
            for at in range(0, len(stay), PIECE):
                part = slice(at, at + PIECE)
                where = np.minimum(ragged(words.start[stay[part]], size[part]), max(len(words.data) - 1, 0))
                out[ends[at] - size[at] : ends[at] - size[at] + len(where)] = words.data[where]
            out[ends - 1] = 32
            bounds = np.concatenate([[0], ends])[np.searchsorted(text[stay], np.arange(words.n_texts + 1))]
            raw = out.tobytes()
            kept = [raw[p : max(p, q - 1)].decode() for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            new = [pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, "n_words", "n_removed", "kept_text"])

    return docs.mapInArrow(run, widened(docs, "n_words long, n_removed long, kept_text string", without=("_drop",)))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed and kept_text (kept words, one space apart)."""
    results = ("n_words", "n_removed", "kept_text")
    docs = docs.drop(*results)  # replaced
    spark = docs.sparkSession
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), F.xxhash64("text").alias("th")]
    texts = docs.select(*key, "text")
    with freed_shuffles(spark), Scratch(spark, "windows") as scratch:
        names = scratch.keep(name_rows(texts, window), "names")
        often = scratch.keep(names.groupBy("name").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("name"), "often")
        lists = names.join(often.hint("merge"), "name", "left_semi").groupBy("ord", "th").agg(F.collect_set("name").alias("names"))
        lists = scratch.keep(lists, "lists")
        scratch.free("names", "often")
        rows = scratch.keep(window_rows(texts.join(lists.hint("merge"), ["ord", "th"]), window), "rows")
        scratch.free("lists")
        both = ["name", "print"]
        first = scratch.keep(rows.groupBy(*both).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select(*both, "lo"), "first")
        late = rows.join(first.hint("merge"), both).where("ord > lo").groupBy("ord", "th").agg(F.collect_set("start").alias("_drop"))
        late = scratch.give(late).withColumnsRenamed({"ord": "_o", "th": "_h"})
    # rows travel as one struct, so that no name can clash
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text", key[0].alias("_ord"), key[1].alias("_th"))
    full = packed.join(late.hint("merge"), (F.col("_ord") == F.col("_o")) & (F.col("_th") == F.col("_h")), "left").select("row", "text", "_drop")
    done = cut(full, window)
    return done.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns), *results)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
