"""Benchmark decontamination: find benchmark items in documents, up to some edited words.

Words are compared lower-cased and without ASCII punctuation. A CGK random walk reads a window of
words and writes a sequence of fixed length: in each step it writes the word it stands at, and a
random bit of the step and the word says whether it moves on. Windows at a small edit distance then
agree in many places, so bit-sampling LSH applies: a key is made of SAMPLED places, and windows that
share one of the keys of all repetitions are candidates.

Windows are as long as the items ask for: items of a length class (each a quarter longer than the one
before) have windows of PART of the class's least length, one at each of the words that leave room.
A document is only read where the first two words of such a window stand, so that a walk costs little;
an item has so many windows that edits do not hit the first words of all. A candidate is verified
exactly: the whole item must stand around it with at most EDITS of 100 of its words inserted, deleted
or replaced.

Items of fewer than SHORT words have too few windows for that. They are found without a miss: an item
with room for e edits is cut into e + 1 pieces, one of which stands in the document as it is. Items
of 1 to 4 words have no room for edits and must stand there word for word.

One scan and no shuffle: keys of documents are looked up where the text lies. A pass holds at most
ITEMS items (sent to all tasks). More items take more passes, one after another: each writes its
hits, and the documents meet them at the end.

Scripts that are written without blanks (Han, kana, Thai, Lao, Burmese, Khmer) count each character as
a word.

Defined cases: null and empty texts contain nothing; items that are null or without a word are not
searched; equal items are all reported; repeated documents get equal results; a very long text is
searched whole, in memory that follows its words; further columns pass through, but those named like
a result are replaced; an empty benchmark finds nothing. `decontaminate` ignores items that say
nothing about where a text comes from: those of fewer than FEWEST words and fewer than LONG
characters.

Recall against exhaustive search is measured in the tests. In 400 trials for each of ten lengths, with
as many edits as are allowed, items of 15 words were missed once in 400, longer ones (16 to 59 words)
never; shorter ones cannot be missed.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, around, attach, freed_shuffles, lean, mix, shingle_hashes, small_batches, spare, table, widened
from .pretoken import ragged

#: Edited words in 100, items of a pass, walks and keys read from each, places in a key.
EDITS, ITEMS, WALKS, KEYS, SAMPLED = 20, 20_000, 4, 6, 3
#: Part of an item's length that a window has (a walk has twice as many steps), growth of length
#: classes, fewest words of an item that windows serve, and fewest words, or else characters, of an
#: item for which a document is dropped.
PART, GROWTH, SHORT, FEWEST, LONG = 0.7, 1.25, 15, 4, 16
_U = np.uint64
_PUNCTUATION = r"[!-/:-@\[-`{-~]+"
_UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}]"

def plain(text: Column) -> Column:
    """Lower case, punctuation as blanks, blanks around characters of scripts without them."""
    out = F.regexp_replace(F.lower(text), _PUNCTUATION, " ")
    return F.when(F.octet_length(text) > F.length(text), F.regexp_replace(out, _UNSPACED, " $0 ")).otherwise(out)


class Stream:
    """Words of a batch with an end mark after each text."""

    def __init__(self, words: Words):
        n = len(words.hash)
        self.first = words.first[:-1] + np.arange(words.n_texts)
        self.end = words.first[1:] + np.arange(words.n_texts)
        self.word = np.zeros(n + words.n_texts + 1, np.uint64)
        place = np.arange(n) + words.text_ids()
        self.word[place] = words.hash
        self.text = np.repeat(np.arange(words.n_texts + 1), np.append(words.counts + 1, 1))


def window_size(n: int) -> int:
    """Words of the windows of an item of n words."""
    least = SHORT
    while int(least * GROWTH) + 1 <= n:
        least = int(least * GROWTH) + 1
    return int(PART * least)


def pairs(word: np.ndarray) -> np.ndarray:
    """Hashes of each word and the next."""
    return mix(word[:-1] * _U(0xD6E8FEB86659FD93) + word[1:])


def keys(word: np.ndarray, starts: np.ndarray, sizes: list[int], seed: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, repetition, LSH keys) of the windows that start at some words. All sizes share a walk
    and sample their own part of it; a key also holds the first two words. The walk stays at an end
    mark (0)."""
    first = pairs(word)[starts]
    for walk in range(WALKS):
        users: dict[int, list[tuple[int, int, np.uint64]]] = {}
        for size in sizes:
            random = np.random.default_rng([seed, size, walk])
            for k in range(KEYS):
                for step in random.choice(2 * size, min(SAMPLED, size), replace=False).tolist():
                    users.setdefault(step, []).append((size, k, random.integers(1, 1 << 63, dtype=np.uint64) * _U(2) + _U(1)))
        out = {(size, k): np.zeros(len(starts), np.uint64) for size in sizes for k in range(KEYS)}
        at = starts.copy()
        for step in range(max(users, default=-1) + 1):
            if step % 64 == 0:
                bits = mix(word + _U(0x632BE59BD9B4E019 + seed + walk) + _U(step))
                bits[word == 0] = 0
            if step in users:
                seen = word[at]
                for size, k, factor in users[step]:
                    out[size, k] += seen * factor
            at += (bits[at] >> _U(step % 64)).astype(np.int64) & 1
        for (size, k), key in out.items():
            yield size, walk * KEYS + k, mix(key + first)


class Lookup:
    """Sorted keys of places in items, behind a bit table."""

    def __init__(self, key: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item, self.place = (x[order] if len(x) else x for x in (item, place))  # a set of keys has no places
        self.shift = _U(64 - min(20, max(10, int(np.ceil(np.log2(16 * len(key) + 1))))))
        self.bits = np.zeros(1 << int(_U(64) - self.shift), bool)
        self.bits[self.key >> self.shift] = True

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, its word, number of the key) for each place of an item with one of the keys."""
        at = np.flatnonzero(self.bits[key >> self.shift])
        low, high = np.searchsorted(self.key, key[at]), np.searchsorted(self.key, key[at], "right")
        at, low, count = at[high > low], low[high > low], (high - low)[high > low]
        hit = ragged(low, count)
        return self.item[hit], self.place[hit], np.repeat(at, count)


class Index:
    """A pass's items: keys of windows for each repetition, and pieces of short items by length."""

    def __init__(self, items: list[np.ndarray], edits: int = EDITS):
        self.items = items
        self.sets = [frozenset(x.tolist()) for x in items]
        self.windows: dict[tuple[int, int], Lookup] = {}
        self.sizes: list[int] = []
        self.first: Lookup | None = None
        if own := [k for k, x in enumerate(items) if len(x) >= SHORT]:
            self.sizes = sorted({window_size(len(items[k])) for k in own})
            word = np.concatenate([np.append(items[k], _U(0)) for k in own])
            begin = np.cumsum([0, *(len(items[k]) + 1 for k in own)])[:-1]
            room = [len(items[k]) - window_size(len(items[k])) + 1 for k in own]
            item, size = np.repeat(own, room), np.repeat([window_size(len(items[k])) for k in own], room)
            place = ragged(np.zeros(len(own), np.int64), np.array(room))
            starts = np.repeat(begin, room) + place
            self.first = Lookup(np.unique(pairs(word)[starts]), item[:0], item[:0])
            for s, r, key in keys(word, starts, self.sizes):
                mine = size == s
                self.windows[s, r] = Lookup(key[mine], item[mine], place[mine])
        # of short items: words, their number and that of edits; pieces by length
        self.word = np.zeros((len(items), SHORT), np.uint64)
        self.length = np.array([len(x) for x in items], np.int64)
        self.most = self.length * edits // 100
        pieces: dict[int, list[tuple]] = {}
        for k, x in enumerate(items):
            if 0 < len(x) < SHORT:
                self.word[k, : len(x)] = x
                cuts = [len(x) * i // (self.most[k] + 1) for i in range(self.most[k] + 2)]
                for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                    pieces.setdefault(q - p, []).append((shingle_hashes(x[p:q], q - p)[0], k, p))
        self.pieces = {n: Lookup(np.array([r[0] for r in rows], np.uint64), *np.array([r[1:] for r in rows], np.int64).T) for n, rows in pieces.items()}

    def promising(self, word: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Which places of short items can hold: enough words stand where some edits may have moved
        them to."""
        most, right = self.most[item], np.zeros(len(item), np.int64)
        far = int(most.max(initial=0))
        for j in range(SHORT - 1):
            inside, seen = j < self.length[item], np.zeros(len(item), bool)
            for shift in range(-far, far + 1):
                at = np.clip(begin + (j + shift), 0, len(word) - 1)
                seen |= (abs(shift) <= most) & (word[at] == self.word[item, j])
            right += seen & inside
        return right >= self.length[item] - most

    def candidates(self, stream: Stream) -> np.ndarray:
        """Distinct rows (text, item, word of the document at which the item would begin)."""
        found = []
        if self.first is not None and len(stream.word) > 1:
            pair = pairs(stream.word)
            near = np.flatnonzero(self.first.bits[pair >> self.first.shift])
            place = np.minimum(np.searchsorted(self.first.key, pair[near]), len(self.first.key) - 1)
            starts = near[self.first.key[place] == pair[near]]
            for s, r, key in keys(stream.word, starts, self.sizes):
                item, ahead, at = self.windows[s, r].find(key)
                found.append(np.column_stack([stream.text[starts[at]], item, starts[at] - ahead]))
        for n, known in self.pieces.items():
            item, ahead, at = known.find(shingle_hashes(stream.word, n))
            begin = at - ahead
            for i in range(0, len(at), 1 << 18):
                part = slice(i, i + (1 << 18))
                yes = self.promising(stream.word, item[part], begin[part])
                found.append(np.column_stack([stream.text[at[part]], item[part], begin[part]])[yes])
        found = [f for f in found if len(f)]
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def within(item: list[int], region: list[int], most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of the item in the region, the first of several, if at most
    `most` edits apart: edit distance with free ends in the region, a column at a time in the bits
    of an integer."""
    m = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best = None
    for j, w in enumerate(region):
        eq = where.get(w, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & every
        plus, minus = (down | ~(diagonal | up)) & every, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & every, minus << 1 & every
        up, down = (minus | ~(diagonal | plus)) & every, plus & diagonal
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def hits_of(stream: Stream, index: Index, edits: int = EDITS) -> list[list[tuple[int, int, int]]]:
    """For each text its items: (item, first word of the place looked at, distance)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in stream.first]
    done: set[tuple[int, int]] = set()
    for text, item, begin in index.candidates(stream).tolist():
        if (text, item) in done:
            continue
        words = index.items[item]
        most = len(words) * edits // 100
        first, end = int(stream.first[text]), int(stream.end[text])
        lo, hi = max(first, begin - most), min(end, begin + len(words) + most)
        region, known = stream.word[lo:hi].tolist(), index.sets[item]
        if sum(w in known for w in region) < len(words) - most:
            continue
        if got := within(words.tolist(), region, most):
            done.add((text, item))
            out[text].append((item, max(begin, first) - first, got[0]))
    return out


@functools.lru_cache(2)
def _index(packed: bytes, edits: int) -> tuple[list, Index]:
    ids, items = pickle.loads(packed)
    return ids, Index(items, edits)


def item_words(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))
    return [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


_HITS = "array<struct<item_id:bigint,at:bigint,distance:bigint>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("at", pa.int64()), ("distance", pa.int64())]))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text: plain words, n_words, n_chars) of the items that have words."""
    items = benchmark.select(F.col("item_id").cast("long"), plain(F.col("text")).alias("text"))
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    return items.withColumns({"n_words": words, "n_chars": F.length(F.regexp_replace("text", r"\s+", ""))}).where("n_words > 0")


def _search(docs: DataFrame, plain_text: str, items: list, edits: int) -> DataFrame:
    """docs with the hits of the items (item_id, text) in place of the column `plain_text`."""
    packed = ([r["item_id"] for r in items], item_words([r["text"] for r in items]))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(packed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, index = _index(sent.value, edits)
        for batch in small_batches(batches, plain_text, 2 << 20):
            found = hits_of(Stream(Words(batch, plain_text)), index, edits)
            hits = [[{"item_id": ids[k], "at": at, "distance": d} for k, at, d in own] for own in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(hits, _HIT)], [*kept, "hits"])

    kept = [c for c in docs.columns if c != plain_text]
    return docs.mapInArrow(lean(run), widened(docs, f"hits {_HITS}", without=(plain_text,)))


def find_items(docs: DataFrame, benchmark: DataFrame, edits: int = EDITS, most_items: int = ITEMS) -> DataFrame:
    """docs with `hits`, an array of (item_id, at: word of the document, distance), by item_id."""
    docs = docs.drop("hits")  # replaced
    items = _items(benchmark)
    passes = max(1, -(-items.count() // most_items))
    of = lambda i: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).orderBy("item_id", "text").collect()
    if passes == 1:
        work = spare(docs, "_plain")
        return _search(docs.withColumn(work, plain(F.col("text"))), work, of(0), edits).withColumn("hits", F.array_sort("hits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), plain(F.col("text")).alias("_plain"))
    spark = docs.sparkSession
    with freed_shuffles(spark), Scratch(spark, "items") as scratch:
        parts = [scratch.keep(_search(texts, "_plain", of(i), edits).where(F.size("hits") > 0).distinct(), f"pass-{i}") for i in range(passes)]
        every = functools.reduce(DataFrame.unionByName, parts).select("doc_id", "th", F.explode("hits").alias("hit"))
        found = scratch.give(every.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("hit")).alias("hits")))
    return attach(docs, found, ["hits"], all_rows=True).withColumn("hits", F.coalesce("hits", F.array().cast(_HITS)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs less those in which an item of FEWEST words or LONG characters was found."""
    telling = _items(benchmark).where(f"n_words >= {FEWEST} or n_chars >= {LONG}").select("item_id", "text")
    return around(docs, ("hits",), lambda d: find_items(d, telling, edits).where(F.size("hits") == 0))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.at", "h.distance")
