"""Spelling variants: which words of a corpus are one edit away from a much more frequent one.

Counts of letter runs are made where the text lies and added up. Pairs of words that differ by exactly
one inserted, deleted or replaced code point come from a self-join of the vocabulary's trie: a walk
down the trie carries, for each node, its active nodes, those whose words differ from the node's own by
one edit so far. Below that edit the letters must be equal, so an active node goes on as its child of
the same letter, and a pair of terminal nodes that meet is a pair of words.

The trie is partitioned by prefix. Two words whose shorter one has m letters share the first m // 2
letters or the last m - m // 2; they meet in a part of the trie of words or in one of the trie of
reversed words. A part with more than MOST words is handed on to its children: pairs that part below
it meet there, those that differ at its own node by what stands after that letter, a few dozen words
at most. So no part is larger than MOST words, whatever letters a third of the vocabulary begins
with, and no pair is made but those at distance one. A part is walked over its sorted words, a node
being a range of them: memory follows its words, and the length of words sets no bound on depth.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty text in the choice
of runs that lose a letter; rows that are equal count each; a word with no word near has n_near 0, no
form and is its own root; ties of counts go to the smallest word in code-point order; only doc_id and
text of a table are read; an empty table gives no words; a run of millions of letters is one word.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, Scratch, freed_shuffles, small_batches, table, text_of
from .pretoken import ragged

#: Letters of the shortest word, occurrences of the rarest, and how many times as frequent a form is.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: Words in a part of the trie at most.
MOST = 4096
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and any second one


def _crc_steps() -> np.ndarray:
    """What eight shifts make of each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


class _Runs:
    """Runs of letters of a batch with at least `letters` code points, lower-cased: distinct words, and
    for each run its word, text and number of bytes and code points."""

    def __init__(self, batch: pa.RecordBatch, letters: int):
        data, off = text_of(batch)
        lead = data == _LEAD
        letter = _ASCII[data] | lead
        letter[1:] |= lead[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1] | edge[1:-1]
        last[:-1] &= ~letter[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        leads = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=leads[1:])
        points = end - start - (leads[end] - leads[start])
        long = points >= letters
        start, size, self.points = start[long], (end - start)[long], points[long]
        self.size = size
        self.text = np.searchsorted(off, start, "right") - 1
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        letters_of = np.ascontiguousarray(_LOWER[data[ragged(start, size)]])
        words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(letters_of)])
        coded = words.dictionary_encode()
        self.words, self.word = coded.dictionary, coded.indices.to_numpy()


def _crc_of(runs: _Runs, words: list[str], ids: list[str]) -> np.ndarray:
    """CRC-32 of `<id>:<word>` for each run: that of the id is shifted by the word's length, that of the word is the same wherever it stands."""
    own = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))
    crc = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in ids), np.uint32, len(ids))[runs.text]
    steps, left, k = _crc_steps(), np.flatnonzero(runs.size <= 256), 0
    while len(left):
        now = crc[left]
        crc[left] = steps[now & 255] ^ now >> 8
        k += 1
        left = left[runs.size[left] > k]
    crc ^= own[runs.word]
    for i in np.flatnonzero(runs.size > 256).tolist():
        crc[i] = zlib.crc32(f"{ids[runs.text[i]]}:{words[runs.word[i]]}".encode())
    return crc


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, garble: int | None = None) -> DataFrame:
    """Lower-cased runs of `[A-Za-z\\u00C0-\\u00FF]` with their counts n. With garble, a run loses a code
    point where garble divides the CRC-32 of `<doc_id>:<run>`, at that number modulo its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            runs = _Runs(batch, letters)
            if not len(runs.word):
                continue
            changed: dict[str, int] = {}
            whole = runs.word
            if garble:
                words = runs.words.to_pylist()
                ids = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
                crc = _crc_of(runs, words, ids).astype(np.int64)
                hit = crc % garble == 0
                pairs, n = np.unique(np.stack([runs.word[hit].astype(np.int64), (crc % runs.points)[hit]]), axis=1, return_counts=True)
                for w, at, k in zip(*pairs.tolist(), n.tolist(), strict=True):
                    left = words[w][:at] + words[w][at + 1 :]
                    if len(left) >= letters:
                        changed[left] = changed.get(left, 0) + k
                whole = runs.word[~hit]
            counts = np.bincount(whole, minlength=len(runs.words))
            there = np.flatnonzero(counts)
            word = pa.concat_arrays([runs.words.take(pa.array(there)).cast(pa.string()), pa.array(list(changed), pa.string())])
            yield pa.RecordBatch.from_arrays([word, pa.array(np.concatenate([counts[there], np.fromiter(changed.values(), np.int64, len(changed))]))], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _together(a: str, b: str) -> int:
    """Letters that two words have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _walk(words: list[str], depth: int) -> Iterator[tuple[str, str]]:
    """Pairs at distance one of sorted distinct words that share their first `depth` letters. A node is
    a range of words and a depth; active nodes are ranges with the depth that they have come to."""
    there = set(words)
    stack: list[tuple[int, int, int, set[tuple[int, int, int]]]] = [(0, len(words), depth, set())]
    while stack:
        lo, hi, at, active = stack.pop()
        node = (lo, hi, at)
        if len(words[lo]) == at:  # a terminal node
            for a, _, b in active:
                if len(words[a]) == b:
                    yield words[lo], words[a]
            lo += 1
        before: list[tuple[int, int, int]] = []
        while lo < hi:
            letter = words[lo][at]
            end = lo + 1 if lo + 1 == hi or words[lo + 1][at] != letter else bisect_right(words, letter, lo, hi, key=lambda w: w[at])  # noqa: B023
            if end - lo == 1:  # one word is left: what goes on with its letters is a word or is not
                word, met = words[lo], set()
                for a, _, b in active:
                    other = words[a][:b] + word[at:]
                    if other in there:
                        met.add(other)
                for a, _, _ in before:
                    other = words[a][: at + 1] + word[at + 1 :]
                    if other in there:
                        met.add(other)
                other = word[:at] + word[at + 1 :]
                if other in there:
                    met.add(other)
                for other in met:
                    yield word, other
            else:
                on = {(lo2, hi2, b + 1) for a, z, b in active for lo2, hi2 in [_child(words, a, z, b, letter)] if lo2 < hi2}
                on.update(before)  # replaced
                on.add(node)  # inserted here, or missing there
                stack.append((lo, end, at + 1, on))
            before.append((lo, end, at + 1))
            lo = end


def _child(words: list[str], lo: int, hi: int, at: int, letter: str) -> tuple[int, int]:
    key = lambda w: w[at : at + 1]
    lo = bisect_left(words, letter, lo, hi, key=key)
    return lo, bisect_right(words, letter, lo, hi, key=key)


def _siblings(words: list[str], at: int, shorter: int) -> Iterator[tuple[str, str]]:
    """Pairs that differ at `at` only, of words that are equal without that letter or are what the others are without it."""
    short = [w for w in words if len(w) == shorter]
    for w in words:
        for v in short:
            if (len(w) > shorter or w > v) and w[at : at + 1] != v[at : at + 1]:
                yield w, v


def _parts(vocab: DataFrame, letters: int) -> DataFrame:
    """Rows (back, least: letters of the shorter word, at: depth, kind, part, word as the trie has it, n) of each word: as a shorter and as a longer word, forwards and backwards."""
    size = F.length("word")
    both = F.array(*(F.struct(F.lit(back).alias("back"), least.alias("least")) for back in (False, True) for least in (size, size - 1)))
    rows = vocab.select("word", "n", F.explode(both).alias("p")).select("p.*", "word", "n").where(F.col("least") >= letters)
    half = F.floor(F.col("least") / 2).cast("int")
    rows = rows.select("back", "least", F.when(F.col("back"), F.col("least") - half).otherwise(half).alias("at"), F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "n")
    return rows.select("back", "least", "at", F.lit("t").alias("kind"), F.substring("word", F.lit(1), F.col("at")).alias("part"), "word", "n")


def _handed_on(rows: DataFrame) -> DataFrame:
    """The rows of parts that are too large: in the part of their next letter, and by what they are without it."""
    at, word = F.col("at"), F.col("word")
    without = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    deeper = F.when(F.length(word) > at, F.struct((at + 1).alias("at"), F.lit("t").alias("kind"), F.substring(word, F.lit(1), at + 1).alias("part")))
    equal = F.when(F.length(word) == F.col("least"), F.struct(at.alias("at"), F.lit("r").alias("kind"), without.alias("part")))
    whole = F.struct(at.alias("at"), F.lit("i").alias("kind"), F.when(F.length(word) == F.col("least"), word).otherwise(without).alias("part"))
    rows = rows.select("back", "least", "word", "n", F.explode(F.array_compact(F.array(deeper, equal, whole))).alias("p"))
    return rows.select("back", "least", "p.at", "p.kind", "p.part", "word", "n")


def _near(vocab: DataFrame, letters: int, most: int, pairs: bool, scratch: Scratch) -> DataFrame:
    """Pairs (word, near) if asked for, else (word, n_near, best_n, best) of each word and part."""
    key = ["back", "least", "at", "kind", "part"]
    rows = _parts(vocab, letters)
    done, k = [], 0
    while True:
        large = scratch.keep(rows.where("kind = 't'").groupBy(key).count().where(F.col("count") > most).drop("count"), f"large{k}")
        if large.isEmpty():
            break
        done.append(rows.join(large, key, "left_anti"))
        rows = scratch.keep(_handed_on(rows.join(large, key, "left_semi")), f"parts{k}")
        k += 1
    for other in done:
        rows = rows.unionByName(other)

    def found(group: list[str], at: int, kind: str, least: int, back: bool) -> Iterator[tuple[int, int]]:
        """Places of the words of each pair of a part."""
        place = {w: i for i, w in enumerate(group)}
        for a, b in _walk(group, at) if kind == "t" else _siblings(group, at, least):
            if min(len(a), len(b)) == least and not (back and _together(a[::-1], b[::-1]) >= least // 2):
                yield place[a], place[b]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            same = pc.run_end_encode(batch.column("part"))
            held.append(batch)
            if len(same.run_ends) > 1:
                whole = pa.Table.from_batches(held)
                cut = whole.num_rows - batch.num_rows + same.run_ends[len(same.run_ends) - 2].as_py()
                yield from blocks(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield from blocks(pa.Table.from_batches(held))

    def blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        c = {n: rows.column(n).combine_chunks() for n in (*key, "word", "n")}
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for n in ("part", "kind", "at", "least", "back"):
            new[1:] |= pc.not_equal(c[n].slice(1), c[n].slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        end = np.append(start[1:], rows.num_rows)
        several = np.flatnonzero(end - start > 1)
        words, n = c["word"], c["n"].to_numpy()
        at, kind, least, back = ([c[k][i].as_py() for i in start[several].tolist()] for k in ("at", "kind", "least", "back"))
        one, two = [], []
        for i, (lo, hi) in enumerate(zip(start[several].tolist(), end[several].tolist(), strict=True)):
            group = words.slice(lo, hi - lo).to_pylist()
            for a, b in found(group, at[i], kind[i], least[i], back[i]):
                one.append(lo + a)
                two.append(lo + b)
        if not one:
            return
        word = pc.if_else(c["back"], pc.utf8_reverse(words), words)
        a, b = np.array(one + two), np.array(two + one)
        if pairs:
            yield pa.RecordBatch.from_arrays([word.take(pa.array(one)), word.take(pa.array(two))], ["word", "near"])
            return
        # of each word its most frequent near word, the smallest of several
        texts = np.array(word.take(pa.array(np.unique(b))).to_pylist(), object)
        rank = np.empty(rows.num_rows, np.int64)
        rank[np.unique(b)[np.argsort(texts, kind="stable")]] = np.arange(len(texts))
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        yield pa.RecordBatch.from_arrays([word.take(pa.array(a[first])), pa.array(np.diff(np.r_[first, len(a)])), pa.array(n[b[first]]), word.take(pa.array(b[first]))], ["word", "n_near", "best_n", "best"])

    dealt = rows.repartition(*key).sortWithinPartitions("part", "kind", "at", "least", "back", "word")
    return dealt.mapInArrow(search, "word string, near string" if pairs else "word string, n_near long, best_n long, best string")


def near_pairs(vocab: DataFrame, letters: int = LETTERS, most: int = MOST) -> DataFrame:
    """Each pair (word, near) of distinct words of vocab (word, n) at distance one, once."""
    with freed_shuffles(vocab.sparkSession), Scratch(vocab.sparkSession, "near") as scratch:
        vocab = scratch.keep(vocab.select("word", F.col("n").cast("long").alias("n")), "words")
        return scratch.give(_near(vocab, letters, most, True, scratch))


def variants(vocab: DataFrame, letters: int = LETTERS, times: int = TIMES, most: int = MOST) -> DataFrame:
    """Each word of vocab (word, n) with n_near, form, form_n and root."""
    spark = vocab.sparkSession
    with freed_shuffles(spark), Scratch(spark, "spelling") as scratch:
        vocab = scratch.keep(vocab.select("word", F.col("n").cast("long").alias("n")), "words")
        parts = _near(vocab, letters, most, False, scratch)
        best = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("b"))
        much = -F.col("b.m") >= times * F.col("n")
        rows = vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("b.best")).alias("form"), F.when(much, -F.col("b.m")).alias("form_n"))
        rows = scratch.keep(rows, "forms")
        # counts grow tenfold from word to form, so chains are short
        links = rows.where("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to"))
        step, k, steps = links.select(F.lit(1).alias("k"), F.col("from").alias("word"), F.col("to").alias("root")), 1, []
        while True:
            steps.append(step)
            k += 1
            step = scratch.keep(step.join(links, F.col("root") == F.col("from")).select(F.lit(k).alias("k"), "word", F.col("to").alias("root")), f"step{k}")
            if step.isEmpty():
                break
        ends = steps[0]
        for s in steps[1:]:
            ends = ends.unionByName(s)
        ends = ends.groupBy("word").agg(F.max(F.struct("k", "root")).alias("e")).select("word", F.col("e.root").alias("root"))
        return scratch.give(rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), garble=31))


ORACLE = r"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
 low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs WHERE len(run) >= 7 GROUP BY ALL),
 hexed AS (SELECT run, k, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM low),
 crc AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, [CASE WHEN i % 8 = 0 THEN CAST('0x' || x[i // 4 + 1 : i // 4 + 2] AS BIGINT) ELSE 0 END FOR i IN range(4 * len(x))]),
    lambda c, y: CASE WHEN xor(c, y) & 1 = 1 THEN xor(xor(c, y) >> 1, 3988292384) ELSE xor(c, y) >> 1 END), 4294967295) AS h FROM hexed),
 seen AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % len(run) AS INT)) || substr(run, CAST(h % len(run) AS INT) + 2) ELSE run END AS word, k FROM crc),
 words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM seen WHERE len(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
 cuts AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)),
 one AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
 best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM one GROUP BY word),
 formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
 chain AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) USING (word)
"""
ORACLE = ORACLE.replace("WITH runs", "WITH RECURSIVE runs", 1)
