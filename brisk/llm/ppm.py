"""Scores of texts by prediction by partial matching over bytes, and by single words.

The model is a trie of byte contexts: for each context of up to `order` bytes, how often each byte came
next in the training texts. A text is its UTF-8 bytes and an end mark, behind a start of end marks; the
end mark is the byte 0xFF, which no text holds. A byte that was seen in the longest context has the
share c / (C + d) there, C being all occurrences in the context and d its distinct bytes. Otherwise the
context escapes with d / (C + d) to the next shorter one, where bytes of the longer ones are excluded
from C and d, and from the empty context to all bytes that no text holds. A context whose bytes are all
excluded is passed over, one that holds all 256 does not escape. So the probabilities of all texts sum
to one. (c, C, d and exclusion: Moffat's method C.)

How it runs. Every position of a text is a run of order + 1 bytes, a number. The runs are counted where
the texts lie and added up, those of texts that are scored only with count 0. A branch of the trie holds
all runs with the same last three bytes of context; branches are dealt over tasks, which give every run
its log probability. What three branches of different tasks share, contexts of 0 to 2 bytes, is at most
256 ** 3 counts and sent along. Then texts are read again. The most frequent runs and words, CORE of each
at most, are sent to all tasks; each text lists the others, which are joined with the model by Spark
and added up. Both ways give the same numbers.

Defined cases: null and empty texts are an end mark alone; a null doc_id is a row like any other; equal
rows count and score each; without training texts all bytes are alike; a very long text is read in
stretches, but for its words; further columns pass through but for `text`, and those named like a
result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _IS_BLANK, _LOWER, Scratch, freed_shuffles, lean, small_batches, span_hashes, table, text_of, widened
from .pretoken import ragged

#: Bytes of context, 3 to 6.
ORDER = 5
#: Runs, and words of up to LETTERS bytes, that are sent to all tasks.
CORE, LETTERS = 1 << 20, 64
#: Runs that a task adds up before it hands them on; bytes of texts, or of a long one, that are read at once.
HELD, STRETCH = 2 << 20, 1 << 20
END = 0xFF
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
_LOW = 3  # bytes of the runs that all branches share


def _runs(batch: pa.RecordBatch, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The runs of all texts, one for each byte and end, and how many each text has; those of a text
    that is a batch of its own in stretches."""
    data, off = text_of(batch)
    size = np.diff(off)
    start = off[:-1] + (order + 1) * np.arange(len(size))  # order marks before each text, one after it
    padded = np.full(len(data) + (order + 1) * len(size), END, np.uint8)
    padded[ragged(start + order, size)] = data

    def rolled(part: np.ndarray) -> np.ndarray:
        runs = np.zeros(max(0, len(part) - order), np.uint64)
        for j in range(order + 1):
            runs <<= np.uint64(8)
            runs |= part[j : j + len(runs)]
        return runs

    if len(size) == 1:
        for at in range(0, int(size[0]) + 1, STRETCH):
            runs = rolled(padded[at : at + STRETCH + order])
            yield runs, np.array([len(runs)])
    else:
        yield rolled(padded)[ragged(start, size + 1)], size + 1


class _Words:
    """Words of a batch: distinct lower-cased ones, the word of each place, and how many a text has."""

    def __init__(self, batch: pa.RecordBatch):
        data, off = text_of(batch)
        word = ~_IS_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        ends = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=ends[1:])
        coded = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[word]])]).dictionary_encode()
        self.words, self.word = coded.dictionary, coded.indices.to_numpy()
        self.counts = np.diff(np.searchsorted(start, off))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(n, new)


def _distinct(keys: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.r_[new, len(keys)]) if counted else np.zeros(len(new), np.int64)


def counts(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """(run, word, n): each run of order + 1 bytes and each word of docs, one of the two null, with its occurrences in texts with `train`, which may be 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(run: pa.Array, word: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([run, word, pa.array(n)], ["run", "word", "n"])

        def handed_on() -> Iterator[pa.RecordBatch]:
            keys, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield out(pa.array(keys.astype(np.int64)), pa.nulls(len(keys), pa.string()), n)

        for batch in small_batches(batches, limit=STRETCH):
            learn = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for runs, size in _runs(batch, order):
                from_train = np.repeat(learn, size)
                held += [_distinct(runs[from_train], True), _distinct(runs[~from_train], False)]
            if sum(len(k) for k, _ in held) > HELD:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > HELD // 2:
                    yield from handed_on()
                    held = []
            words = _Words(batch)
            n = np.bincount(words.word[np.repeat(learn, words.counts)], minlength=len(words.words))
            yield out(pa.nulls(len(n), pa.int64()), words.words.cast(pa.string()), n)
        if held:
            yield from handed_on()

    rows = docs.select("text", F.coalesce(train, F.lit(False)).alias("train"))
    return rows.mapInArrow(lean(count), "run long, word string, n long").groupBy("run", "word").agg(F.sum("n").alias("n"))


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys hold the wanted ones, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _Trie:
    """Counts of contexts of all orders, of branches that are whole."""

    def __init__(self, order: int, tops: dict[int, tuple[np.ndarray, np.ndarray]]):
        """tops: sorted runs and counts by context length, of `order` and of 2 (all that there are)."""
        self.order, self.runs = order, {}
        for j in range(order, -1, -1):
            longer = tops.get(j) or tuple(self.runs[j + 1])
            self.runs[j] = longer if j in tops else _summed(longer[0] & np.uint64((1 << 8 * (j + 1)) - 1), longer[1])
        self.contexts, self.total, self.kinds, self.beneath = {}, {}, {}, {}
        for j, (keys, n) in self.runs.items():
            self.contexts[j], kinds = _distinct(keys >> np.uint64(8), True)
            first = np.cumsum(kinds) - kinds
            self.total[j], self.kinds[j] = (np.add.reduceat(n, first) if len(n) else n), kinds
            if j:  # how often the bytes of each context stand in the one that is a byte shorter
                at, there = _places(self.runs[j - 1][0], keys & np.uint64((1 << 8 * j) - 1))
                assert there.all()
                shorter = self.runs[j - 1][1][at] if len(keys) else n
                self.beneath[j] = np.add.reduceat(shorter, first) if len(n) else n

    def log10(self, runs: np.ndarray) -> np.ndarray:
        """The log probability of the last byte of each run after the others."""
        out = np.zeros(len(runs))
        left = np.arange(len(runs))
        excluded = np.zeros(len(runs), np.int64)  # occurrences and kinds of bytes that longer contexts hold
        excluded_kinds = np.zeros(len(runs), np.int64)
        for j in range(self.order, -1, -1):
            run = runs[left] & np.uint64((1 << 8 * (j + 1)) - 1)
            context, known = _places(self.contexts[j], run >> np.uint64(8))
            at, seen = _places(self.runs[j][0], run)
            total = np.where(known, self.total[j][context] if len(self.total[j]) else 0, 0) - excluded[left]
            kinds = np.where(known, self.kinds[j][context] if len(self.kinds[j]) else 0, 0)
            new = kinds - excluded_kinds[left]
            open_ = known & (new > 0)
            share = np.where(kinds == 256, total, total + new).astype(float)
            share[~open_] = 1
            over = np.where(seen, self.runs[j][1][at] if len(self.runs[j][1]) else 0, new).astype(float)
            over[~open_] = 1
            out[left] += np.log10(over / share)
            if j:
                excluded[left] = np.where(known, self.beneath[j][context] if len(self.beneath[j]) else 0, 0)
            excluded_kinds[left] = kinds
            left = left[~seen]
        if len(left):
            out[left] -= np.log10(256 - excluded_kinds[left])
        return out


def model(runs: DataFrame, order: int = ORDER) -> DataFrame:
    """(run, n, log10): each run with its count and the log probability of its last byte."""
    if not 3 <= order <= 6:
        raise ValueError("contexts of 3 to 6 bytes")
    spark = runs.sparkSession
    low = runs.where("n > 0").groupBy((F.col("run").bitwiseAND((1 << 8 * _LOW) - 1)).alias("run")).agg(F.sum("n").alias("n")).toArrow()
    by = np.argsort(low.column("run").to_numpy())
    sent = spark.sparkContext.broadcast((low.column("run").to_numpy()[by].astype(np.uint64), low.column("n").to_numpy()[by]))
    branch = F.shiftright("run", 8).bitwiseAND((1 << 24) - 1)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            trained = n > 0
            trie = _Trie(order, {order: _summed(keys[trained], n[trained]), _LOW - 1: sent.value})
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n), pa.array(trie.log10(keys))], ["run", "n", "log10"])

        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 18:
                continue
            keys = np.concatenate([keys, *(b.column("run").to_numpy().astype(np.uint64) for b in held)])
            n = np.concatenate([n, *(b.column("n").to_numpy() for b in held)])
            held = []
            branches = keys >> np.uint64(8) & np.uint64((1 << 24) - 1)
            cut = int(np.searchsorted(branches, branches[-1]))  # the last may go on
            if cut:
                yield done(keys[:cut], n[:cut])
                keys, n = keys[cut:], n[cut:]
        keys = np.concatenate([keys, *(b.column("run").to_numpy().astype(np.uint64) for b in held)])
        if len(keys):
            yield done(keys, np.concatenate([n, *(b.column("n").to_numpy() for b in held)]))

    dealt = runs.select("run", "n").withColumn("branch", branch).repartition("branch").sortWithinPartitions("branch", "run")
    return dealt.select("run", "n").mapInArrow(lean(predict), "run long, n long, log10 double")


class _Table:
    """Places of distinct 64-bit keys, open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.place = np.full(1 << bits, ~np.uint64(0), np.uint64), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == ~np.uint64(0)
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.place[slot[won]] = keys[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], slot[rest] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self._slot(keys)
        got = self.keys[slot]
        on = np.flatnonzero(got != keys)
        while len(on):
            empty = self.keys[slot[on]] == ~np.uint64(0)
            slot[on[empty]] = -1
            on = on[~empty]
            slot[on] = slot[on] + 1 & self.mask
            on = on[self.keys[slot[on]] != keys[on]]
        return slot


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of a large_string array."""
    _, off, data = words.buffers()
    off = np.frombuffer(off, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return span_hashes(np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off[:-1], off[1:])


_CORES: dict[str, tuple] = {}


def _core(name: str, runs: np.ndarray, log10: np.ndarray, words: pa.Array, n: np.ndarray) -> tuple:
    """Tables of the core, made once in a process."""
    if name not in _CORES:
        _CORES.clear()
        by_run, (hashes, first) = _Table(runs), np.unique(_hashes(words), return_index=True)
        by_word = _Table(hashes)
        by_slot, place = np.append(log10, 0.0)[by_run.place], first.astype(np.int32)[by_word.place] if len(first) else by_word.place
        by_run.place = by_word.place = None
        _CORES[name] = by_run, by_slot, by_word, place, words, n
    return _CORES[name]


def _frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, `most` at most, ties all or none."""
    grade = F.floor(F.log2(F.col("n") + 1) * 8).cast("int")
    held, least = 0, 1 << 30
    for r in sorted(rows.groupBy(grade.alias("grade")).count().collect(), reverse=True):  # at most 8 * 64 rows
        held += r["count"]
        if held > most:
            break
        least = r["grade"]
    return rows.where(grade >= least)


def score_texts(docs: DataFrame, train: Column, order: int = ORDER, core: int = CORE) -> DataFrame:
    """docs without `text`, with score (log10 probability of the text by the trie), n_tokens, n_known,
    train_tokens and base_score (by single words), learned from the rows where `train` holds."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != "text" and c.lower() not in RESULTS]
    with freed_shuffles(spark), Scratch(spark, "ppm") as scratch:
        counted = scratch.keep(counts(docs, train, order), "counts")
        words = counted.where("word is not null").select("word", "n")
        texts = docs.where(F.coalesce(train, F.lit(False))).count()
        seen, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
        tokens, kinds = seen + texts, kinds + (texts > 0)
        whole = tokens + 0.1 * (kinds + 1)
        runs = scratch.keep(model(counted.where("run is not null").select("run", "n"), order), "model")
        top_runs = _frequent(runs, core).select("run", "log10").toArrow().combine_chunks()
        top_words = _frequent(words.where(F.octet_length("word") <= LETTERS), core).toArrow().combine_chunks()
        column = lambda t, c: pa.concat_arrays(t.column(c).chunks) if t.column(c).chunks else pa.array([], t.schema.field(c).type)
        sent = spark.sparkContext.broadcast((
            uuid.uuid4().hex, column(top_runs, "run").to_numpy().astype(np.uint64), column(top_runs, "log10").to_numpy(),
            column(top_words, "word").cast(pa.large_string()), column(top_words, "n").to_numpy(),
        ))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_run, log10, by_word, place, core_words, core_n = _core(*sent.value)
            for batch in small_batches(batches, limit=STRETCH):
                total, rare_of, rare_values = np.zeros(batch.num_rows), [], []
                for runs, size in _runs(batch, order):
                    slot = by_run.find(runs)
                    value = log10[slot]
                    value[slot < 0] = 0
                    ends = np.cumsum(size)
                    total += np.add.reduceat(value, ends - size)
                    rare_of.append(np.searchsorted(ends, np.flatnonzero(slot < 0), "right"))
                    rare_values.append(runs[slot < 0].astype(np.int64))
                rare_runs = _listed(np.concatenate(rare_of), np.concatenate(rare_values), batch.num_rows)
                words = _Words(batch)
                slot = by_word.find(_hashes(words.words))
                there = slot >= 0
                at = place[slot]
                if there.any():
                    there[there] = pc.equal(core_words.take(pa.array(at[there])), words.words.filter(pa.array(there))).to_numpy(zero_copy_only=False)
                n = np.where(there, core_n[at] if len(core_n) else 0, 0)
                base = np.where(there, np.log10((n + 0.1) / whole), 0.0)
                text = np.repeat(np.arange(batch.num_rows), words.counts)
                base_sum = np.bincount(text, base[words.word], batch.num_rows).astype(float)
                known = np.bincount(text, (n > 0)[words.word], batch.num_rows).astype(np.int64)
                rare = ~there[words.word]
                rare_words = _listed(text[rare], words.word[rare].astype(np.int64), batch.num_rows)
                names = words.words.take(rare_words[1]).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(words.counts + 1), pa.array(known), pa.array(base_sum), pa.array(total),
                     pa.ListArray.from_arrays(rare_runs[0], rare_runs[1]), pa.ListArray.from_arrays(rare_runs[0], rare_runs[2]),
                     pa.ListArray.from_arrays(rare_words[0], names), pa.ListArray.from_arrays(rare_words[0], rare_words[2])],
                    ["row", "n_tokens", "n_known", "base", "score", "runs", "runs_n", "words", "words_n"],
                )

        rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept)).alias("row"), "text")
        more = "n_tokens long, n_known long, base double, score double, runs array<long>, runs_n array<long>, words array<string>, words_n array<long>"
        schema = widened(rows, more, without=("text",))
        part = scratch.keep(rows.mapInArrow(lean(score), schema).withColumn("id", F.monotonically_increasing_id()), "scored")
        rare = part.select("id", F.explode(F.arrays_zip(F.col("runs").alias("run"), F.col("runs_n").alias("k"))).alias("x")).select("id", "x.run", "x.k")
        rare = rare.join(runs.hint("merge"), "run").groupBy("id").agg(F.sum(F.col("k") * F.col("log10")).alias("more"))
        other = part.select("id", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("words_n").alias("k"))).alias("x")).select("id", "x.word", "x.k")
        chance = F.log10((F.col("n") + 0.1) / F.lit(whole))
        other = other.join(words.hint("merge"), "word").groupBy("id").agg(F.sum(F.col("k") * chance).alias("base_more"), F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("known_more"))
        out = part.drop("runs", "runs_n", "words", "words_n").join(rare, "id", "left").join(other, "id", "left")
        zero, end = F.lit(0.0), float(np.log10((texts + 0.1) / whole))
        return scratch.give(out.select(
            *(F.col(f"row.`{c}`") for c in kept), "n_tokens", (F.col("n_known") + F.coalesce("known_more", F.lit(0)) + int(texts > 0)).cast("long").alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_more", zero) + end).alias("base_score"),
            (F.col("score") + F.coalesce("more", zero)).alias("score"),
        ))


def _listed(text: np.ndarray, value: np.ndarray, n_texts: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Lists of the distinct values of each text and their counts: offsets, values, counts."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])]) if len(text) else np.zeros(0, np.int64)
    offsets = np.searchsorted(text[new], np.arange(n_texts + 1))
    return pa.array(offsets, pa.int32()), pa.array(value[new]), pa.array(np.diff(np.r_[new, len(text)]))


def op12_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    out = score_texts(docs.withColumn("held_out", held_out), ~F.col("held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
