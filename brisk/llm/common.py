"""Helpers that the training-data operators share: shared scratch tables, small column idioms,
and a byte-level scanner that reads whole Arrow text columns at once."""

from __future__ import annotations

import ctypes
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words, as a Java and RE2 pattern.
BLANKS = r"[\x20\x09-\x0D]+"
_M64 = 0xFFFFFFFFFFFFFFFF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). A session in
    one process may go without it, as tests do; any other must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-brisk-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/brisk/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder, whatever store that is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator in the shared folder. A table goes when another takes its name (which
    may be made from it) and when the block ends, but for what `give` returns. `tasks`, if set, is the most
    that a table is written by: tables of few rows need not have a file for each shuffle partition."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths, self.tasks = spark, name, {}, None

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths.values():
            remove(self.spark, path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written to the shared folder and read back: lineage ends there, and a lost executor costs
        a read, not a recomputation."""
        path = shared_path(self.spark, f"{self.name}-{name}")
        (df.coalesce(self.tasks) if self.tasks else df).write.option("compression", "zstd").parquet(path)
        if name in self.paths:
            remove(self.spark, self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            remove(self.spark, self.paths.pop(name))

    def give(self, df: DataFrame) -> DataFrame:
        """df as a table that outlives the block."""
        out = self.keep(df, "result")
        del self.paths["result"]
        return out


class freed_shuffles:
    """Within this block Spark drops a query's shuffle files when the query has ended, so that a job
    of several written steps holds those of one step at a time, and sends texts to Python workers in
    Arrow batches of a few MB."""

    SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.SETTINGS}
        for k, v in self.SETTINGS.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def spare(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores ahead as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def around(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs only: those that are named like a result of it step aside
    meanwhile, and its results go."""
    away = {c: spare(docs, f"_{c}") for c in docs.columns if c.lower() in names}
    out = work(docs.withColumnsRenamed(away)).drop(*names)
    return out.withColumnsRenamed({v: k for k, v in away.items()}).select(*(F.col(f"`{c}`") for c in docs.columns))


def widened(df: DataFrame, more: str, without: tuple[str, ...] = ()) -> StructType:
    """The schema of df less some columns, with the columns of a DDL text after it."""
    return StructType([f for f in df.schema.fields if f.name not in without] + StructType.fromDDL(more).fields)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def attach(docs: DataFrame, found: DataFrame, new: list[str], once: bool = False, all_rows: bool = False) -> DataFrame:
    """The rows of docs that found (doc_id, th, ...) has, by id and hash of the text, with the columns
    `new` of found in place of their own of these names; with all_rows, the others with nulls; with
    once, equal rows give one. Rows travel as one struct, so that no name can clash."""
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_h"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(new)))
    same = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th"))
    out = rows.join(found.hint("merge"), same, "left" if all_rows else "inner" if new else "left_semi")
    out = out.dropDuplicates(["_d", "_h"]) if once else out
    return out.select("row.*", *(F.col(f"_{i}").alias(c) for i, c in enumerate(new)))


def words_of(text: Column) -> Column:
    """Words between blanks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def text_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets, without making Python strings. Null
    counts as empty."""
    col = batch.column(name)
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C55  # odd, so that its powers have inverses modulo 2**64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base & _M64, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


#: Bytes that are hashed at once; powers and sums take 48 bytes for each of them.
_STRETCH = 1 << 19


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which ascend and do not overlap. Spans of 256
    bytes or more are hashed one by one, by another function (a polynomial is weak on long strings).
    Long texts are taken in stretches, so that memory follows the number of spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if len(data) > _STRETCH:
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            low = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, low + _STRETCH, "right")))
            out[i:j] = _hash_spans(data[low : end[j - 1]], start[i:j] - low, end[i:j] - low)
            i = j
        return out
    return _hash_spans(data, start, end)


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if len(start) == 1 and end[0] - start[0] >= 256:
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(data[start[0] : end[0]].tobytes())], np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    out = (sums[end] - sums[start]) * down[start]
    size = end - start
    out = mix(out + size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    if len(long := np.flatnonzero(size >= 256)):
        import xxhash

        for i in long:
            out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a batch of texts: byte spans, text numbers and 64-bit hashes.

    `first[i] : first[i + 1]` are the words of text i.
    """

    def __init__(self, batch: pa.RecordBatch, column: str = "text", lower: bool = False):
        data, off = text_of(batch, column)
        self.data = data
        seen = _LOWER[data] if lower else data
        word = ~_IS_BLANK[data]
        # a text's first byte always begins anew
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | edge[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = span_hashes(seen, self.start, self.end)
        self.n_texts = len(off) - 1
        self.counts = np.diff(self.first)

    def text_ids(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)


_STEPS = [0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB]


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words in an array of word hashes, across texts too."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_STEPS[j % 5]) + word[j : j + n] + np.uint64(j))
    return out


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` text bytes (one text at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.diff(text_of(b, column)[1])
        if size.sum() <= limit:
            yield b
            continue
        at, held = 0, 0
        for i, s in enumerate(size.tolist()):
            if held and held + s > limit:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += s
        yield b.slice(at)


@functools.lru_cache(1)
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim, or nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` over the batches of a task, after which the worker, which Spark keeps for other tasks, gives
    freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return run


def env_quiet() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
