"""Token ids in a binary file format: static range asymmetric numeral coding (rANS).

Files of one corpus: `model` holds the shared frequency table, `blocks` one row for each block. A
block is whole documents in ascending doc_id order, about BLOCK ids. Its ids are dealt over lanes,
each a 64-bit coder state of its own; the lanes' 32-bit words lie interleaved in one payload. Every
STRIDE steps the states and the payload position are stored as a checkpoint, so a reader may begin at
any of them, and blocks need nothing but the table. A CRC-32 of the ids checks each block.

Two passes over the data: texts are range-partitioned by doc_id, encoded once per distinct pre-token
and packed into raw blocks; their ids are counted (the table is the size of the vocabulary, whatever
the corpus); then each block is coded where it lies. Only the number of ids of each partition meets
at the driver, to place partitions one after another.

Ids are those of the library, which takes the strings of added tokens as these tokens wherever they
stand in a text.

Defined cases: null and empty texts have the end id alone; documents with the same id follow each
other by hash of the text; null ids come first; an empty table makes no blocks; a very long text is
encoded in pieces and makes one long block; further columns are not stored, whatever they are called.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, env_quiet, freed_shuffles, shared_path, small_batches, table
from .pretoken import Encoder

#: Ids in a block (a block ends with the document that reaches it), lanes, steps between checkpoints.
BLOCK, LANES, STRIDE = 1 << 18, 1024, 128
#: Frequencies sum to 1 << BITS; states stay in [1 << 31, 1 << 63).
BITS = 20
LOW = np.uint64(1 << 31)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 1 << BITS, at least 1 for each id that occurs."""
    total = 1 << BITS
    some = counts > 0
    freq = np.zeros(len(counts), np.int64)
    if not some.any():
        return freq
    share = counts.astype(np.float64) * ((total - some.sum()) / counts.sum())
    freq[some] = 1 + np.floor(share[some]).astype(np.int64)
    freq[np.argmax(counts)] += total - freq.sum()
    return freq


class Coder:
    """rANS over a fixed frequency table; all lanes of a block step together."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, pad: int) -> tuple[int, bytes, bytes]:
        """Lanes, payload and checkpoints (position and states at every STRIDE-th step)."""
        lanes = int(min(LANES, max(1, len(ids) // 64)))
        steps = -(-len(ids) // lanes)
        grid = np.full(steps * lanes, pad, np.int64)
        grid[: len(ids)] = ids
        grid = grid.reshape(steps, lanes)
        freq, low = self.freq[grid], self.low[grid]
        most = freq << np.uint64(63 - BITS)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = [None] * steps
        marks = {}
        for t in range(steps - 1, -1, -1):
            over = state >= most[t]
            words[t] = state[over].astype(np.uint32)
            state[over] >>= np.uint64(32)
            q = state // freq[t]
            state = (q << np.uint64(BITS)) + (state - q * freq[t]) + low[t]
            if t % STRIDE == 0:
                marks[t] = state.copy()
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        points = b"".join(np.uint64(at[t]).tobytes() + marks[t].tobytes() for t in sorted(marks))
        return lanes, np.concatenate(words).astype("<u4").tobytes() if words else b"", points

    def decode(self, n: int, lanes: int, payload: bytes, points: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids of the checkpoints [begin, end) of a block of n ids, all by default."""
        steps = -(-n // lanes)
        states = np.frombuffer(points, np.uint64).reshape(-1, lanes + 1)
        stop = steps if end is None else min(steps, end * STRIDE)
        words = np.frombuffer(payload, "<u4")
        at, state = int(states[begin, 0]), states[begin, 1:].copy()
        out = np.empty((stop - begin * STRIDE, lanes), np.uint32)
        mask = np.uint64((1 << BITS) - 1)
        for t in range(len(out)):
            slot = state & mask
            sym = self.symbol[slot]
            out[t] = sym
            state = self.freq[sym] * (state >> np.uint64(BITS)) + slot - self.low[sym]
            need = np.flatnonzero(state < LOW)
            state[need] = (state[need] << np.uint64(32)) | words[at : at + len(need)]
            at += len(need)
        return out.ravel()[: n - begin * STRIDE * lanes]


@functools.lru_cache(1)
def _encoder(spec: str) -> Encoder:
    env_quiet()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    whole = lambda text: tok.encode(text, add_special_tokens=False).ids

    def words(pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    return Encoder(words, whole, tuple(t.content.encode() for t in tok.get_added_tokens_decoder().values()))


@functools.lru_cache(1)
def _coder(freq: bytes) -> Coder:
    return Coder(np.frombuffer(freq, np.int64))


_RAW = "part int, block int, before long, n long, doc_ids array<bigint>, counts array<bigint>, ids binary"
_BLOCK = "part int, block int, start long, n long, lanes int, doc_ids array<bigint>, counts array<bigint>, points binary, payload binary, crc long"


def _raw_blocks(docs: DataFrame, spec: str, end_id: int, block: int) -> DataFrame:
    """Documents in order, encoded and packed: a row a block, numbered within its partition."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(sent.value), TaskContext.get().partitionId()
        doc_ids: list = []
        counts: list = []
        parts: list = []
        done = held = number = 0

        def pack() -> pa.RecordBatch:
            raw = np.concatenate(parts).astype("<u4").tobytes()
            row = [part, number, done, held, list(doc_ids), list(counts), raw]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _types, strict=True)], _names)

        for batch in small_batches(batches, limit=2 << 20):
            ids, sizes = encode(batch)
            ids = np.insert(ids, np.cumsum(sizes), end_id)  # after each document
            sizes = sizes + 1
            at = 0
            for doc, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                doc_ids.append(doc)
                counts.append(size)
                parts.append(ids[at : at + size])
                at += size
                held += size
                if held >= block:
                    yield pack()
                    done, held, number = done + held, 0, number + 1
                    doc_ids.clear(), counts.clear(), parts.clear()
        if held:
            yield pack()

    _names = [f.split()[0] for f in _RAW.split(", ")]
    _types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    ordered = docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text")).mapInArrow(run, _RAW)


def _count_ids(raw: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs: summed in each task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=vocab)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocab, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_tokens(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 2, block: int = BLOCK) -> None:
    """Write docs (doc_id, text) as coded token ids under `path`."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocab = Tokenizer.from_str(tokenizer_json).get_vocab_size()
    with freed_shuffles(spark), Scratch(spark, "tokens") as scratch:
        raw = scratch.keep(_raw_blocks(docs, tokenizer_json, end_id, block), "ids")
        freq = quantise(_count_ids(raw, vocab))
        spark.createDataFrame([(BITS, end_id, freq.tobytes())], "bits int, end_id int, freq binary").coalesce(1).write.parquet(f"{path}/model")
        sizes = raw.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toPandas()
        first = dict(zip(sizes["part"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist(), strict=True))
        sent = spark.sparkContext.broadcast((freq.tobytes(), first))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, starts = _coder(sent.value[0]), sent.value[1]
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    part, ids = row.column("part")[0].as_py(), np.frombuffer(row.column("ids")[0].as_buffer(), "<u4")
                    lanes, payload, points = coder.encode(ids, end_id)
                    start = starts[part] + row.column("before")[0].as_py()
                    new = [pa.array([start], pa.int64()), row.column("n"), pa.array([lanes], pa.int32()), row.column("doc_ids"), row.column("counts"), pa.array([points], pa.binary()), pa.array([payload], pa.binary()), pa.array([zlib.crc32(ids.tobytes())], pa.int64())]
                    yield pa.RecordBatch.from_arrays([row.column("part"), row.column("block"), *new], [f.split()[0] for f in _BLOCK.split(", ")])

        raw.mapInArrow(run, _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents read back: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary). A
    block whose checksum differs stops the job."""
    sent = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/model").first()["freq"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, lanes, start, crc = (row.column(c)[0].as_py() for c in ("n", "lanes", "start", "crc"))
                ids = coder.decode(n, lanes, row.column("payload")[0].as_buffer(), row.column("points")[0].as_buffer()).astype("<u4")
                if zlib.crc32(ids) != crc:
                    raise ValueError(f"block {row.column('part')[0]}/{row.column('block')[0]} is damaged")
                counts = row.column("counts").flatten().to_numpy()
                ends = np.cumsum(counts)
                own = [ids[e - c : e] for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                out = [row.column("doc_ids").flatten(), pa.array(start + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, pa.array([x.tobytes() for x in own], pa.binary())] if with_ids else out, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), spec, path)
    return read_tokens(spark, path)
