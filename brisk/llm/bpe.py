"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised from the rank file alone, not trained: each byte of a token becomes one
character (byte-mapped pieces), a piece's score is its negative rank, and normalisation is the
identity. Merging the best scored pair first, leftmost on ties, is then merging by rank. Piece
number = rank, so ids need no translation. Pre-tokens are encoded one by one (once per distinct
pre-token of a batch); decoding maps ids to their bytes.

A vocabulary may hold tokens that merges by rank do not reach; a pre-token that equals such a token
is that token. They are found when the model is made.

Defined cases: null counts as empty and gives no ids; other columns are untouched, but those named
like a result are replaced; rows are independent; a very long text is encoded in pieces, cut where its
pre-tokens do not change.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, small_batches, table, widened
from .pretoken import Encoder, ragged

COLUMNS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.cache
def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of their rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    return [token for _, token in pairs]


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol buffer field: bytes, float or variable-length integer."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value & 0xFFFFFFFFFFFFFFFF)


def model_of(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: pieces (text, score, type), trainer and normaliser settings."""
    letters = byte_letters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [("".join(letters[b] for b in t), -float(rank), normal) for rank, t in enumerate(tokens)]
    pieces.append(("<unk>", 0.0, unknown))
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encodes and decodes by a model as made by `model_of`."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.pattern = regex.compile(pattern)
        self.tokens = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.size) - self.size
        self.apart: dict[bytes, list[int]] = {}
        self.apart = {t: [i] for i, (t, got) in enumerate(zip(tokens, self.words(tokens), strict=True)) if list(got) != [i]}
        self.encode = Encoder(self.words, lambda text: [i for w in self.words([p.encode() for p in self.pattern.findall(text)]) for i in w])

    def words(self, words: list[bytes]) -> list[list[int]]:
        got = self.sp.encode([w.decode("latin-1").translate(self.letters) for w in words], num_threads=1)
        return [self.apart.get(w, ids) for w, ids in zip(words, got, strict=True)] if self.apart else got

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        steps = [ids[i : i + (1 << 18)] for i in range(0, len(ids), 1 << 18)]
        return np.concatenate([self.tokens[ragged(self.at[s], self.size[s])] for s in steps]) if steps else self.tokens[:0]


@functools.lru_cache(1)
def _codec(model: bytes, joined: bytes, sizes: bytes, pattern: str) -> Codec:
    ends = np.cumsum(np.frombuffer(sizes, np.uint16)).tolist()
    return Codec(model, [joined[a:b] for a, b in zip([0, *ends], ends)], pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, `ids` (32-bit little-endian)
    and `decoded` (string, null where the text is)."""
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else []))  # replaced
    tokens = read_ranks(ranks_path)
    sent = docs.sparkSession.sparkContext.broadcast((model_of(tokens), b"".join(tokens), np.array([len(t) for t in tokens], np.uint16).tobytes(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        for batch in small_batches(batches, limit=2 << 20):
            ids, counts = codec.encode(batch)
            data = codec.decode(ids)
            ends = np.cumsum(counts)
            made = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(codec.size[ids], out=made[1:])
            parts = [ids[e - c : e].astype("<u4").tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            texts = [data[made[e - c] : made[e]].tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            new = [pa.array(counts), pa.array([hashlib.sha256(p).hexdigest() for p in parts]), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            if with_ids:
                null = batch.column("text").is_null().to_pylist()
                new += [pa.array(parts, pa.binary()), pa.array([None if x else t.decode("utf-8", "replace") for x, t in zip(null, texts, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    return docs.mapInArrow(lean(run), widened(docs, COLUMNS + ", ids binary, decoded string" * with_ids))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
