import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brisk.llm import ppm

from brute import LOWER, WORDS, prose
from brute import ppm as slow


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [prose(rng, rng.randint(0, 40)) + rng.choice(["", ".", " Ünï\n", " 😀"]) for _ in range(40)]
    out += ["", "so so so so", "\x00", " a  b ", "Kata KATA kata", out[3], out[3], "".join(map(chr, range(1, 500)))]
    return [(i, t, i % 4 != 1) for i, t in enumerate(out)] + [(None, "kata", True), (90, None, True), (91, "nd" * 50, False), (92, None, False)]


def expected(rows, order):
    train = [t or "" for _, t, learn in rows if learn]
    words = [WORDS.findall(t.translate(LOWER)) for t in train]
    c = Counter(w for x in words for w in x)
    n = sum(c.values()) + len(train)
    whole = n + 0.1 * (len(c) + 2)
    scores = slow([t or "" for _, t, _ in rows], train, order)
    out = []
    for (i, t, _), s in zip(rows, scores, strict=True):
        w = WORDS.findall((t or "").translate(LOWER))
        base = sum(math.log10((k + 0.1) / whole) for k in [*(c[x] for x in w), len(train)])
        out.append((i if i is not None else -1, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, base, s))
    return sorted(out)


@pytest.mark.parametrize("order,core", [(3, 1 << 20), (5, 1 << 20), (5, 40), (5, 0)])
def test_scores_equal_a_plain_model(spark, texts, order, core, monkeypatch):
    monkeypatch.setattr(ppm, "HELD", 500)
    docs = spark.createDataFrame(texts, "doc_id long, text string, learn boolean").repartition(3)
    got = ppm.score_texts(docs, F.col("learn"), order, core)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.collect())
    want = expected(texts, order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_the_next_byte_is_certain(spark):
    """The probabilities of all bytes after a context sum to one, whatever was seen."""
    import numpy as np

    rng = np.random.default_rng(2)
    for few in (2, 5, 256):
        runs = rng.integers(0, few, (4000, 4)).astype(np.uint64)
        keys = runs[:, 0] << np.uint64(24) | runs[:, 1] << np.uint64(16) | runs[:, 2] << np.uint64(8) | runs[:, 3]
        keys, n = np.unique(keys, return_counts=True)
        low = ppm._summed(keys & np.uint64((1 << 24) - 1), n)
        trie = ppm._Trie(3, {3: (keys, n), 2: low})
        for context in [*np.unique(keys >> np.uint64(8))[:20], np.uint64(0xFFFFFF)]:
            assert (10.0 ** trie.log10((context << np.uint64(8)) + np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)


def test_without_training_texts_all_bytes_are_alike(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score_texts(docs, F.lit(False)).collect()}
    assert got[1]["score"] == pytest.approx(-3 * math.log10(256)) and got[2]["score"] == pytest.approx(-math.log10(256))
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["base_score"] == pytest.approx(0)


def test_query(spark):
    got = ppm.op12_ppm_score(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 10 != 0).alias("learn"))
    rows = [tuple(r) for r in docs.collect()]
    c, n = Counter(), 0
    for _, t, learn in rows:
        if learn:
            c.update(WORDS.findall((t or "").translate(LOWER)))
            n += 1
    whole = sum(c.values()) + n + 0.1 * (len(c) + 2)
    want = {i: sum(math.log10((c[w] + 0.1) / whole) for w in WORDS.findall((t or "").translate(LOWER))) + math.log10((n + 0.1) / whole) for i, t, _ in rows}
    assert len(got) == len(rows) and (got["train_tokens"] == sum(c.values()) + n).all()
    assert {i: not learn for i, _, learn in rows} == dict(zip(got["doc_id"], got["held_out"], strict=True))
    for i, b in zip(got["doc_id"], got["base_score"], strict=True):
        assert b == pytest.approx(want[i], rel=1e-9)
    held = got[got["held_out"]]
    assert (got["score"] < 0).all() and held["score"].sum() / held["base_score"].sum() < 1.3


def test_stretches_of_a_long_text_change_nothing(monkeypatch):
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([prose(random.Random(1), 300)])], ["text"])
    (whole, size), = ppm._runs(batch, 5)
    monkeypatch.setattr(ppm, "STRETCH", 7)
    parts = list(ppm._runs(batch, 5))
    assert len(parts) > 100 and np.array_equal(np.concatenate([r for r, _ in parts]), whole) and sum(n[0] for _, n in parts) == size[0]
