"""What Python workers take while they work, and keep when a task has ended."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from brisk.llm import common


@pytest.fixture
def no_powers(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])


def test_hashing_a_batch_takes_little_more_than_its_spans(no_powers):
    data = np.full(4 << 20, 97, np.uint8)
    start = np.arange(0, len(data), 8)
    tracemalloc.start()
    got = common.span_hashes(data, start, start + 7)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(start) and len(set(got.tolist())) == 1
    assert most < 64 << 20 and sum(p.nbytes for p in common._POWERS) <= 16 << 20


def test_a_worker_gives_memory_back_at_the_end_of_a_task(monkeypatch):
    given = []
    monkeypatch.setattr(common, "_trim", lambda: given.append)
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    assert list(common.lean(lambda batches: (b for b in batches))(iter([batch, batch]))) == [batch, batch] and given == [0]
