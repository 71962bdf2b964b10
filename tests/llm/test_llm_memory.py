"""Memory of the tasks that count shingles."""

import tracemalloc

import numpy as np
import pyarrow as pa

from newsflux.llm import common as C
from newsflux.llm import op5_ngram_join as J


def _words(batches: int):
    rng = np.random.default_rng(3)
    for _ in range(batches):
        text = " ".join(map(str, rng.integers(0, 10**5, 1 << 17)))
        yield pa.RecordBatch.from_pydict({"text": pa.array([text[:len(text) // 2], text[len(text) // 2:], None])})


def test_counting_holds_counts_and_one_block():
    """Over 4 million shingles in a task; before, they were gathered and counted with several copies."""
    C._powers()
    tracemalloc.start()
    try:
        for _ in J._count_buckets(5)(_words(36)):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < (8 << J.RANK_BITS) + (40 << 20)


def test_counts_are_those_of_all_shingles():
    expected = np.zeros(1 << J.RANK_BITS, np.int64)
    for batch in _words(3):
        for _, data, offsets in C.text_blocks(batch.column(0), lower=True):
            hashes = J._shingles(data, offsets, 5)[0]
            expected += np.bincount((hashes >> np.uint64(64 - J.RANK_BITS)).astype(np.int64), minlength=len(expected))
    got = np.zeros_like(expected).reshape(-1, J._BLOCK)
    for batch in J._count_buckets(5)(_words(3)):
        for block, plane, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[block] += np.frombuffer(raw, np.uint8).astype(np.int64) << (8 * plane)
    assert (got.ravel() == expected).all()
