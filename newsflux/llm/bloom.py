"""A Bloom filter whose size follows the number of its keys, filled by Spark tasks
and held by every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, shuffle_width

#: Bits per key at least, and the bits of the smallest and the largest filter. The largest
#: has 128 MB and serves 10**8 keys; beyond that more is let through, up to
#: everything, which the exact join behind the filter sorts out.
BITS_PER_KEY = 10
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
_HASHES = 3
_BLOCK = 1 << 20


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = keys.view(np.uint64)
    for k in range(_HASHES):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64))
        yield (h & np.uint64(bits - 1)).astype(np.int64)


def bits_for(keys: int) -> int:
    return min(max(MIN_BITS, 1 << (max(keys, 1) * BITS_PER_KEY - 1).bit_length()), MAX_BITS)


class Bloom:
    def __init__(self, raw: np.ndarray):
        self.raw = raw

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For each int64 key: False only if it was never put in."""
        ok = np.ones(len(keys), bool)
        for at in _places(np.ascontiguousarray(keys), 8 * len(self.raw)):
            ok &= (self.raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Bloom:
        """Of a long column of a stored table (it is read twice). Tasks turn keys into
        places, every block of bits is set by one task, and the driver receives the bits."""
        bits = bits_for(keys.count())
        blocks = bits // _BLOCK

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.concatenate(list(_places(found, bits)))
                yield pa.RecordBatch.from_arrays([pa.array((at // _BLOCK).astype(np.int32)), pa.array((at % _BLOCK).astype(np.int32))],
                                                 names=["block", "at"])

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                block, at = (c.to_numpy() for c in batch.columns)
                for b in np.unique(block).tolist():
                    held.setdefault(b, np.zeros(_BLOCK, bool))[at[block == b]] = True
            for b, x in held.items():
                raw = np.packbits(x, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([raw], pa.binary())], names=["block", "bits"])

        width = min(blocks, shuffle_width(keys.sparkSession))
        parts = (keys.select(column).mapInArrow(place, "block int, at int").repartition(width, "block")
                 .mapInArrow(fill, "block int, bits binary"))
        raw = np.zeros((blocks, _BLOCK // 8), np.uint8)
        for b, x in parts.collect():  # bits / 8 bytes in all
            raw[b] = np.frombuffer(x, np.uint8)
        return cls(raw.ravel())
