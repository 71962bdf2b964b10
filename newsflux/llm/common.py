"""Session preparation, scratch tables and numpy text kernels of the operators.

The kernels work on the UTF-8 bytes of whole Arrow batches. Separators of
lines and words are ASCII, so spans can be cut on bytes without decoding; a
span is identified by a 64-bit polynomial hash (random byte codes, odd base,
final mixing), and texts are walked in blocks so that memory stays bounded
whatever a batch holds.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsflux.session import apply_runtime_conf, scratch_path

#: Rows and bytes of an Arrow batch: a batch of the longest texts must fit a small Python worker.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20
#: Text bytes that one kernel call works on (single longer texts are taken alone).
BLOCK_BYTES = 1 << 19

# ASCII white space of the word rule [^\x20\x09-\x0D]+
SPACES = (9, 10, 11, 12, 13, 32)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package, set the checkpoint folder and bound Arrow batches."""
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    with contextlib.suppress(Exception):  # a limit by bytes exists from Spark 4 on; rows alone bound it before
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: the
    lineage ends there, and a lost executor costs a re-read, not a recompute."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- text kernels ------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(_CHUNK + 1, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are ascending and disjoint."""
    pw, inv = _powers()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + _CHUNK, side="right"))
        if j <= i:  # one span longer than a chunk: fold its chunks
            h = np.uint64(0)
            for a in range(lo, ends[i], _CHUNK):
                b = min(a + _CHUNK, ends[i])
                part = np.sum(_CODES[data[a:b]] * pw[:b - a], dtype=np.uint64)
                h = mix(np.asarray([h ^ part], np.uint64))[0]
            out[i] = h
            i += 1
            continue
        piece = data[lo:ends[j - 1]]
        run = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_CODES[piece] * pw[:len(piece)], dtype=np.uint64, out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((run[e] - run[s]) * inv[s])
        i = j
    return out


def text_blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, bytes, offsets) for runs of whole texts
    of about BLOCK_BYTES; nulls are empty. ``lower`` lower-cases A-Z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, off_buf, data_buf = texts.buffers()
    offsets = np.frombuffer(off_buf, np.int64, n + 1 + texts.offset)[texts.offset:]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
        j = min(j, n)
        part = data[offsets[i]:offsets[j]]
        yield i, (_LOWER[part] if lower else part), offsets[i:j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each text the index of
    its first word (length: texts + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[data]
    first = ~space
    last = first.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first[1:] &= space[:-1] | edge[1:-1]
    last[:-1] &= space[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of a block (an empty text has one
    empty line), and for each text the index of its first line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a break that ends a text's bytes starts an empty last line of that text; it
    # sorts beside the next text's start, and both are empty or begin there
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(counts)])


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (windows may cross texts; the
    caller masks those)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD1342543DE82EF95) + words[k:k + m]
        h ^= h >> np.uint64(29)
    return mix(h)


def windows_per_text(first: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts that stay inside one text, and the text of each."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(max(total - n + 1, 0))
    ok = text[:len(at)] == text[n - 1:n - 1 + len(at)] if len(at) else np.zeros(0, bool)
    return at[ok], text[:len(at)][ok]
