"""Toxicity: FTRL-proximal logistic regression over hashed word features.

A text's features are the buckets of its words, word beginnings, word pairs and
skip-grams (pairs with one word between), each counted once. FTRL-proximal keeps
two sums per bucket: ``n`` of squared gradients, which gives every coordinate
its own learning rate, and ``z``, whose part within ``L1`` makes the weight zero.
So only buckets with evidence keep a weight, and the model sent to the scoring
tasks is a short list of (bucket, weight), at most ``BUCKETS`` long.

Learning runs in ``ROUNDS`` rounds over all labelled rows. In a round every task
takes shards of up to ``SHARD_ROWS`` rows and goes through a shard's rows one by
one, ``PASSES`` times, from the state of the round before; the states of the
shards are then averaged per coordinate over the shards that met it, by their
rows. The states are summed by Spark in blocks of coordinates, so the driver
receives one state of ``BUCKETS`` coordinates a round, whatever the number of rows.

Defined cases: a null text counts as empty, and a text without words gets the
score of the intercept; rows without doc_id are scored and not learned from;
null labels are not learned from; of a doc_id's repeated labels the largest
counts; repeated documents are learned from each time; without any label, or
with labels of one kind only, the scores follow the intercept; empty tables give
empty results; texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bloom import Bloom

BITS = 18
BUCKETS = 1 << BITS
ROUNDS, PASSES = 2, 2
#: Rows whose features a task holds at once, and that one state is learned from.
SHARD_ROWS = 8192
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 1.0
#: Bytes of a word beginning: words formed from one stem share it.
STEM_BYTES = 5
_BLOCKS = 64
_SALTED = 8
_STATE = "block int, z binary, n binary, met binary"

# bytes of words: ASCII letters in lower case, digits and every byte beyond ASCII; 0 elsewhere
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * k % 2**64) for k in range(1, 5)]


def _buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each kind of feature of a block of texts."""
    f = _FOLD[data]
    inside = f > 0
    edge = np.zeros(len(f) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if len(f):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return
    text = np.searchsorted(offsets, starts, side="right") - 1
    words = C.span_hash(f, starts, ends)
    stems = C.span_hash(f, starts, np.minimum(ends, starts + STEM_BYTES))
    half = BUCKETS // 2  # words and their beginnings in one half, pairs in the other: rare pairs don't blur words
    bucket = lambda h, kind: (C.mix(h + _SALTS[kind]) >> np.uint64(65 - BITS)).astype(np.int64) + half * (kind > 1)
    yield text, bucket(words, 0)
    yield text, bucket(stems, 1)
    for gap in (1, 2):
        if len(words) > gap:
            ok = text[gap:] == text[:-gap]
            pair = words[:-gap] * np.uint64(0xD1342543DE82EF95) + C.mix(words[gap:])
            yield text[gap:][ok], bucket(pair[ok], 1 + gap)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    keys = np.sort(np.concatenate(parts))  # faster than np.unique, which hashes
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def _rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index, distinct buckets) of each text."""
    for base, data, offsets in C.text_blocks(texts):
        parts = [t << BITS | b for t, b in _buckets(data, offsets)]
        keys = _distinct(parts) if parts else np.zeros(0, np.int64)
        cuts = np.searchsorted(keys, np.arange(len(offsets)) << BITS)
        for i in range(len(offsets) - 1):
            yield base + i, keys[cuts[i]:cuts[i + 1]] & (BUCKETS - 1)


# --- learning ----------------------------------------------------------------

class State:
    """z and n per bucket; the last coordinate is the intercept."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(BUCKETS + 1) if z is None else z
        self.n = np.zeros(BUCKETS + 1) if n is None else n

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def intercept(self) -> float:
        return -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA)

    def learn(self, buckets: np.ndarray, label: int) -> None:
        w, b = self.weights(buckets), self.intercept()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - label
        for at, old in ((buckets, w), (-1, b)):  # all features are 1: one gradient for all coordinates
            n = self.n[at]
            self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * old
            self.n[at] = n + g * g


@dataclass
class Model:
    """Buckets with a weight (ascending), their weights, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.intercept)
        known = np.zeros(BUCKETS, bool)
        known[self.buckets] = True
        for base, data, offsets in C.text_blocks(texts):
            # only the few features that have a weight are made distinct
            parts = [(t[k] << BITS) | b[k] for t, b in _buckets(data, offsets) if (k := known[b]).any()]
            if parts:
                keys = _distinct(parts)
                np.add.at(total, base + (keys >> BITS), self.weights[np.searchsorted(self.buckets, keys & (BUCKETS - 1))])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _blocks(sums: list[np.ndarray]) -> pa.RecordBatch:
    """Sums of z, n and rows as rows of coordinates; blocks nobody met are left out."""
    cut = [np.array_split(x.astype(np.float32), _BLOCKS) for x in sums]
    used = [i for i in range(_BLOCKS) if cut[2][i].any()]
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), *(pa.array([c[i].tobytes() for i in used], pa.binary()) for c in cut)],
        names=["block", "z", "n", "met"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for b, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = [np.frombuffer(x, np.float32) for x in raw]
            sums[b] = [a + x for a, x in zip(sums[b], new, strict=True)] if b in sums else new
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), *(pa.array([s[k].tobytes() for s in sums.values()], pa.binary()) for k in range(3))],
        names=["block", "z", "n", "met"])


def _one_round(rows: DataFrame, before: State) -> State:
    sent = rows.sparkSession.sparkContext.broadcast((before.z, before.n))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, int]]]:
        held = []
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for i, buckets in _rows(batch.column(0)):
                held.append((buckets.astype(np.int32), int(labels[i])))
                if len(held) == SHARD_ROWS:
                    yield held
                    held = []
        if held:
            yield held

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for shard in shards(batches):
            state, met = State(*(x.copy() for x in sent.value)), np.zeros(BUCKETS + 1)
            for _ in range(PASSES):
                for buckets, label in shard:
                    state.learn(buckets, label)
                    met[buckets] = len(shard)
            met[-1] = len(shard)
            new = [state.z * met, state.n * met, met]
            sums = new if sums is None else [a + x for a, x in zip(sums, new, strict=True)]
        if sums is not None:
            yield _blocks(sums)

    # one state per task, first summed in groups of tasks, then per block
    parts = rows.mapInArrow(learn, _STATE)
    parts = parts.repartition(_BLOCKS, "block", F.spark_partition_id() % 16).mapInArrow(_add, _STATE)
    after = State(before.z.copy(), before.n.copy())
    places = np.array_split(np.arange(BUCKETS + 1), _BLOCKS)
    for block, *raw in parts.repartition(8, "block").mapInArrow(_add, _STATE).collect():  # BUCKETS coordinates in all
        z, n, met = (np.frombuffer(x, np.float32) for x in raw)
        at = places[block][met > 0]
        after.z[at], after.n[at] = z[met > 0] / met[met > 0], n[met > 0] / met[met > 0]
    return after


def train(rows: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """Learn from all rows with a label (1 toxic, else not)."""
    rows = rows.where(F.col(label).isNotNull()).select(text, (F.col(label) == 1).cast("int").alias("label"))
    state = State()
    for _ in range(0 if rows.isEmpty() else ROUNDS):
        state = _one_round(rows, state)
    w = state.weights(slice(0, BUCKETS))
    kept = np.flatnonzero(w)
    return Model(kept, w[kept], float(state.intercept()))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(text, toxic) of the labelled documents that may be learned from, written
    once. Documents that no label names, by a Bloom filter, are not shuffled."""
    spark = docs.sparkSession
    learned = lambda t: t.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    names = C.stage(learned(labels.where("toxic IS NOT NULL")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    wanted = spark.sparkContext.broadcast(Bloom.of(names.select(F.xxhash64("doc_id").alias("m")), "m"))

    @F.arrow_udf("boolean")
    def maybe(m: pa.Array) -> pa.Array:
        return pa.array(wanted.value.has(m.to_numpy(zero_copy_only=False)))

    # texts move once, to their label and into shards; a doc_id of many rows is spread by a salt
    shards = max(1, -(-names.count() // SHARD_ROWS))
    near = (learned(docs.select("doc_id", text)).where(maybe(F.xxhash64("doc_id")))
            .withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTED)).cast("int")))
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTED - 1))))
    keys = ["doc_id", "salt"]
    joined = near.repartition(shards, *keys).join(names.repartition(shards, *keys).hint("merge"), keys)
    return C.stage(joined.select(text, "toxic"), "toxicity-rows")


# --- scores ------------------------------------------------------------------

def scored(docs: DataFrame, model: Model) -> Column:
    """Column function: text -> score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(texts))

    return run


def assess(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Learned from labelled rows
    whose crc32(doc_id as text) mod 5 is not 0; the others are only scored."""
    model = train(training_rows(docs, labels, text), text)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return (docs.select("doc_id", held.alias("held_out"), scored(docs, model)(F.col(text)).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
