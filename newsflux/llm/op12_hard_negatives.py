"""Hard negatives by rotated one-bit codes with deterministic intervals.

Every vector is rotated by a fixed orthogonal matrix and coded by the signs of
its components; stored beside the signs is the alignment, the inner product of
the vector with its unit code. What the code leaves (the residual) is coded
again, ``CODES`` times, so a vector is the sum of its codes times their
alignments and a residual of known length. An anchor is cut into ``PLANES`` bit
planes, and its inner product with a code comes from popcounts of code and
plane. By Cauchy-Schwarz the score differs from this estimate by no more than
residual length x anchor length, plus what the planes round off: an interval
that holds the score for certain. Code by code the intervals narrow; a row
leaves as soon as its interval shows that it cannot be among the rows asked for,
and the rows that are left are scored in integers. So results are exact.

Search runs in two passes over the same stored codes: nearest rows of the
anchor's label first, then, within the score ranges that these positives set,
the best rows of other labels. Anchors in chunks of ``CHUNK_ROWS`` meet rows in
blocks of ``BLOCK_ROWS``; a task holds one block and one chunk, whatever the
size of the tables, and returns a few rows per anchor.

Defined cases: rows with a null label, id or vector, with a null, infinite or
NaN component take no part, nor do rows with a component whose integer has a
magnitude of 2**27 or more (their scores would not fit a long); of rows that
share an id the smallest (label, components) counts, so repeated rows count
once; vectors of different lengths never meet; empty vectors score 0; an anchor
alone in its label has no positives and returns nothing; ties go to the smaller
id; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CODES = 8
PLANES = 8
#: Codes after which the intervals are first asked: before, they are too wide to settle much.
ASKED_FROM = 3
BLOCK_ROWS = 1 << 13
CHUNK_ROWS = 1 << 14
#: Integers of a larger magnitude cannot be scored as longs.
LIMIT = 1 << 27
#: Rows left at which integer scores cost less than another code.
_FEW = 64
_SLACK = 1e-9


# --- codes -------------------------------------------------------------------

@lru_cache(8)
def rotation(size: int) -> np.ndarray:
    """A fixed orthogonal matrix; its signs do not depend on the linear algebra library."""
    q, r = np.linalg.qr(np.random.default_rng(20240611).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """(rows, components) of booleans to (rows, words) of 64 bits."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, CODES, words), alignments (rows, CODES) and the lengths
    (rows, CODES) of what is left after each code."""
    n, size = vectors.shape
    left = vectors.astype(float) @ rotation(size)
    unit = 1 / np.sqrt(max(size, 1))
    codes, aligned, lengths = [], [], []
    for _ in range(CODES):
        signs = left > 0
        a = np.abs(left).sum(axis=1) * unit
        left = left - np.where(signs, 1.0, -1.0) * (a * unit)[:, None]
        codes.append(_pack(signs))
        aligned.append(a)
        lengths.append(np.linalg.norm(left, axis=1))
    return np.stack(codes, 1), np.stack(aligned, 1), np.stack(lengths, 1)


class Planes:
    """An anchor's rotated components as unsigned integers of PLANES bits, bit by bit."""

    def __init__(self, vector: np.ndarray):
        p = vector.astype(float) @ rotation(len(vector))
        self.size, self.length = len(p), float(np.linalg.norm(p))
        self.low = float(p.min(initial=0))
        self.step = float(p.max(initial=0) - self.low) / ((1 << PLANES) - 1) or 1.0
        levels = np.rint((p - self.low) / self.step).astype(np.int64)
        self.total = int(levels.sum())
        self.planes = [_pack((levels >> b & 1 == 1)[None])[0] for b in range(PLANES)]
        self.rounded = float(np.linalg.norm(self.low + self.step * levels - p))

    def with_codes(self, codes: np.ndarray) -> np.ndarray:
        """Inner products of the rounded anchor with unit codes (rows, words)."""
        ones, inside = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.int32)
        for w in range(codes.shape[1]):
            word = np.ascontiguousarray(codes[:, w])
            ones += np.bitwise_count(word)
            for b, plane in enumerate(self.planes):
                inside += np.left_shift(np.bitwise_count(word & plane[w]), b, dtype=np.int32)
        return (self.low * (2 * ones - self.size) + self.step * (2 * inside - self.total)) / np.sqrt(max(self.size, 1))


class Block:
    """Rows of one block: ids, labels, integer vectors and their codes, by label."""

    def __init__(self, table: pa.Table):
        n = table.num_rows
        size = table["size"][0].as_py()
        read = lambda c, t, *shape: np.frombuffer(b"".join(table[c].to_pylist()), t).reshape(n, *shape)
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.vectors = read("vector", np.int32, size)
        self.codes = read("codes", np.uint64, CODES, -(-size // 64))
        self.aligned, self.lengths = read("aligned", float, CODES), read("lengths", float, CODES)
        order = np.lexsort((self.ids, self.labels))
        for name in ("ids", "labels", "vectors", "codes", "aligned", "lengths"):
            setattr(self, name, getattr(self, name)[order])
        self.codes, self.aligned, self.lengths = (np.ascontiguousarray(np.moveaxis(a, 1, 0))
                                                  for a in (self.codes, self.aligned, self.lengths))
        # integer sums below 2**53 are exact in floating point, where products are fast
        top = int(np.abs(self.vectors).max(initial=0))
        self.exact = self.vectors.astype(float) if top * top * max(size, 1) < 1 << 53 else None
        self.top = top
        # a code's part of a row is no longer than the row: |sum of codes| <= |row| + |residual|
        self.whole = np.linalg.norm(self.vectors.astype(float), axis=1)

    def same(self, label: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.labels, [label, label + 1])
        return np.arange(lo, hi)

    def other(self, label: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.labels, [label, label + 1])
        return np.concatenate([np.arange(lo), np.arange(hi, len(self.labels))])

    def scores(self, rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
        if self.exact is not None and int(np.abs(vector).max(initial=0)) * self.top * max(len(vector), 1) < 1 << 53:
            return (self.exact[rows] @ vector.astype(float)).astype(np.int64)
        return self.vectors[rows].astype(np.int64) @ vector.astype(np.int64)

    def survivors(self, rows: np.ndarray, vector: np.ndarray, keep) -> np.ndarray:
        """The rows that ``keep(lower, upper)`` leaves, asked after every code."""
        anchor = Planes(vector)
        estimate = np.zeros(len(rows))
        for k in range(CODES):
            if len(rows) <= _FEW:
                break
            estimate = estimate + self.aligned[k][rows] * anchor.with_codes(self.codes[k][rows])
            if k + 1 < ASKED_FROM:
                continue
            left, whole = self.lengths[k][rows], self.whole[rows]
            off = left * anchor.length + (whole + left) * anchor.rounded + _SLACK * (1 + whole * anchor.length)
            stay = keep(estimate - off, estimate + off)
            rows, estimate = rows[stay], estimate[stay]
        return rows


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, -k)[-k] if len(values) >= k else -np.inf


def positives(block: Block, anchor_id: int, label: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's first k rows of the anchor's label."""
    rows = block.same(label)
    rows = rows[block.ids[rows] != anchor_id]
    rows = block.survivors(rows, vector, lambda lower, upper: upper >= _kth(lower, k))
    scores = block.scores(rows, vector)
    first = np.lexsort((block.ids[rows], -scores))[:k]
    return block.ids[rows][first], scores[first]


def negatives(block: Block, label: int, vector: np.ndarray, bounds: list[int], k: int, low: int, high: int):
    """For each positive score in ``bounds``: ids and scores of the block's first k rows of
    other labels with low * bound <= 100 * score <= high * bound."""
    ranges = [(low * b / 100, high * b / 100) for b in bounds]

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(lower), bool)
        for a, b in ranges:
            if a <= b:
                sure = lower[(lower >= a) & (upper <= b)]
                stay |= (upper >= max(a, _kth(sure, k))) & (lower <= b)
        return stay

    rows = block.survivors(block.other(label), vector, keep)
    scores = block.scores(rows, vector)
    order = np.lexsort((block.ids[rows], -scores))
    ids, scores = block.ids[rows][order], scores[order]
    for b in bounds:
        inside = np.flatnonzero((100 * scores >= low * b) & (100 * scores <= high * b))[:k]
        yield ids[inside], scores[inside]


# --- tables ------------------------------------------------------------------

def integer_rows(table: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, vector, size) of the rows that take part; a component x is floor(256 * x)."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
            & F.forall("embedding", lambda x: F.coalesce(F.abs(F.lit(256.0) * x.cast("double")) < LIMIT, F.lit(False))))
    rows = table.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where(fine)
    return rows.select("vec_id", (F.col("label") if label is None else label).alias("label"),
                       F.transform(scaled, lambda x: x.cast("int")).alias("vector"), F.size("embedding").alias("size"))


_STORED = ("block int, size int, vec_id long, label long, vector binary, codes binary, aligned binary, lengths binary")


def coded(rows: DataFrame) -> DataFrame:
    """Rows with codes, in blocks of about BLOCK_ROWS by a hash of the id, written once."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    # of rows that share an id the smallest counts: ids meet in one task, where a sorted run is walked
    dealt = (rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .groupBy("block", "vec_id").agg(F.min(F.struct("label", "vector", "size")).alias("r"))
             .select("block", "r.size", "vec_id", "r.label", "r.vector"))

    def encoded(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                vectors = part.column(4).flatten().to_numpy().astype(np.int32).reshape(part.num_rows, size)
                blobs = [[x.tobytes() for x in np.ascontiguousarray(a)] for a in (vectors, *encode(vectors))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array(b, pa.binary()) for b in blobs)],
                                                 names=[c.split()[0] for c in _STORED.split(", ")])

    return C.stage(dealt.mapInArrow(encoded, _STORED), "negatives-codes")


def _search(rows: DataFrame, anchors: DataFrame, found, schema: str) -> DataFrame:
    """Every chunk of anchors meets every block of rows of its vector length; ``found(block,
    anchors)`` yields result columns per anchor."""
    chunks = max(1, -(-anchors.count() // CHUNK_ROWS))
    blocks = rows.select("size", "block").distinct()
    asked = anchors.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).join(blocks, "size")
    dealt = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if left.num_rows and right.num_rows:
            block = Block(left)
            for row in right.to_pylist():
                for values in found(block, row):
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=names)

    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))  # columns of its own: both sides come from one table
    keys = ["size", "block", "chunk"]
    width = C.shuffle_width(rows.sparkSession)  # named, so that small groups, which are much work, are not merged
    both = [t.repartition(width, *keys).groupBy(*keys) for t in (dealt, asked)]
    return both[0].cogroup(both[1]).applyInArrow(meet, schema)


def _first(found: DataFrame, keys: list[str], id_: str, score: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id_)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80,
         high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``rows``
    are (vec_id, label, vector, size); ``is_anchor`` is a condition on them."""
    stored = coded(rows)
    anchors = stored.where(is_anchor).select("size", "vec_id", "label", "vector")

    def near(block: Block, row: dict):
        ids, scores = positives(block, row["vec_id"], row["label"], np.frombuffer(row["vector"], np.int32), n_positives)
        yield np.full(len(ids), row["vec_id"]), ids, scores

    close = _search(stored, anchors, near, "anchor_id long, positive_id long, positive_score long")
    close = C.stage(_first(close, ["anchor_id"], "positive_id", "positive_score", n_positives), "negatives-positives")
    bounds = close.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "positive_score"))).alias("bounds"))

    def below(block: Block, row: dict):
        vector, given = np.frombuffer(row["vector"], np.int32), row["bounds"]
        wanted = [b["positive_score"] for b in given]
        for b, (ids, scores) in zip(given, negatives(block, row["label"], vector, wanted, n_negatives, low, high), strict=True):
            yield np.full(len(ids), row["vec_id"]), np.full(len(ids), b["rank"]), ids, scores

    far = _search(stored, C.stage(anchors.join(bounds, "vec_id"), "negatives-anchors"), below,
                  "anchor_id long, place long, negative_id long, negative_score long")
    far = _first(far, ["anchor_id", "place"], "negative_id", "negative_score", n_negatives)
    return far.join(close.withColumnRenamed("rank", "place"), ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def given_rows(table: DataFrame) -> DataFrame:
    """The rows of an embedding table, where 7 divides vec_id with the label (label + 1) % 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return integer_rows(table, moved)
