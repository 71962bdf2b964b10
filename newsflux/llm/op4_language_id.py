"""Language ID with error-correcting output codes.

Every language has a codeword; one binary classifier per bit predicts that bit
from hashed byte n-grams, and the language with the nearest codeword wins, so a
few wrong bits are corrected. A bit's classifier is the log-odds of each n-gram
between the languages with a 1 and those with a 0, all weighing alike; it comes
from n-gram counts per language over all training texts, summed by Spark.
Decoding is loss-weighted: each bit's logistic loss counts by how well the bit's
classifier recognises that language on the training texts. Texts whose two
nearest codewords are nearly as close are flagged as ambiguous.

The model is one row of ``FEATURES`` counts per language: its size depends on
the number of languages alone.

Defined cases: a null text, or one without any letter, is ``und`` with score 0;
null languages are not learned from; a table without training rows predicts
``und`` everywhere; with one language all texts with letters get it; equal
distances go to the alphabetically first language; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FEATURES = 1 << 14
ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: Share by which the second distance must exceed the first, else the text is ambiguous.
CLEAR = 0.25
#: Languages whose counts a task holds at once; more are handed over in between.
_HELD = 64

# letters of the features: ASCII letters in lower case and every byte beyond ASCII; all else is a blank
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _features(data: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of one text's bytes, runs of non-letters as one blank."""
    f = _FOLD[data]
    blank = f == 32
    f = f[~blank | ~np.concatenate([[False], blank[:-1]])] if len(f) else f
    f = np.concatenate([[32], f, [32]]).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(f) >= n:
            h = f[:len(f) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ f[k:len(f) - n + 1 + k]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            out.append(h >> np.uint32(32 - 14))
    return np.concatenate(out)


def _counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(index, n-gram counts, has a letter) of each text."""
    for base, data, offsets in C.text_blocks(texts):
        for i in range(len(offsets) - 1):
            part = data[offsets[i]:offsets[i + 1]]
            fold = _FOLD[part]
            letters = bool(((fold >= 97) & (fold <= 122)).any())
            if not letters and (part >= 128).any():
                letters = any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace"))
            yield base + i, np.bincount(_features(part), minlength=FEATURES) if letters else None, letters


# --- codes and classifiers ---------------------------------------------------

def codewords(k: int) -> np.ndarray:
    """(languages, bits) of +1 and -1: the exhaustive code of few languages, else
    the best of some random codes by its smallest row distance."""
    if k <= 1:
        return np.ones((k, 0), np.int8)
    if k <= 7:
        columns = [c for c in product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    bits, best = int(np.ceil(10 * np.log2(k))), None
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([1, -1], np.int8), (k, bits))
        if (abs(code.sum(axis=0)) == k).any():
            continue
        near = (code @ code.T.astype(np.int32) - np.eye(k, dtype=np.int32) * (bits + 1)).max()
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (features, bits)
    trust: np.ndarray  # (languages, bits): loss weights, rows sum to 1

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / np.sqrt(max(counts.sum(), 1))

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss of every language for rows of margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(axis=2)


def _sum_by_language(docs: DataFrame, text: str, lang: str) -> DataFrame:
    schema = "lang string, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out():
            got = pa.RecordBatch.from_pydict(
                {"lang": list(held), "counts": [c.astype(np.int64).tobytes() for c in held.values()]},
                schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))
            held.clear()
            return got

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, counts, letters in _counts(batch.column(0)):
                if letters:
                    if langs[i] not in held and len(held) >= _HELD:
                        yield out()
                    held[langs[i]] = held.get(langs[i], 0) + counts
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [s.tobytes() for s in sums.values()]},
                                         schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    # one row per task and language, first summed in groups of tasks, then per language
    parts = docs.select(text, lang).mapInArrow(count, schema)
    grouped = parts.repartition(C.shuffle_width(docs.sparkSession), "lang", F.spark_partition_id() % 16).mapInArrow(merge, schema)
    return grouped.repartition(8, "lang").mapInArrow(merge, schema)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows of ``docs`` with a language."""
    docs = docs.where(F.col(lang).isNotNull())
    rows = sorted(_sum_by_language(docs, text, lang).collect())  # one row of FEATURES counts per language
    languages = [r[0] for r in rows]
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((FEATURES, 0)), np.ones((len(languages), 0)))
    counts = np.stack([np.frombuffer(r[1], np.int64) for r in rows]).astype(float) + 0.5
    share = counts / counts.sum(axis=1, keepdims=True)
    one, zero = (code == 1).astype(float), (code == -1).astype(float)
    weights = np.log(share.T @ (one / one.sum(axis=0))) - np.log(share.T @ (zero / zero.sum(axis=0)))
    model = Model(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))
    model.trust = _trust(docs, text, lang, model)
    return model


def _trust(docs: DataFrame, text: str, lang: str, model: Model) -> np.ndarray:
    """How often each bit is right on the training texts of each language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        number = {k: i for i, k in enumerate(m.languages)}
        right, seen = np.zeros(m.code.shape, np.int64), np.zeros(len(m.languages), np.int64)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, counts, letters in _counts(batch.column(0)):
                if letters:
                    k = number[langs[i]]
                    right[k] += np.sign(m.margins(counts)) == m.code[k]
                    seen[k] += 1
        k, b = np.meshgrid(*map(np.arange, m.code.shape), indexing="ij")
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(right.ravel()),
             pa.array(np.broadcast_to(seen[:, None], m.code.shape).ravel())], names=["k", "b", "hits", "seen"])

    rows = (docs.select(text, lang).mapInArrow(judge, "k int, b int, hits long, seen long")
            .groupBy("k", "b").agg(F.sum("hits"), F.sum("seen")).collect())  # languages x bits
    trust = np.zeros(model.code.shape)
    for k, b, hits, seen in rows:
        trust[k, b] = (hits + 1) / (seen + 2)
    return trust / trust.sum(axis=1, keepdims=True)


# --- prediction --------------------------------------------------------------

def predicted(docs: DataFrame, model: Model) -> Column:
    """Column function: text -> struct(lang_pred, score, second, ambiguous)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, second string, ambiguous boolean")
    def run(texts: pa.Array) -> pa.Array:
        m, k = sent.value, len(sent.value.languages)
        n = len(texts)
        best, score = np.full(n, -1), np.zeros(n)
        second, unclear = np.full(n, -1), np.zeros(n, bool)
        if k:
            rows, margins = [], []
            for i, counts, letters in _counts(texts):
                if letters:
                    rows.append(i)
                    margins.append(m.margins(counts))
            if rows and k == 1:
                best[rows], score[rows] = 0, 1.0
            elif rows:
                d = m.distances(np.stack(margins))
                order = np.argsort(d, axis=1, kind="stable")
                low, next_ = np.take_along_axis(d, order[:, :2], 1).T
                odds = np.exp(-(d - low[:, None]) * m.code.shape[1])
                best[rows], second[rows] = order[:, 0], order[:, 1]
                score[rows] = 1 / odds.sum(axis=1)
                unclear[rows] = next_ < low * (1 + CLEAR)
        names = pa.array([*m.languages, None], pa.string())
        pred = names.take(pa.array(np.where(best < 0, k, best)))
        return pa.StructArray.from_arrays(
            [pred.fill_null(UNKNOWN), pa.array(score), names.take(pa.array(np.where(second < 0, k, second))), pa.array(unclear)],
            names=["lang_pred", "score", "second", "ambiguous"])

    return run


def identify(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, second, ambiguous of every row. Learned
    from the rows whose crc32(doc_id as text) mod 3 is not 1; the others (and
    rows without a doc_id, whose remainder is unknown) are only predicted."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs.where(rest != 1), text, lang)
    return (docs.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"),
                        predicted(docs, model)(F.col(text)).alias("__found"))
            .select("doc_id", "held_out", "__found.*"))
