"""Quality rules by repetition coverage.

For every text, rolling hashes of its word windows of several lengths find the
windows that occur again in the same text; the rule measures which share of
the word characters lies inside such later copies, and which share lies in
lines that repeat an earlier line. A share is too large beyond the limits customary
for web pages where the later copies are more than one repeated title or refrain,
that is more than ``max_copy_words`` words or at several places; one such copy alone
is too much beyond twice these limits. Windows of length n + 1 are looked for only
where windows of length n repeat, so the long lengths cost little.

The operator is a scalar Arrow function on the text column: no shuffle, no
state between rows, memory bounded by the Arrow batch.

Defined cases: a null or empty text has no words, all counts 0, and fails the
base rule; rows are judged one by one, so ties and repeated rows get equal
results; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are of a text's word characters."""

    min_words: int = 50
    #: Percent of words in repeated 3-word windows (first occurrences included).
    max_repeat_words_pct: int = 50
    #: Window length -> largest share of characters in later copies of windows,
    #: for any copies. Twice the limits customary for web pages: texts of 50 to
    #: 100 words may repeat one line (a title, a refrain) and be sound.
    max_window_share: tuple[tuple[int, float], ...] = (
        (5, 0.30), (6, 0.28), (7, 0.26), (8, 0.24), (9, 0.22), (10, 0.20))
    #: Largest share of characters in lines equal to an earlier line.
    max_line_share: float = 0.30
    #: The customary limits, for later copies of more than ``max_copy_words`` words
    #: or at more than one place.
    max_copies_share: tuple[tuple[int, float], ...] = (
        (5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    max_copy_words: int = 15


RULES = Rules()

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "dup_line_chars long, window_chars array<long>, base_failed boolean, kept boolean")


def _repeats(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in text order: is it equal to another item of its text, and is
    it equal to an earlier one? Compared by (text, hash)."""
    order = np.lexsort((h, text))
    hs, ts = h[order], text[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (hs[1:] == hs[:-1]) & (ts[1:] == ts[:-1])
    again, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order] = same[1:] | same[:-1]
    later[order] = same[:-1]  # lexsort is stable: the first of a run is the earliest
    return again, later


def _cover(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words covered by windows of n words that begin at ``starts``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    n_texts = len(offsets) - 1
    starts, ends, first = C.word_spans(data, offsets)
    words, text = len(starts), np.repeat(np.arange(n_texts), np.diff(first))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    per_text = lambda weights, of: np.bincount(of, weights, n_texts).astype(np.int64)
    out = {"n_words": np.diff(first), "word_chars": per_text(chars, text)}
    symbol = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    out["n_symbols"] = symbol[offsets[1:]] - symbol[offsets[:-1]]

    l_start, l_end, l_first = C.line_spans(data, offsets)
    l_words = np.searchsorted(starts, l_end) - np.searchsorted(starts, l_start)
    l_text = np.repeat(np.arange(n_texts), np.diff(l_first))
    filled = np.flatnonzero(l_words > 0)
    _, later = _repeats(C.span_hash(data, l_start[filled], l_end[filled]), l_text[filled])
    dup = filled[later]
    run = np.concatenate([[0], np.cumsum(chars)])
    a = np.searchsorted(starts, l_start[dup])
    out["n_dup_lines"] = np.bincount(l_text[dup], minlength=n_texts)
    out["dup_line_chars"] = per_text(run[a + l_words[dup]] - run[a], l_text[dup])

    h = C.span_hash(data, starts, ends)
    at, of = C.windows_per_text(first, 3, words)
    again, _ = _repeats(C.window_hash(h, 3)[at], of)
    out["n_repeat_words"] = np.bincount(text[_cover(at[again], 3, words)], minlength=n_texts)
    # a window can only repeat where its first 3 words repeat, and then where
    # the next shorter window does
    near, rows, n_words, n_places = at[again], [], [], []
    for n in lengths:
        ok = (near + n <= words)
        ok[ok] = text[near[ok]] == text[near[ok] + n - 1]
        near = near[ok]
        key = np.zeros(len(near), np.uint64)
        for k in range(n):
            key = C.mix(key * np.uint64(0xD1342543DE82EF95) + h[near + k])
        again, later = _repeats(key, text[near])
        inside = _cover(near[later], n, words)
        rows.append(per_text(chars[inside], text[inside]))
        n_words.append(np.bincount(text[inside], minlength=n_texts))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (text[1:] != text[:-1])
        n_places.append(np.bincount(text[begins], minlength=n_texts))
        near = near[again]
    for name, per_length in (("window_chars", rows), ("window_words", n_words), ("window_places", n_places)):
        out[name] = np.stack(per_length, 1) if per_length else np.zeros((n_texts, 0), np.int64)
    return out


def quality(rules: Rules = RULES) -> Callable[[Column | str], Column]:
    """Column function: text -> struct of counts and verdict (see RESULT)."""
    lengths = tuple(n for n, _ in rules.max_window_share)
    shares = np.array([s for _, s in rules.max_window_share])
    customary = np.array([dict(rules.max_copies_share).get(n, 1.0) for n in lengths])

    @F.arrow_udf(RESULT)
    def measure(texts: pa.Array) -> pa.Array:
        parts = [_measure(data, offsets, lengths) for _, data, offsets in C.text_blocks(texts)]
        got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
        if not parts:
            got = {k: np.zeros(0, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                     "n_repeat_words", "dup_line_chars")}
            got |= {k: np.zeros((0, len(lengths)), np.int64) for k in ("window_chars", "window_words", "window_places")}
        n = got["n_words"]
        failed = (n < rules.min_words) | (100 * got["n_repeat_words"] > rules.max_repeat_words_pct * n)
        copies = (got["window_words"] > rules.max_copy_words) | (got["window_places"] > 1)
        limits = np.where(copies, np.minimum(customary, shares), shares)
        repeated = ((got["window_chars"] > limits * got["word_chars"][:, None]).any(axis=1)
                    | (got["dup_line_chars"] > rules.max_line_share * got["word_chars"]))
        windows = pa.ListArray.from_arrays(
            pa.array(np.arange(len(n) + 1) * len(lengths), pa.int32()), pa.array(got["window_chars"].ravel(), pa.int64()))
        cols = {k: pa.array(got[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                              "n_repeat_words", "dup_line_chars")}
        cols |= {"window_chars": windows, "base_failed": pa.array(failed), "kept": pa.array(~failed & ~repeated)}
        return pa.StructArray.from_arrays(list(cols.values()), names=list(cols))

    return measure


def assess(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """``docs``' doc_id with all measures and the verdict."""
    measured = docs.select("doc_id", quality(rules)(F.col(text)).alias("__quality"))
    return measured.select("doc_id", "__quality.*")


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    judged = docs.withColumn("__quality", quality(rules)(F.col(text)))
    return judged.where("__quality.kept").drop("__quality")
