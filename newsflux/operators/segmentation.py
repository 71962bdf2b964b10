"""V2: cutting lines of scripts without blanks into words.

A line is split into runs of ideographs, runs of other letters and digits (a word
each), white space (a border) and single other characters (a word each). A run of
ideographs is cut by a dictionary: the words that stand in it are the edges of a
directed graph over its positions, and the path with the most probable words
is found by dynamic programming, words looked up by the first two characters and
the lengths that occur with them. A run is first cut where no word stands across
two neighbours, so that the parts are short and most were met before. Characters that the path leaves single and the dictionary does not
know are joined again and cut by a hidden Markov model with four states (first,
inner and last character of a word, and a word of one character).

Dictionary and model come from text that is already cut (a word list with counts,
or lines with blanks) and are counted by Spark. They are of bounded size: the
``MAX_WORDS`` most frequent words and four counts per character of the script.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import scratch_path

#: Words of a dictionary: more are not sent to the tasks (the rarest are left to the model).
MAX_WORDS = 1 << 19
# Ideographs (with the iteration mark and the extensions), and other word characters.
IDEOGRAPHS = "々㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_PIECE = re.compile(rf"(?P<run>[{IDEOGRAPHS}]+)|(?P<word>(?:(?![{IDEOGRAPHS}_])\w)+(?:[.](?:(?![{IDEOGRAPHS}_])\w)+)*)|(?P<other>\S)")
FIRST, INNER, LAST, SINGLE = range(4)
#: States that may follow each state, and that a run may start or end with.
NEXT = {FIRST: (INNER, LAST), INNER: (INNER, LAST), LAST: (FIRST, SINGLE), SINGLE: (FIRST, SINGLE)}
START, END = (FIRST, SINGLE), (LAST, SINGLE)
#: Parts of runs whose words a task keeps, words that it counts before it hands them on, and bits of the hashes of two neighbouring characters.
MAX_MET = 1 << 18
_PAIR_BITS = 20


def _pairs(codes: np.ndarray) -> np.ndarray:
    """A hash of each two neighbours."""
    return ((codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:]) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _PAIR_BITS)


class Segmenter:
    """``words``: word -> count; ``emitted``: (state, character) -> count; ``moved``: (state, state) -> count."""

    def __init__(self, words: dict[str, int], emitted: dict[tuple[int, str], int], moved: dict[tuple[int, int], int]):
        total = math.log(max(sum(words.values()), 1))
        self.unknown = -total  # the score of a character that is no word: as if met once
        self.words = {w: math.log(n) - total for w, n in words.items()}
        lengths: dict[str, set[int]] = {}  # of the words that begin with these two characters
        for w in words:
            if len(w) > 1:
                lengths.setdefault(w[:2], set()).add(len(w))
        self.lengths = {head: tuple(sorted(n)) for head, n in lengths.items()}
        # the pairs of characters within words, by hash: others may look so too, never the other way round
        codes = np.frombuffer("\0".join(words).encode("utf-32-le"), np.uint32)
        self.inside = np.zeros(1 << _PAIR_BITS, bool)
        self.inside[_pairs(codes)[(codes[1:] != 0) & (codes[:-1] != 0)]] = True
        self.met: dict[str, tuple[str, ...] | list[str]] = {}
        # add-one estimates, so that no path is impossible
        chars = {c for _, c in emitted}
        sums = [sum(n for (s, _), n in emitted.items() if s == k) for k in range(4)]
        self.rare = [-math.log(t + len(chars) + 1) for t in sums]
        self.emit = [{c: math.log(n + 1) + self.rare[k] for (s, c), n in emitted.items() if s == k} for k in range(4)]
        self.move = {}
        for s, targets in NEXT.items():
            out = sum(moved.get((s, t), 0) + 1 for t in targets)
            for t in targets:
                self.move[s, t] = math.log((moved.get((s, t), 0) + 1) / out)
        begin = [sum(moved.get((s, t), 0) for s in END) + 1 for t in START]
        self.start = {t: math.log(n / sum(begin)) for t, n in zip(START, begin, strict=True)}

    def parts(self, run: str) -> list[str]:
        """The run cut where no word of the dictionary stands across, which every path does too."""
        codes = np.frombuffer(run.encode("utf-32-le"), np.uint32)
        cuts = [0, *(np.flatnonzero(~self.inside[_pairs(codes)]) + 1).tolist(), len(run)]
        return [run[i:j] for i, j in itertools.pairwise(cuts)]

    def by_dictionary(self, run: str) -> list[str]:
        """The most probable path; of equal ones the first that ends its words latest."""
        end, known, lengths = len(run), self.words.get, self.lengths.get
        best, step = [0.0] * (end + 1), [0] * (end + 1)
        for i in range(end - 1, -1, -1):
            # a single character always is a word
            top, at = known(run[i], self.unknown) + best[i + 1], i + 1
            for n in lengths(run[i:i + 2], ()):
                j = i + n
                if j > end:
                    break
                score = known(run[i:j])
                if score is not None and score + best[j] >= top:
                    top, at = score + best[j], j
            best[i], step[i] = top, at
        out, i = [], 0
        while i < end:
            out.append(run[i:step[i]])
            i = step[i]
        return out

    def by_model(self, run: str) -> list[str]:
        """The most probable states of a stretch of unknown characters."""
        emit = lambda s, c: self.emit[s].get(c, self.rare[s])
        best = {s: self.start[s] + emit(s, run[0]) for s in START}
        back = []
        for c in run[1:]:
            came = {}
            now = {}
            for s, targets in NEXT.items():
                if s in best:
                    for t in targets:
                        score = best[s] + self.move[s, t] + emit(t, c)
                        if t not in now or score > now[t]:
                            now[t], came[t] = score, s
            best = now
            back.append(came)
        state = max((s for s in END if s in best), key=lambda s: best[s])
        states = [state]
        for came in reversed(back):
            states.append(came[states[-1]])
        out, word = [], ""
        for c, s in zip(run, reversed(states), strict=True):
            word += c
            if s in END:
                out.append(word)
                word = ""
        return out

    def of_part(self, part: str) -> tuple[str, ...] | list[str]:
        """The words of a part, as a list if some are left to the model; those of parts met before are kept."""
        found = self.met.get(part)
        if found is None:
            if len(self.met) >= MAX_MET:
                self.met.clear()
            words = self.by_dictionary(part)
            found = self.met[part] = words if any(len(w) == 1 and w not in self.words for w in words) else tuple(words)
        return found

    def run(self, run: str) -> list[str]:
        out, loose = [], ""
        for part in self.parts(run):
            words = self.met.get(part) or self.of_part(part)
            if not loose and type(words) is tuple:
                out += words
                continue
            for w in words:
                if len(w) == 1 and w not in self.words:
                    loose += w
                    continue
                if loose:
                    out += self.by_model(loose)
                    loose = ""
                out.append(w)
        return out + self.by_model(loose) if loose else out

    def cut(self, line: str) -> list[str]:
        out = []
        for m in _PIECE.finditer(line):
            out += self.run(m[0]) if m["run"] else [m[0]]
        return out


# --- learning ----------------------------------------------------------------

def _states(word: Column) -> Column:
    """(state, character) of every character of a word."""
    chars, n = F.split(word, ""), F.char_length(word)
    state = lambda i: (F.when(n == 1, SINGLE).when(i == 0, FIRST).when(i == n - 1, LAST).otherwise(INNER))
    return F.transform(chars, lambda c, i: F.struct(state(i).alias("state"), c.alias("char")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of ideographs in lines, and (a, b, n) of neighbours: whether each has several characters."""
    ideographs = re.compile(f"[{IDEOGRAPHS}]+").fullmatch
    only = re.compile(rf"[{IDEOGRAPHS}\s]*").fullmatch
    words: Counter[str] = Counter()
    pairs: Counter[tuple[bool, bool]] = Counter()

    def rows() -> pa.RecordBatch:
        keys = [*((w, None, None) for w in words), *((None, *p) for p in pairs)]
        columns = [*zip(*keys, strict=True)] or [()] * 3
        out = pa.RecordBatch.from_arrays([*map(pa.array, columns, (pa.string(), pa.bool_(), pa.bool_())),
                                          pa.array([*words.values(), *pairs.values()], pa.int64())], names=["word", "a", "b", "n"])
        words.clear()
        pairs.clear()
        return out

    for batch in batches:
        for line in batch.column(0).to_pylist():
            tokens = (line or "").split()
            if not only(line or ""):
                tokens = [w for w in tokens if ideographs(w)]
            words.update(tokens)
            several = [len(w) > 1 for w in tokens]
            pairs.update(zip(several, several[1:]))  # noqa: B905
        if len(words) >= MAX_MET:
            yield rows()
    yield rows()


def learn(lines: DataFrame, line: str = "line", min_count: int = 1, max_words: int = MAX_WORDS) -> Segmenter:
    """Dictionary and model from lines whose words stand apart by white space."""
    # one pass over the lines; the counts are read several times
    path = scratch_path(lines.sparkSession, "segmentation-counts")
    counted = lines.select(F.col(line).alias("line")).mapInArrow(_count, "word string, a boolean, b boolean, n bigint")
    counted.groupBy("word", "a", "b").agg(F.sum("n").alias("n")).write.parquet(path)
    counts = lines.sparkSession.read.schema("word string, a boolean, b boolean, n bigint").parquet(path)
    words = counts.where(F.col("word").isNotNull() & (F.col("n") >= min_count)).select("word", "n")
    emitted = (A.explode_rows(words, _states(F.col("word")), "s", "n").groupBy("s.state", "s.char").agg(F.sum("n").alias("n")))
    # within words: first -> (inner ->) last; across words: last or single -> first or single
    length = F.char_length
    inside = words.agg(*[F.coalesce(F.sum(F.when(length("word") >= k, F.col("n") * F.greatest(length("word") - m, F.lit(1)))), F.lit(0))
                         .cast("long").alias(name) for name, k, m in (("two", 2, 999), ("three", 3, 999), ("inner", 3, 3))],
                       F.coalesce(F.sum(F.when(length("word") == 3, F.col("n"))), F.lit(0)).cast("long").alias("exact")).first()
    across = counts.where(F.col("word").isNull()).select("a", "b", "n").collect()  # four rows at most
    moved = {(FIRST, LAST): inside["two"] - inside["three"], (FIRST, INNER): inside["three"], (INNER, LAST): inside["three"],
             (INNER, INNER): inside["inner"] - inside["exact"]}
    moved |= {(LAST if r["a"] else SINGLE, FIRST if r["b"] else SINGLE): r["n"] for r in across}
    top = words.orderBy(F.desc("n"), "word").limit(max_words)  # a bounded dictionary: see MAX_WORDS
    return Segmenter({r["word"]: r["n"] for r in top.toLocalIterator()},
                     {(r["state"], r["char"]): r["n"] for r in emitted.toLocalIterator()}, moved)


def segmenter(spark, learned: Segmenter) -> Callable[[Column], Column]:
    """A column function for ``vectors.corpus_lines``: line -> its words joined by one blank."""
    sent = spark.sparkContext.broadcast(learned)

    @F.arrow_udf("string")
    def cut(lines: pa.Array) -> pa.Array:
        s = sent.value
        return pa.array([None if x is None else " ".join(s.cut(x)) for x in lines.to_pylist()], pa.string())

    return cut
