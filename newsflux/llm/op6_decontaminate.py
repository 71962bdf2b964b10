"""Benchmark decontamination by question templates.

Words become template words: numbers, units and names turn into typed
placeholders, all others into their lower-case form. Windows of template words
are hashed for the benchmark and for the documents and joined on the hash, so a
question whose numbers or names were replaced still meets its original. A match
then has to be slot-consistent: along one alignment of item and document, equal
slot values of the item are equal in the document (and different names stay
different); of an inconsistent alignment only the verbatim windows count. A
document holds an item when its matched windows cover ``min_covered`` words of
the item, or all of a shorter one.

Names cannot be told from sentence starts without context, so every window is
hashed with capitalised words as names, and with all words in lower case (which
also finds passages whose case was changed). Both ask for a share of literal
words, as few literals between placeholders fit anything; a third reading takes
every word's own value, without such a share, so that passages full of numbers
and units are found word for word. With names, a run of words of one class is one
placeholder, as a name or a quantity may have several words.

Scripts without blanks (ideographs, kana, Thai) are cut into characters, which count as words.
Items of fewer than ``MIN_TEMPLATE_WORDS`` words fit anything as templates: they are
looked for word for word.

Documents' windows are first held against a Bloom filter of the benchmark's
windows; only survivors (and the few false positives) are
shuffled, and the join on the hash is exact. A benchmark of any size works; a
large one merely lets more windows through to the join.

Defined cases: null, empty or blank texts match nothing; items of fewer than
``MIN_ITEM_CHARS`` characters (blanks and outer punctuation not counted) are not looked for ("yes",
"the cat": they occur everywhere); repeated
rows are judged alike, pairs are distinct; a null doc_id or item_id is reported
as null; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bloom import Bloom
from .rows import text_key, without

WINDOW = 8
#: Template words of a window that must not be placeholders, per mille of its words.
MIN_LITERAL = 600
#: Items of fewer words are found word for word only, and of fewer characters not at all.
MIN_TEMPLATE_WORDS = 5
MIN_ITEM_CHARS = 10
MIN_COVERED = 13

# Words of measures, and number words.
UNITS = """
mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes
oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute
minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp
percent degree degrees mph kmh watt watts volt volts joule joules
""".split()
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split()

_NUMBER, _UNIT, _NAME = 1, 2, 3
_PLACEHOLDER = np.array([0, 0xA5B1C9D3E7F10325, 0xB7D5E3F10921436D, 0xC3A59B7D1F2E4C69], np.uint64)

_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    low = C._LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[latin] += 0x20
    return low


def _hash_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(w.encode()) for w in words])])
    return np.sort(C.span_hash(raw, cuts[:-1], cuts[1:]))


_UNIT_HASHES, _NUMBER_HASHES = _hash_of(UNITS), _hash_of(NUMBER_WORDS)


def _characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans with every character of a script without blanks as a word of its own: of the
    three bytes of U+3000-U+9FFF or of Thai (U+0E00-U+0E7F), by the first."""
    lead = (data >= 0xE3) & (data <= 0xE9)
    lead[:-1] |= (data[:-1] == 0xE0) & (data[1:] >= 0xB8) & (data[1:] <= 0xB9)
    at = np.flatnonzero(lead)
    if not len(at):
        return starts, ends
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[starts] = last[ends] = True
    last[at[~first[at]]] = True  # a word before it ends
    first[at] = True
    after = np.minimum(at + 3, len(data))
    first[after[~last[after]]] = True  # a word behind it goes on
    last[after] = True
    return np.flatnonzero(first), np.flatnonzero(last)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value hash and class (0: literal) of every word of a block, stripped of
    outer punctuation, and each text's first word."""
    starts, ends, _ = C.word_spans(data, offsets)
    starts, ends = _characters(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    core = np.concatenate([np.flatnonzero(_CORE[data]), [len(data)]])
    a = core[np.searchsorted(core, starts)]
    b = core[np.maximum(np.searchsorted(core, ends) - 1, 0)] + 1
    ok = a < ends
    first = np.concatenate([[0], np.cumsum(ok)])[first]
    a, b = a[ok], b[ok]
    value = C.span_hash(_lowered(data), a, b)
    lead, after = data[a], data[np.minimum(a + 1, max(len(data) - 1, 0))]
    kind = np.zeros(len(a), np.int8)
    kind[((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E))] = _NAME
    kind[_among(value, _UNIT_HASHES)] = _UNIT
    kind[((lead >= 48) & (lead <= 57)) | _among(value, _NUMBER_HASHES)] = _NUMBER
    return value, kind, first


def _merged(value: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with each run of placeholders of one class as one word."""
    if not len(kind):
        return value, kind, first
    begins = np.ones(len(kind), bool)
    begins[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1])
    begins[first[:-1][first[:-1] < len(kind)]] = True
    at = np.flatnonzero(begins)
    # a run's value: the sum of its words' values, each turned by its place
    place = np.arange(len(kind)) - np.repeat(at, np.diff(np.append(at, len(kind))))
    turned = np.where(place == 0, value, C.mix(value + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.add.reduceat(turned, at), kind[at], np.searchsorted(at, first)


def _readings(value: np.ndarray, kind: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, start, text, values, placeholder classes, first words) of all windows of n words. The
    reading with names counts words of its own, so each count has all its windows: with
    names and merged runs, and with capitalised words as any others; of the reading without placeholders
    only windows that read differently are added."""
    lower, plain = np.where(kind == _NAME, np.int8(0), kind), np.zeros_like(kind)
    readings = [(value, plain, first, None)]
    if n >= MIN_TEMPLATE_WORDS:
        readings = [(*_merged(value, kind, first), None), (value, lower, first, None), (value, plain, first, lower > 0)]
    for v, k, f, of in readings:
        at, text = C.windows_per_text(f, n, len(v))
        if not len(at):
            continue
        literal = np.concatenate([[0], np.cumsum(k == 0)])
        ok = 1000 * (literal[at + n] - literal[at]) >= MIN_LITERAL * n
        if of is not None:
            differs = np.concatenate([[0], np.cumsum(of)])
            ok &= differs[at + n] > differs[at]
        yield C.window_hash(np.where(k > 0, _PLACEHOLDER[k], v), n)[at[ok]].view(np.int64), at[ok], text[ok], v, k, f


def _rows(ids: pa.Array, keys: pa.Array, texts: pa.Array, lengths: list[int] | None, wanted: Bloom | None):
    """Window rows of a batch of texts; ``lengths``: of all windows (None: the
    window length, or a shorter item's own)."""
    for base, data, offsets in C.text_blocks(texts):
        value, kind, first = _template(data, offsets)
        core = np.concatenate([[0], np.cumsum(_CORE[data] & ((data & 0xC0) != 0x80))])
        large = core[offsets[1:]] - core[offsets[:-1]] >= MIN_ITEM_CHARS
        for n in lengths or range(1, WINDOW + 1):
            for h, at, text, v, k, f in _readings(value, kind, first, n):
                count = np.diff(f)
                ok = np.ones(len(h), bool) if wanted is None else wanted.has(h)
                if lengths is None:
                    ok &= large[text] & ((count[text] >= WINDOW) if n == WINDOW else (count[text] == n))
                h, at, text = h[ok], at[ok], text[ok]
                inside = at[:, None] + np.arange(n)
                slots = np.where(k[inside] > 0, (v[inside] & ~np.uint64(3)) | k[inside].astype(np.uint64), np.uint64(0))
                cuts = np.arange(len(h) + 1) * n
                rows = pa.array(base + text)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows).cast(pa.int64()), keys.take(rows), pa.array(h),
                     pa.array((at - f[text]).astype(np.int32)), pa.array(count[text].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(slots.view(np.int64).ravel()))],
                    names=["id", "key", "hash", "pos", "words", "slots"])


_ROW = "id long, key long, hash long, pos int, words int, slots array<long>"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _rows(*b.columns, None, None)


def _doc_windows(wanted: Broadcast, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rows(*b.columns, lengths, wanted.value)
    return run


def _consistent(pairs: Column) -> Column:
    """Distinct slot pairs (item value, document value): a function, one to one on names."""
    names = F.filter(pairs, lambda p: p["b"].bitwiseAND(F.lit(3)) == _NAME)
    one_value = F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))) == F.size(pairs)
    return one_value & (F.size(F.array_distinct(F.transform(names, lambda p: p["d"]))) == F.size(names))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
          min_covered: int = MIN_COVERED) -> DataFrame:
    """(doc_id, key, item_id, n_covered, n_item_words, verbatim): the items that
    each document holds; key is the text's hash, to tell rows with equal ids; verbatim
    if windows that are word for word the same cover enough of the item."""
    spark = docs.sparkSession
    bench = C.stage(items.select(F.col("item_id"), text_key(F.col(item_text)).alias("key"), F.col(item_text))
                    .mapInArrow(_item_windows, _ROW)
                    .select("hash", F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("pos").alias("b_pos"),
                            "words", F.size("slots").alias("n"), F.col("slots").alias("b_slots")).distinct(),
                    "bench-windows")
    wanted = spark.sparkContext.broadcast(Bloom.of(bench, "hash"))
    lengths = sorted(r[0] for r in bench.select("n").distinct().collect())  # 1 .. WINDOW at most
    if not lengths:
        lengths = [WINDOW]
    found = (docs.select("doc_id", text_key(F.col(text)).alias("key"), F.col(text))
             .mapInArrow(_doc_windows(wanted, lengths), _ROW)
             .select("hash", F.col("id").alias("doc_id"), "key", F.col("pos").alias("d_pos"), F.size("slots").alias("n"),
                     F.col("slots").alias("d_slots")))
    pairs = F.filter(F.transform(F.arrays_zip(F.col("b_slots").alias("b"), F.col("d_slots").alias("d")),
                                 lambda p: F.struct(p["b"].alias("b"), p["d"].alias("d"))), lambda p: p["b"] != 0)
    met = (found.join(bench, ["hash", "n"])
           .select("doc_id", "key", "item_id", "item_key", (F.col("d_pos") - F.col("b_pos")).alias("shift"), "b_pos", "n",
                   "words", pairs.alias("pairs"))
           .withColumn("verbatim", ~F.exists("pairs", lambda p: p["b"] != p["d"])))
    # a group holds the windows of one item at one alignment: at most the item's own length
    aligned = (met.groupBy("doc_id", "key", "item_id", "item_key", "shift", "words")
               .agg(F.collect_set(F.struct("b_pos", "n", "verbatim")).alias("hits"),
                    F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")))
    kept = aligned.withColumn("hits", F.when(_consistent(F.col("pairs")), F.col("hits"))
                              .otherwise(F.filter("hits", lambda h: h["verbatim"])))
    hits = kept.select("doc_id", "key", "item_id", "item_key", "words", F.explode("hits").alias("hit"))
    whole = (hits.groupBy("doc_id", "key", "item_id", "item_key", "words")
             .agg(F.sort_array(F.collect_set("hit.b_pos")).alias("at"), F.max("hit.n").alias("n"),
                  F.sort_array(F.collect_set(F.when(F.col("hit.verbatim"), F.col("hit.b_pos")))).alias("same_at")))
    covered = lambda at: F.aggregate(
        F.sequence(F.lit(1), F.size(at)), F.lit(0),
        lambda s, i: s + F.least(F.col("n"), F.coalesce(F.get(F.col(at), i), F.lit(1 << 30)) - F.element_at(at, i)))
    enough = F.least(F.lit(min_covered), F.col("words"))
    return (whole.withColumn("n_covered", covered("at")).where(F.col("n_covered") >= enough)
            .withColumn("verbatim", F.when(F.size("same_at") > 0, covered("same_at") >= enough).otherwise(F.lit(False)))
            .groupBy("doc_id", "key", "item_id")
            .agg(F.max("n_covered").alias("n_covered"), F.max("words").alias("n_item_words"),
                 F.max("verbatim").alias("verbatim")))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    return without(docs, C.stage(leaks(docs, items, text).select("doc_id", "key").distinct(), "leaks"), text)
