"""Line dedup: repeated lines of a corpus, by range-partitioned line hashes.

Every line becomes (hash, document, position). The hashes are range-partitioned
and sorted by hash, document and position, so that one streaming pass over a
partition sees a key's occurrences in document order: its first occurrence and
how many documents hold it. A key is split over ``SALTS`` sub-ranges by document,
so a line that a third of all documents share is spread over many tasks; the
sub-ranges' findings are combined by an aggregate with map-side combine. The
result is not text but one compressed keep bitmap per document that loses
lines: the runs (start, length) of kept line numbers.

DataFrame functions only: no Python runs on the executors.

Policies: ``keep_first`` keeps the first occurrence (by doc_id, then position)
of a key that occurs in at least ``min_docs`` documents; otherwise all its
occurrences go.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_key_chars`` code points are never dropped; rows with equal doc_id and text
are one document (each gets the document's bitmap); a null doc_id is an id like
any other and sorts first; empty tables give empty results; other columns are
ignored by ``keep_bitmaps`` and kept by ``apply_bitmaps``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Sub-ranges of one key: the occurrences of a line in a third of all documents meet in about 1/(3 * SALTS) of a task set.
SALTS = 64

_TRIMMED = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_TRIMMED)), string.ascii_uppercase, string.ascii_lowercase)


def _doc_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, text: str, min_key_chars: int) -> DataFrame:
    """One row per line that may be dropped: 128-bit key hash, document, position."""
    lines = docs.select(F.col("doc_id").alias("d"), _doc_hash(F.col(text)).alias("t"),
                        F.posexplode_outer(split_lines(F.col(text))).alias("pos", "line"))
    keyed = lines.select("d", "t", "pos", line_key(F.col("line")).alias("key"))
    return (keyed.where(F.char_length("key") >= min_key_chars)
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "d", "t", "pos"))


def _salted(occ: DataFrame) -> DataFrame:
    return occ.withColumn("salt", F.pmod(F.xxhash64("d", "t"), F.lit(SALTS)))


def repeated_keys(occ: DataFrame, min_docs: int) -> DataFrame:
    """Keys found in at least ``min_docs`` documents, with their first occurrence
    and the sub-ranges that hold them."""
    ranged = _salted(occ).repartitionByRange(C.shuffle_width(occ.sparkSession), "h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("d", "t", "pos")
    before = F.lag(F.struct("d", "t")).over(stream)
    seen = ranged.withColumn("new_doc", F.when(before.eqNullSafe(F.struct("d", "t")), 0).otherwise(1))
    return (seen.groupBy("h1", "h2")
            .agg(F.sum("new_doc").alias("n_docs"), F.min(F.struct("d", "t", "pos")).alias("first"),
                 F.collect_set("salt").alias("salts"))  # SALTS at most
            .where(F.col("n_docs") >= min_docs))


def _runs(dropped: Column, n_lines: Column) -> Column:
    """Kept runs (start, length) between sorted dropped positions."""
    return F.transform(
        F.array(F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))),
        lambda d: F.filter(
            F.transform(F.sequence(F.lit(1), F.size(d) - 1),
                        lambda i: F.struct((F.element_at(d, i) + 1).alias("start"),
                                           (F.element_at(d, i + 1) - F.element_at(d, i) - 1).alias("length"))),
            lambda r: r["length"] > 0))[0]


def keep_bitmaps(docs: DataFrame, text: str = "text", min_docs: int = 10, min_key_chars: int = 1,
                 keep_first: bool = False) -> DataFrame:
    """(d, t, n_lines, n_dropped, keep): doc_id and text hash of every document
    that loses lines, and its keep bitmap as runs. Documents without a row keep
    all lines."""
    occ = C.stage(occurrences(docs, text, min_key_chars), "line-keys")
    keys = repeated_keys(occ, min_docs)
    # one row per sub-range that holds a key: a frequent key's occurrences stay spread
    spread = keys.select("h1", "h2", F.explode("salts").alias("salt"), "first")
    gone = _salted(occ).join(spread, ["h1", "h2", "salt"])
    if keep_first:
        gone = gone.where(~F.col("first").eqNullSafe(F.struct("d", "t", "pos")))
    lost = gone.groupBy("d", "t").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    sizes = docs.select(F.col("doc_id").alias("d_"), _doc_hash(F.col(text)).alias("t_"),
                        F.size(split_lines(F.col(text))).alias("n_lines")).distinct()
    return (lost.join(sizes, lost["d"].eqNullSafe(sizes["d_"]) & (lost["t"] == sizes["t_"]))
            .select("d", "t", "n_lines", F.size("dropped").alias("n_dropped"),
                    _runs(F.col("dropped"), F.col("n_lines")).alias("keep")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all columns, the kept text in ``__kept_text`` and
    ``__n_lines``, ``__n_dropped`` beside it."""
    own = bitmaps.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("n_dropped").alias("__lost"),
                         F.col("keep").alias("__keep"))
    joined = docs.join(own, docs["doc_id"].eqNullSafe(F.col("__d")) & (_doc_hash(docs[text]) == F.col("__t")), "left")
    # the one-element array binds the lines to a name, so that they are split once per text
    kept = F.transform(
        F.array(split_lines(F.col(text))),
        lambda lines: F.array_join(F.flatten(F.transform(
            F.col("__keep"), lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n"))[0]
    return (joined
            .withColumn("__kept_text", F.when(F.col("__keep").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept))
            .withColumn("__n_lines", F.size(split_lines(F.col(text))))
            .withColumn("__n_dropped", F.coalesce("__lost", F.lit(0)))
            .drop("__d", "__t", "__lost", "__keep"))


def drop_repeated_lines(docs: DataFrame, text: str = "text", **policy) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text`` (and ``n_chars``, where
    it exists, counted anew for the texts that lost lines)."""
    cut = apply_bitmaps(docs, keep_bitmaps(docs, text, **policy), text)
    lost = F.col("__n_dropped") > 0
    new = {text: F.when(lost, F.col("__kept_text")).otherwise(F.col(text))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.char_length("__kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumns(new).select(*docs.columns)
