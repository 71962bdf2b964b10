"""N-gram Jaccard join: groups of documents whose shingle sets are alike.

A document's set holds the hashes of its distinct n-word shingles; two documents
link when ``100 * |x & y| >= percent * |x | y|``. The join is exact:

1. Shingle frequencies of the whole corpus are counted into ``2**RANK_BITS``
   hash buckets. Any total order keeps a prefix join exact, so the coarse
   counts only decide how rare the prefixes are.
2. Documents with equal sets form one class; only classes are joined.
3. Prefix filter: a class enters its rarest shingles, ``n - ceil(t n) + 1`` of
   them, as postings (shingle, position, size, class). Length and positional
   filters drop posting pairs that cannot reach the needed overlap.
4. Suffix filter: a pair's difference is at least the sum of the differences of
   its partition sizes (both sets cut at fixed hash pivots), carried as a small
   vector per class.
5. The remaining pairs are verified once each on their whole sets.

To avoid all pairs within a group of near copies, a posting is not paired with
itself: every member meets the posting's *hub* (the member whose shared shingle
is nearest to the front, hence the one with the fewest rare shingles of its
own). Links merge classes into components. Afterwards a posting is looked at
again only while it holds several components, each time without the hubs that
have met all its members. Of postings that are still mixed after ``HUB_ROUNDS`` those of up to ``FEW``
classes are paired. The classes of larger ones are joined by partitions instead of postings, as a posting
may hold any number of unlike classes: sets that link differ in at most d shingles, so of d + 1 parts of their shingles
(dealt by hash) at least one is equal in both. Parts that are empty or hold only frequent shingles are equal in unlike
sets too, so some more parts are dealt than that, and a set shows only its rarest d + 1. Classes of one or two neighbouring size
bands meet where such a part is equal, which unlike sets hardly ever share. Near copies that just miss the limit do, so
classes of a part with more than ``FEW_EQUAL`` members are not paired but taken as one group with those they are tied to by
such parts, and compared by their deviations from the group's centre (``_by_deviations``). Pairs in
different components that are not verified yet are verified. So no pair is skipped that could
join two components: the components are those of the full join.

Defined cases: null, empty or blank texts have an empty set and are linked with
nothing; a text of fewer than n words has its whole word sequence as its one
shingle; equal rows share a class; a null doc_id gets the component of its set,
whose id is the smallest non-null doc_id in it (its own, null, if alone); empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common as C
from .bloom import Bloom
from .graph import components
from .rows import text_key, without

#: Buckets (2**bits) of the frequency table; its ranks, one byte each, are sent to every task.
RANK_BITS = 21
#: Blocks in which tasks hand over their counts.
_BLOCK = 1 << 14
#: Pivots of the suffix filter.
PARTS = 64
#: Hubs that a posting's members meet before the rest is joined by equal parts.
HUB_ROUNDS = 3
#: Classes of a mixed posting that are simply paired (so pairs stay within a constant times the postings).
FEW = 16
#: Classes of a shared part that are simply paired.
FEW_EQUAL = 4
#: Times that groups are split by a shared deviation from their centre before they are paired whatever their size,
#: and members of a group after a split that is simply paired: positions then exclude nearly all of its pairs.
SPLITS = 2
FEW_SPLIT = 256
#: Members of a group, and shingles, from which a task takes what most of them have, on the way to the group's centre.
CENTRE_MEMBERS = 64
CENTRE_SHINGLES = 1 << 20


# --- sets --------------------------------------------------------------------

def _shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of a block's texts (with repeats), the first
    shingle of each text (length: texts + 1), and each text's word count."""
    starts, ends, first = C.word_spans(data, offsets)
    words, count = C.span_hash(data, starts, ends), np.diff(first)
    at, _ = C.windows_per_text(first, n, len(words))
    hashes = C.window_hash(words, n)[at]
    sizes = np.maximum(count - n + 1, 0)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([C.window_hash(words[first[i]:first[i + 1]], count[i])[0] ^ np.uint64(count[i]) for i in short],
                         np.uint64)
        hashes = np.insert(hashes, np.concatenate([[0], np.cumsum(sizes)])[short], whole)
        sizes[short] = 1
    return hashes, np.concatenate([[0], np.cumsum(sizes)]), count


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text."""
    for base, data, offsets in C.text_blocks(texts, lower=True):
        hashes, first, _ = _shingles(data, offsets, n)
        for i in range(len(offsets) - 1):
            s = np.sort(hashes[first[i]:first[i + 1]])  # faster and smaller than np.unique, which hashes
            yield base + i, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _identity(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    if not len(s):
        return 0
    both = np.array([np.sum(s, dtype=np.uint64) ^ np.uint64(len(s)), np.bitwise_xor.reduce(C.mix(s))], np.uint64)
    return int(C.window_hash(both, 2).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    """Two sets that link share a shingle in their prefixes of this length."""
    return n - -(-percent * n // 100) + 1


# --- rare-first order --------------------------------------------------------

def _count_buckets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RANK_BITS, np.int64)
        shift = np.uint64(64 - RANK_BITS)
        for batch in batches:
            for _, data, offsets in C.text_blocks(batch.column(0), lower=True):
                # counted in place: a task holds the counts and one block's shingles
                np.add.at(counts, (_shingles(data, offsets, n)[0] >> shift).view(np.int64), 1)
        # as planes of single bytes: the higher ones are mostly absent
        rows = {"block": [], "plane": [], "counts": []}
        planes = counts.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)
        for plane in range(8):
            part = planes[:, plane].reshape(-1, _BLOCK)
            for b in np.flatnonzero(part.any(axis=1)):
                rows["block"].append(int(b))
                rows["plane"].append(plane)
                rows["counts"].append(part[b].tobytes())
        for i in range(0, len(rows["block"]), 64):
            yield pa.RecordBatch.from_pydict(
                {k: v[i:i + 64] for k, v in rows.items()},
                schema=pa.schema([("block", pa.int32()), ("plane", pa.int32()), ("counts", pa.binary())]))
    return run


def _sum_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per block, streaming; a byte per bucket: about six steps per doubling."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, plane, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums.setdefault(b, np.zeros(_BLOCK, np.int64))
            sums[b] += np.frombuffer(raw, np.uint8).astype(np.int64) << (8 * plane)
    for b, s in sums.items():
        rank = np.minimum(np.round(6 * np.log2(1 + s)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"block": [b], "ranks": [rank.tobytes()]},
                                         schema=pa.schema([("block", pa.int32()), ("ranks", pa.binary())]))


def shingle_ranks(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """A rank (frequency on a log scale) per hash bucket: 2**RANK_BITS bytes,
    whatever the corpus holds."""
    counts = docs.select(text).mapInArrow(_count_buckets(n), "block int, plane int, counts binary")
    width = min(C.shuffle_width(docs.sparkSession), (1 << RANK_BITS) // _BLOCK)
    sums = counts.repartition(width, "block").mapInArrow(_sum_buckets, "block int, ranks binary")
    ranks = np.zeros(((1 << RANK_BITS) // _BLOCK, _BLOCK), np.uint8)
    for b, raw in sums.collect():  # 2**RANK_BITS bytes in all
        ranks[b] = np.frombuffer(raw, np.uint8)
    return ranks.ravel()


# --- prefixes ----------------------------------------------------------------

_SET_SCHEMA = "doc_id long, key long, n int, node long, prefix array<long>, parts binary"


def _describe(ranks: Broadcast, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        shift = np.uint64(64 - RANK_BITS)
        for batch in batches:
            sizes, nodes, prefixes, parts = [], [], [], []
            for _, s in _sets(batch.column(2), n):
                keep = prefix_length(len(s), percent) if len(s) else 0
                order = np.argsort(rank[(s >> shift).astype(np.int64)], kind="stable")[:keep]
                sizes.append(len(s))
                nodes.append(_identity(s))
                prefixes.append(s[order].view(np.int64))
                # held at 65535: differences only shrink, so they stay a lower bound
                parts.append(np.minimum(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 65535)
                             .astype(np.uint16).tobytes())
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)), pa.array(parts, pa.binary())],
                names=["doc_id", "key", "n", "node", "prefix", "parts"])
    return run


def _needed_sets(wanted: Broadcast, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # classes that this task has handed over
        for batch in batches:
            nodes, sets = [], []
            for _, s in _sets(batch.column(0), n):
                node = _identity(s)
                if node not in sent and wanted.value.has(np.array([node], np.int64))[0]:
                    sent.add(node)
                    nodes.append(node)
                    sets.append(s.tobytes())
                    if sum(map(len, sets)) > C.BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())],
                                                         names=["node", "members"])
                        nodes, sets = [], []
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())],
                                             names=["node", "members"])
    return run


# --- equal parts ---------------------------------------------------------------

def size_bands(largest: int, percent: int) -> np.ndarray:
    """Lower ends of size bands: linked sets are in one band or in neighbouring ones."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, 100 * ends[-1] // percent + 1))
    return np.array(ends, np.int64)


def parts_of(band: int, bands: np.ndarray, percent: int) -> int:
    """One more than the most shingles in which linked sets differ, the larger of them in this band."""
    n = int(bands[band + 1]) - 1
    return 2 * n * (100 - percent) // (100 + percent) + 1


def spare_parts(keep: int) -> int:
    """Parts that a set need not show (none if only equal sets link)."""
    return 0 if keep == 1 else 1 + keep // 4


def _equal_parts(wanted: Broadcast, n: int, percent: int, largest: int, ranks: Broadcast | None = None):
    """The parts by which linked sets meet. Shingles are dealt into more parts than ``parts_of``, so linked sets have as many
    equal ones more; they share one of the first ``parts_of`` in any order of the parts' contents. Parts without
    a shingle, or with frequent ones only, are equal in unlike sets and come last."""
    bands = size_bands(largest, percent)
    shift = np.uint64(64 - RANK_BITS)
    schema = pa.schema([("node", pa.int64()), ("part", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        rank = None if ranks is None else ranks.value
        for batch in batches:
            nodes, parts, members = [], [], []
            for _, s in _sets(batch.column(0), n):
                node = _identity(s)
                if not len(s) or node in sent or not wanted.value.has(np.array([node], np.int64))[0]:
                    continue
                sent.add(node)
                own = int(np.searchsorted(bands, len(s), side="right")) - 1
                for band in (own, own + 1):  # as the larger set of a pair, or as one of the band below it
                    if band + 1 >= len(bands):
                        continue
                    keep = parts_of(band, bands, percent)
                    m = keep + spare_parts(keep)
                    mixed = C.mix(s)
                    of = (mixed % np.uint64(m)).astype(np.int64)
                    order = np.argsort(of, kind="stable")  # s is sorted: a part's shingles are in one order
                    held = np.searchsorted(of[order], np.arange(m + 1))
                    run_ = np.concatenate([[np.uint64(0)], np.cumsum(C.mix(mixed[order]), dtype=np.uint64)])
                    total = run_[held[1:]] - run_[held[:-1]]  # a part's shingles, whatever their order
                    key = C.mix(C.mix(total + np.diff(held).astype(np.uint64)) + np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)
                                + np.arange(m, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
                    often, full = np.full(m, 256), held[1:] > held[:-1]
                    if rank is not None:  # a part is as rare as its rarest shingle
                        often[full] = np.minimum.reduceat(rank[(s[order] >> shift).astype(np.int64)], held[:-1][full])
                    parts.append(key[np.lexsort((key, held[:-1] - held[1:], often))[:keep]].view(np.int64))
                    nodes.append(np.full(keep, node))
                    # a class's set goes with the first of its parts
                    members += [s.view(np.int64) if band == own else None] + [None] * (keep - 1)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(parts)),
                                                  pa.array(members, schema.types[2])], schema=schema)
    return run


# --- deviations from a centre --------------------------------------------------

def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that more than half of some members of a group have, and how many of them; rows are in order of group and share."""
    sets, size, at = [], 0, None

    def taken() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        most = 2 * counts > len(sets)
        rows = int(most.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows, at[0])), pa.array(np.full(rows, at[1])), pa.array(tokens[most]),
                                           pa.array(counts[most])], names=["g", "m", "token", "count"])

    for batch in batches:
        g, m, share, members = (batch.column(k) for k in ("g", "m", "share", "members"))
        for *here, s in zip(g.to_pylist(), m.to_pylist(), share.to_pylist(), members, strict=True):
            if sets and (here != at or size > CENTRE_SHINGLES):
                yield taken()
                sets, size = [], 0
            at = here
            sets.append(s.values.to_numpy())
            size += len(sets[-1])
    if sets:
        yield taken()


_DEVIATION_SCHEMA = "g long, node long, comp long, n long, c int, size int, weight long, tokens array<long>"


def _deviations(ranks: Broadcast, percent: int):
    """What a set lacks of its group's centre and has beyond it, rarest first: as many as a linked set may lack of it, and one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        shift = np.uint64(64 - RANK_BITS)
        for batch in batches:
            col = {k: batch.column(k) for k in batch.schema.names}
            out = {"c": [], "size": [], "weight": [], "tokens": []}
            for n, m, members, centre, held in zip(col["n"].to_pylist(), col["m"].to_pylist(), col["members"], col["centre"],
                                                   col["held"], strict=True):
                s, c = (v.values.to_numpy().view(np.uint64) for v in (members, centre))
                more = s[~np.isin(s, c, assume_unique=True)]
                lacks = ~np.isin(c, s, assume_unique=True)
                less = m - held.values.to_numpy()[lacks]  # members that lack it
                often = np.concatenate([rank[(more >> shift).astype(np.int64)], np.round(6 * np.log2(1 + less))])
                tokens = np.concatenate([more, C.mix(~c[lacks])])
                order = np.lexsort((tokens, often))[:n * (100 - percent) // percent + 1]
                out["c"].append(len(c))
                out["size"].append(len(tokens))
                out["weight"].append(100 * int(lacks.sum()) + percent * len(more))
                out["tokens"].append(tokens[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [col["g"], col["node"], col["comp"], col["n"], pa.array(out["c"], pa.int32()), pa.array(out["size"], pa.int32()),
                 pa.array(out["weight"], pa.int64()), pa.array(out["tokens"], pa.list_(pa.int64()))],
                names=["g", "node", "comp", "n", "c", "size", "weight", "tokens"])
    return run


def _by_deviations(groups: DataFrame, sets: DataFrame, ranks: Broadcast, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of a group's classes (g, node, comp, n) that may link, and pairs that do.

    A group's centre C holds shingles that more than half of its members have (counted where more than half of some
    ``CENTRE_MEMBERS`` have them: what follows holds for any C); D(x) = x ^ C. As x ^ y = D(x) ^ D(y),
    linked sets with a common deviation have one among their first d + 1 in any fixed order, its position in either no
    larger than what that set has beyond the other; near copies deviate by edits of their own, so in a rare-first order few
    share one. Sets without a common one link exactly if ``w(x) + w(y) <= (100 - percent) |C|`` with
    ``w = 100 |C - x| + percent |x - C|``, and any sets with that link; then both link with the
    member of the least w, so a star of these links stands for all of them. The members that share a deviation are a group
    again: paired if they are few, else split once more around their own centre."""
    groups = groups.select("g", "node", "comp", "n", F.lit(0).alias("pos"), F.lit(0).alias("size"))
    pairs = sure = None
    for split in range(SPLITS + 1):
        mixed = (groups.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
                 .where("lo != hi").select("g", "m"))
        groups = C.stage(groups.join(mixed, "g"), "join-groups")
        enough = FEW_SPLIT if split else FEW
        few = groups if split == SPLITS else groups.where(F.col("m") <= enough)
        x, y = few.alias("x"), few.alias("y")
        bound = _bytes_bound(percent, F.col("x.n"), F.col("y.n"))
        apart = F.col("x.size") - F.col("y.size")
        found = (x.join(y, F.col("x.g") == F.col("y.g"))
                 .where((F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
                        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
                        & (2 * F.col("x.pos") <= bound + apart) & (2 * F.col("y.pos") <= bound - apart))
                 .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        pairs = found if pairs is None else pairs.union(found)
        many = groups.where(F.col("m") > enough).select("g", "node", "comp", "n", "m")
        if split == SPLITS or many.isEmpty():
            break
        held = C.stage(many.join(sets, "node"), "join-held")
        share = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / CENTRE_MEMBERS))
        centre = (held.select("g", "m", share.alias("share"), "members").repartition("g", "share").sortWithinPartitions("g", "share")
                  .mapInArrow(_majorities, "g long, m long, token long, count long")
                  .groupBy("g", "m", "token").agg(F.sum("count").alias("count"))
                  .where(2 * F.col("count") > F.col("m"))  # fewer than twice a member's largest set
                  .groupBy("g").agg(F.collect_list(F.struct("token", "count")).alias("centre"))
                  .select("g", F.col("centre.token").alias("centre"), F.col("centre.count").alias("held")))
        none = F.array().cast("array<long>")
        own = C.stage(held.join(centre, "g", "left")
                      .select("g", "node", "comp", "n", "m", "members", F.coalesce("centre", none).alias("centre"),
                              F.coalesce("held", none).alias("held"))
                      .mapInArrow(_deviations(ranks, percent), _DEVIATION_SCHEMA), "join-deviations")
        least = own.groupBy("g").agg(F.min(F.struct("weight", "node", "comp")).alias("least"))
        close = F.col("weight") + F.col("least.weight") <= (100 - percent) * F.col("c")
        own = own.join(least, "g")
        star = own.where(close & (F.col("node") != F.col("least.node"))).select(*_pair(F.col("node"), F.col("least.node")))
        sure = star if sure is None else sure.union(star)
        groups = (own.withColumn("comp", F.when(close, F.col("least.comp")).otherwise(F.col("comp")))
                  .select("g", "node", "comp", "n", "size", F.posexplode("tokens").alias("pos", "token"))
                  .select(F.xxhash64("g", "token").alias("g"), "node", "comp", "n", "pos", "size"))
    return pairs, sure


# --- filters and verification ------------------------------------------------

def _may_link(percent: int, na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Length and positional filter of two postings of one shingle."""
    overlap = F.ceil(percent * (na + nb) / F.lit(100 + percent) - 1e-9)
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & (F.least(na - pa_, nb - pb) >= overlap))


@F.arrow_udf(LongType())
def _difference(a: pa.Array, b: pa.Array) -> pa.Array:
    """Lower bound of the sets' symmetric difference: partition sizes."""
    x = np.frombuffer(b"".join(a.to_pylist()), np.uint16).reshape(-1, PARTS).astype(np.int64)
    y = np.frombuffer(b"".join(b.to_pylist()), np.uint16).reshape(-1, PARTS).astype(np.int64)
    return pa.array(np.abs(x - y).sum(axis=1))


@F.arrow_udf(LongType())
def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two sorted sets."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        out.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
    return pa.array(out, pa.int64())


def _bytes_bound(percent: int, na: Column, nb: Column) -> Column:
    """Largest symmetric difference of linked sets of these sizes."""
    overlap = F.ceil(percent * (na + nb) / F.lit(100 + percent) - 1e-9)
    return na + nb - 2 * overlap


class _Verifier:
    """Verifies class pairs once each on their whole sets."""

    def __init__(self, docs: DataFrame, text: str, classes: DataFrame, n: int, percent: int):
        self.docs, self.text, self.classes, self.n, self.percent = docs, text, classes, n, percent

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with a < b, distinct; returns the linked ones."""
        spark = pairs.sparkSession
        sizes = self.classes.select("node", "n", "parts")
        ends = [sizes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("parts").alias(f"p{k}")) for k in "ab"]
        bound = _bytes_bound(self.percent, F.col("na"), F.col("nb"))
        near = C.stage(pairs.join(ends[0], "a").join(ends[1], "b")
                       .where(_difference("pa", "pb") <= bound).select("a", "b", "na", "nb"), "join-pairs")
        wanted = spark.sparkContext.broadcast(Bloom.of(C.stage(near.select("a").union(near.select("b")).distinct(), "join-ends"), "a"))
        sets = C.stage(self.docs.select(self.text).mapInArrow(_needed_sets(wanted, self.n), "node long, members binary")
                       .groupBy("node").agg(F.first("members").alias("members")), "join-sets")
        sa, sb = (sets.select(F.col("node").alias(k), F.col("members").alias(f"s{k}")) for k in "ab")
        both = near.join(sa, "a").join(sb, "b").withColumn("shared", _shared("sa", "sb"))
        return C.stage(both.where(100 * F.col("shared") >= self.percent * (F.col("na") + F.col("nb") - F.col("shared")))
                       .select("a", "b"), "join-links")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_component(postings: DataFrame, labels: DataFrame) -> DataFrame:
    return (postings.drop("comp").join(labels, "node", "left")
            .withColumn("comp", F.coalesce("root", "node")).drop("root"))


def _mixed(postings: DataFrame) -> DataFrame:
    """Postings of shingles that still join several components, with their hub and number.
    Postings are (token, rank, node) with position and size packed into rank, so
    that the first, by far largest, shuffle carries little more than two hashes;
    without a component column every class is its own component."""
    if "comp" in postings.columns:
        hubs = (postings.groupBy("token").agg(F.min(F.struct("rank", "node", "comp")).alias("hub"),
                                              F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
                .where("lo != hi").drop("lo", "hi"))
    else:  # a set has a shingle once: several postings are several classes
        hubs = (postings.groupBy("token").agg(F.min(F.struct("rank", "node")).alias("hub"), F.count(F.lit(1)).alias("m"))
                .where("m > 1"))
    return postings.join(hubs, "token")


def _unpacked(rank: Column) -> tuple[Column, Column]:
    """(position, size) of a packed rank."""
    return F.shiftright(rank, 32), rank.bitwiseAND(F.lit(0xFFFFFFFF))


def link_components(docs: DataFrame, text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, root) of every row of ``docs``; key
    is the text's hash, root names the component (null: empty set)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", text)
    ranks = spark.sparkContext.broadcast(shingle_ranks(docs, text, n))
    members = C.stage(docs.select("doc_id", text_key(F.col(text)).alias("key"), text).mapInArrow(_describe(ranks, n, percent), _SET_SCHEMA), "join-members")
    classes = C.stage(members.where("n > 0").groupBy("node")
                      .agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts")),
                      "join-classes")
    verify = _Verifier(docs, text, classes, n, percent)
    postings = (classes.select(F.posexplode_outer("prefix").alias("pos", "token"), "n", "node")
                .select("token", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("rank"),
                        "node"))
    done = links = sure = None
    for turn in range(HUB_ROUNDS):
        left = C.stage(_mixed(postings), "join-postings")
        if left.isEmpty():
            break
        (pos, n_), (h_pos, h_n) = _unpacked(F.col("rank")), _unpacked(F.col("hub.rank"))
        component = "comp" if "comp" in left.columns else "node"
        met = (left.where((F.col(component) != F.col(f"hub.{component}")) & _may_link(percent, n_, pos, h_n, h_pos))
               .select(*_pair(F.col("node"), F.col("hub.node"))).distinct())
        if done is not None:
            met = met.join(done, ["a", "b"], "left_anti")
        met = C.stage(met, "join-candidates")
        found = verify(met)
        done = met if done is None else done.union(met)
        links = found if links is None else links.union(found)
        # the hub has met all members of the posting that it could link with
        rest = left.where(F.col("node") != F.col("hub.node")).drop("hub", "m")
        labels = components(links, "a", "b")
        postings = _with_component(rest, labels)
    else:
        left = C.stage(_mixed(postings).drop("hub"), "join-postings")
        if "comp" not in left.columns:
            left = left.withColumn("comp", F.col("node"))
        few = left.where(F.col("m") <= FEW)
        x, y = few.alias("x"), few.alias("y")
        (x_pos, x_n), (y_pos, y_n) = _unpacked(F.col("x.rank")), _unpacked(F.col("y.rank"))
        other = (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
        ends = [F.col("x.node").alias("a"), F.col("y.node").alias("b")]
        rest = (x.join(y, F.col("x.token") == F.col("y.token")).where(other & _may_link(percent, x_n, x_pos, y_n, y_pos))
                .select(*ends))
        many = C.stage(left.where(F.col("m") > FEW).select("node", "comp", F.col("rank").bitwiseAND(F.lit(0xFFFFFFFF)).alias("n"))
                       .distinct(), "join-many")
        largest = many.agg(F.max("n")).first()[0]
        if largest is not None:
            wanted = spark.sparkContext.broadcast(Bloom.of(many.select("node"), "node"))
            held = C.stage(docs.select(text).mapInArrow(_equal_parts(wanted, n, percent, largest, ranks),
                                                        "node long, part long, members array<long>"), "join-parts")
            sets = C.stage(held.where("members IS NOT NULL").groupBy("node").agg(F.first("members").alias("members")), "join-held")
            parts = held.select("node", "part").join(many, "node").select("part", "node", "comp", "n").distinct()
            shared = (parts.groupBy("part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("first"),
                                                F.count(F.lit(1)).alias("m")).where("lo != hi").select("part", "first", "m"))
            met = C.stage(parts.join(shared, "part"), "join-shared")
            equal = met.where(F.col("m") <= FEW_EQUAL)
            x, y = equal.alias("x"), equal.alias("y")
            near = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
            rest = rest.union(x.join(y, F.col("x.part") == F.col("y.part")).where(other & near).select(*ends))
            tied = components(met.where(F.col("m") > FEW_EQUAL), "first", "node").withColumnRenamed("root", "g")
            may, sure = _by_deviations(many.distinct().join(tied, "node"), sets, ranks, percent)
            rest = rest.union(may)
            if sure is not None:
                links = sure if links is None else links.union(sure)
        rest = rest.distinct()
        if done is not None:
            rest = rest.join(done, ["a", "b"], "left_anti")
        rest = C.stage(rest, "join-candidates")
        verified = not rest.isEmpty()
        if verified:
            found = verify(rest)
            links = found if links is None else links.union(found)
        if verified or sure is not None:
            labels = components(links, "a", "b")
    if links is None:
        grouped = members.withColumn("root", F.col("node"))
    else:
        grouped = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = grouped.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"))
    smallest = grouped.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (grouped.join(smallest, "root", "left")
            .select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "root",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_per_group(docs: DataFrame, text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the smallest
    doc_id's (then the smallest text hash's; one of equal rows). Documents with
    an empty set all stay."""
    found = C.stage(link_components(docs, text, n, percent).where("n_shingles > 0").select("doc_id", "key", "root"),
                    "join-groups")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    best = found.groupBy("root").agg(F.min(rank).alias("best"))
    judged = found.join(best, "root").select("doc_id", "key", (rank != F.col("best")).alias("gone"))
    gone = C.stage(judged.where("gone").select("doc_id", "key").distinct(), "join-gone")
    once = (judged.where("NOT gone").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    return without(docs, gone, text, once=C.stage(once, "join-once"))
