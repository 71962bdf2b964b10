"""Exact personalised ranking without scoring all pairs.

A reader's vector is the sum of the vectors of the last articles read; articles are
ranked for the reader by the cosine with it. Articles lie in inverted lists round
k-means centres. The angle between reader and centre, less the largest angle
between the centre and an article of the list, bounds every cosine in the list, so
lists are visited in order of their bounds, one at first and ``GROWTH`` times as many each
round, until no list that is left can reach the reader's k-th best cosine: the
result is that of scoring everything. How many pairs that spares depends on
how far the articles keep to their centres (vectors without any structure spare
none).

Centres are fitted on a bounded sample (``SAMPLE_ROWS``); every article is in a
list. Only the centres (``MAX_LISTS`` at most) are sent to the tasks. Readers and
lists meet in blocks of ``BLOCK_ROWS`` articles (several lists, or a part of one) and chunks of ``CHUNK_ROWS`` readers.

Defined cases: articles and readers without a vector, with a NULL or not finite
component, a length other than the commonest or no direction (all zeros) take
no part; of rows that share an id one counts; equal cosines (to nine decimals)
go to the smaller id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, scratch_path

SAMPLE_ROWS = 20_000
MAX_LISTS = 1024
BLOCK_ROWS = 1 << 15
CHUNK_ROWS = 1 << 14
#: Cosines that a task holds at once, and of those computed in double precision.
CELLS = 1 << 20
VISIT_ROWS = 1 << 12
#: How many times as many lists a round visits as the round before.
GROWTH = 16
_SLACK = 1e-9


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unit(rows: DataFrame, key: str, size: int | None = None) -> tuple[DataFrame, int]:
    """One row per key with its vector scaled to length 1 as ``unit`` (binary doubles)."""
    v = F.transform("vector", lambda x: x.cast("double"))
    fine = F.coalesce(F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False))
    rows = rows.where(F.col(key).isNotNull() & fine)
    if size is None:
        common = rows.groupBy(F.size("vector").alias("s")).count().orderBy(F.desc("count"), "s").first()
        size = common["s"] if common else 0
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = (rows.where(F.size("vector") == size).withColumn("vector", v).withColumn("_length", length)
            .where(F.col("_length") > 0))

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array, lengths: pa.Array) -> pa.Array:
        m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), size) / lengths.to_numpy()[:, None]
        return pa.array([x.tobytes() for x in m], pa.binary())

    return rows.withColumn("unit", pack("vector", "_length")).drop("vector", "_length"), size


def _matrix(blobs: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), float).reshape(-1, size)


def user_vectors(reads: DataFrame, articles: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(user, vector, seen): the sum of the vectors of a reader's reads (a capped history, so few
    rows) and the ids read."""
    read = reads.select(user, item, "pos").join(articles.select(item, "vector"), item)
    # vectors are moved as they are and summed as doubles
    total = lambda vs: F.aggregate(F.slice(vs, 2, F.size(vs)), F.transform(F.get(vs, F.lit(0)), lambda x: x.cast("double")),
                                   lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return (read.groupBy(user)
            .agg(F.sort_array(F.collect_list(F.struct("pos", F.col("vector").alias("v")))).alias("h"),
                 F.array_sort(F.collect_set(item)).alias("seen"))
            .select(user, total(F.col("h.v")).alias("vector"), "seen"))


def centres(units: DataFrame, size: int, lists: int | None = None, seed: int = 7) -> np.ndarray:
    """k-means centres as unit vectors, of a sample of the rows with the smallest hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    n = units.count()
    lists = min(lists or max(1, round(n ** 0.5)), MAX_LISTS, max(n, 1))
    if n == 0:
        return np.zeros((0, size))

    @F.arrow_udf("array<double>")
    def unpack(blobs: pa.Array) -> pa.Array:
        return pa.array(list(_matrix(blobs, size)), pa.list_(pa.float64()))

    sample = units.orderBy(F.xxhash64("unit")).limit(SAMPLE_ROWS).select(array_to_vector(unpack("unit")).alias("features"))
    found = KMeans(k=lists, seed=seed, maxIter=10).fit(_stored(sample, "ranking-sample")).clusterCenters()
    c = np.array(found).reshape(-1, size)
    norm = np.linalg.norm(c, axis=1)
    return c[norm > 0] / norm[norm > 0, None] if (norm > 0).any() else np.eye(1, size)


def inverted_lists(units: DataFrame, item: str, c: np.ndarray) -> DataFrame:
    """(item, unit, list, angle): every article in the list of its nearest centre."""
    size = c.shape[1]

    @F.arrow_udf("struct<list: int, angle: double>")
    def nearest(blobs: pa.Array) -> pa.Array:
        cos = _matrix(blobs, size) @ c.T
        at = cos.argmax(axis=1)
        angle = np.arccos(np.clip(cos[np.arange(len(at)), at], -1, 1))
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(angle)], names=["list", "angle"])

    return units.select(item, "unit", nearest("unit").alias("n")).select(item, "unit", "n.*")


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... of each length, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _pairs_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of the lists of a column, without NULLs."""
    lists = column.combine_chunks()
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    fine = flat.is_valid().to_numpy(zero_copy_only=False)
    return of[fine], np.array(flat.drop_null().to_pylist() or [], None if fine.any() else int)


def _first_of_each(reader: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each reader's (reader, place of the item by id, score), best first."""
    order = np.lexsort((at, -score, reader))
    reader = reader[order]
    begin = np.flatnonzero(np.concatenate([[True], reader[1:] != reader[:-1]]))[:len(reader)]
    rank = _counted(np.diff(np.append(begin, len(reader))))
    order = order[rank < k]
    return reader[rank < k], at[order], score[order]


def best_of_block(left: pa.Table, right: pa.Table, size: int, k: int, item: str, user: str) -> pa.Table:
    """(user, item, score): the k best items of ``left`` for every reader of ``right``, of the lists that the
    reader asks for (``list`` there, ``lists`` here; without these columns, of all), and at least about ``kth`` if given.
    ``CELLS`` cosines are held at once, in single precision; those that may be among the best, given its error, are
    computed anew in double precision."""
    if not (left.num_rows and right.num_rows):
        return pa.table({user: right[user].slice(0, 0), item: left[item].slice(0, 0), "score": pa.array([], pa.float64())})
    of = np.array(left[item].to_pylist())
    kind = left["list"].to_numpy() if "list" in left.column_names else np.zeros(len(of), int)
    order = np.lexsort((of, kind))
    items, of, kind = _matrix(left["unit"], size)[order], of[order], kind[order]
    readers = _matrix(right["unit"], size)
    items_, readers_ = items.astype(np.float32), readers.astype(np.float32)
    margin = 1e-9 + (size + 8) * 2.0 ** -23
    least = np.full(len(readers), -np.inf)
    if "kth" in right.column_names:
        least = np.nan_to_num(right["kth"].to_numpy().astype(float), nan=-np.inf)
    sorted_ = np.argsort(of, kind="stable")  # places by id
    rank = np.empty(len(of), int)
    rank[sorted_] = np.arange(len(of))
    # what readers have seen, in order of places
    who, ids = _pairs_of(right["seen"])
    begin, end = (np.searchsorted(of[sorted_], ids, side=x) if len(ids) else ids.astype(int) for x in ("left", "right"))
    place = np.repeat(begin, end - begin) + _counted(end - begin)
    who, at = np.repeat(who, end - begin), sorted_[place]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    # who asks for which list
    cuts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]])
    wanted = np.ones((len(readers), len(cuts) - 1), bool)
    if "lists" in right.column_names:
        wanted[:] = False
        ask, lists = _pairs_of(right["lists"])
        place = np.searchsorted(kind[cuts[:-1]], lists)
        here = np.append(kind[cuts[:-1]], -1)[place] == lists
        wanted[ask[here], place[here]] = True
    best = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    waiting, more = [], 0

    def settle() -> None:
        nonlocal best, more
        best = _first_of_each(*(np.concatenate(x) for x in zip(best, *waiting, strict=True)), k)
        waiting.clear()
        more = 0
        full = np.flatnonzero(np.diff(np.concatenate([best[0], [-1]])) != 0)
        full = full[(full >= k - 1)]
        full = full[best[0][full - k + 1] == best[0][full]]
        least[best[0][full]] = np.maximum(least[best[0][full]], best[2][full])

    for n, (begin, end) in enumerate(itertools.pairwise(cuts)):
        some = np.flatnonzero(wanted[:, n])
        step = max(1, CELLS // (end - begin))
        first, last = np.searchsorted(at, [begin, end])
        row = np.full(len(readers), -1)
        for part in np.split(some, range(step, len(some), step)) if len(some) else []:
            score = readers_[part] @ items_[begin:end].T
            row[part] = np.arange(len(part))
            known = row[who[first:last]]
            score[known[known >= 0], at[first:last][known >= 0] - begin] = -np.inf
            row[part] = -1
            bound = least[part] - margin
            new = np.flatnonzero(bound == -np.inf)
            if len(new) and end - begin > k:
                kth = np.partition(score[new], end - begin - k, axis=1)[:, end - begin - k]
                bound[new] = kth - 2 * margin
            # never more than the bound in double precision asks for; seen ones are out
            reader, place = np.divmod(np.flatnonzero(score >= np.maximum(bound, -2).astype(np.float32)[:, None] - np.float32(1e-6)), end - begin)
            reader, place = part[reader], place + begin
            waiting.append((reader, rank[place], np.concatenate(
                [np.round(np.einsum("ij,ij->i", readers[reader[i:i + VISIT_ROWS]], items[place[i:i + VISIT_ROWS]]), 9)
                 for i in range(0, len(reader), VISIT_ROWS)] or [np.zeros(0)])))
            more += len(reader)
            if more > CELLS // 4:
                settle()
    settle()
    return pa.table({user: right[user].take(pa.array(best[0])), item: pa.array(of[sorted_][best[1]], left.schema.field(item).type),
                     "score": pa.array(best[2], pa.float64())})


def topk(articles: DataFrame, readers: DataFrame, k: int = 10, item: str = "item_id", user: str = "user_id",
         lists: int | None = None) -> DataFrame:
    """(user, pos, item, score, n_scored) for ``articles`` (item, vector) and ``readers`` (user,
    vector, seen): the k articles of highest cosine that are not in ``seen``. ``n_scored``
    is the number of articles that were scored for the reader."""
    spark = articles.sparkSession
    bound_batches(spark)
    units, size = _unit(articles.dropDuplicates([item]).select(item, "vector"), item)
    c = centres(units, size, lists)
    stored = _stored(inverted_lists(units, item, c), "ranking-lists")
    sizes = {r["list"]: (r["n"], r["angle"]) for r in  # one row per list
             stored.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect()}
    used = np.array(sorted(sizes), int)
    radius = np.array([sizes[i][1] for i in used])
    counts = np.array([sizes[i][0] for i in used])
    # lists are packed into groups of BLOCK_ROWS articles, so that a reader goes to groups; a larger list is one of several blocks
    group, held = np.zeros(len(used), int), []
    for i, n in enumerate(counts.tolist()):
        if not held or held[-1] + n > BLOCK_ROWS:
            held.append(0)
        held[-1] += n
        group[i] = len(held) - 1
    of_list = F.create_map(*[F.lit(int(x)) for pair in zip(used, group, strict=True) for x in pair]) if len(used) else None
    blocks = F.create_map(*[F.lit(int(x)) for i, n in enumerate(held) for x in (i, -(-n // BLOCK_ROWS))]) if len(used) else None
    who, _ = _unit(readers.dropDuplicates([user]).select(user, "vector", F.coalesce("seen", F.array().cast("array<long>")).alias("seen")),
                   user, size)
    who = _stored(who.select(user, "unit", "seen"), "ranking-readers")
    best = who.select(user, F.lit(None).cast("long").alias(item), F.lit(None).cast("double").alias("score")).where("false")
    if not len(used):
        return best.select(user, F.lit(0).alias("pos"), item, "score", F.lit(0).cast("long").alias("n_scored"))
    stored = stored.withColumn("group", F.try_element_at(of_list, F.col("list")))
    stored = stored.withColumn("block", F.pmod(F.xxhash64(item), F.try_element_at(blocks, F.col("group"))).cast("int"))
    sent = spark.sparkContext.broadcast((c[used], radius, used, counts, group))
    user_type, item_type = readers.schema[user].dataType.simpleString(), articles.schema[item].dataType.simpleString()
    done, step, scored = 0, 1, who.select(user, F.lit(0).cast("long").alias("n"))
    while done < len(used):
        # the lists at places done..done + step in the order of a reader's bounds that may still matter
        last = Window.partitionBy(user).orderBy(F.desc("score"), item)
        kth = (best.withColumn("r", F.row_number().over(last)).where(F.col("r") == k)
               .select(user, F.col("score").alias("kth")))

        def visits(batches, done=done, step=step):
            near, radii, used, counts, group = sent.value
            for b in batches:
                angle = np.arccos(np.clip(_matrix(b.column(1), size) @ near.T, -1, 1))
                bound = np.cos(np.maximum(angle - radii, 0))
                kth_ = b.column(2).fill_null(-2.0).to_numpy(zero_copy_only=False)
                order = np.argsort(-bound, axis=1, kind="stable")[:, done:done + step]
                rows, cols = np.nonzero(np.take_along_axis(bound, order, 1) >= kth_[:, None] - _SLACK)
                lists = order[rows, cols]
                by = np.lexsort((lists, group[lists], rows))  # a row for each reader and group of lists
                rows, lists = rows[by], lists[by]
                key = rows * (len(used) + 1) + group[lists]
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[:len(key)]
                of = pa.array(rows[begin])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(of), b.column(2).take(of), pa.array(group[lists[begin]], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(np.append(begin, len(key)), pa.int32()), pa.array(used[lists], pa.int32())),
                     pa.array(np.add.reduceat(counts[lists], begin) if len(begin) else [], pa.int64())],
                    names=[user, "kth", "group", "lists", "n"])

        asked = _stored(who.join(kth, user, "left").select(user, "unit", "kth")
                        .mapInArrow(visits, f"{user} {user_type}, kth double, group int, lists array<int>, n long"), "ranking-visits")
        asks = {r["group"]: r["n"] for r in asked.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per group
        if not asks:
            break
        chunks = F.create_map(*[F.lit(int(x)) for i, n in asks.items() for x in (i, -(-n // CHUNK_ROWS))])
        readers_ = (asked.drop("n").join(who, user)
                    .withColumn("chunk", F.pmod(F.xxhash64(user), F.try_element_at(chunks, F.col("group"))).cast("int"))
                    .withColumn("block", F.explode(F.sequence(F.lit(0), F.try_element_at(blocks, F.col("group")) - 1))))
        items_ = (stored.drop("angle").where(F.try_element_at(chunks, F.col("group")).isNotNull())
                  .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.try_element_at(chunks, F.col("group")) - 1))))

        def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
            return best_of_block(left, right, size, k, item, user)

        keys = ["group", "block", "chunk"]
        found = (items_.groupBy(*keys).cogroup(readers_.groupBy(*keys))
                 .applyInArrow(meet, f"{user} {user_type}, {item} {item_type}, score double"))
        best = _stored(best.unionByName(found).withColumn("pos", F.row_number().over(last)).where(F.col("pos") <= k).drop("pos"),
                       "ranking-best")
        scored = scored.unionByName(asked.select(user, "n"))
        done, step = done + step, step * GROWTH
    pos = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("score"), item))
    return (best.withColumn("pos", pos)
            .join(scored.groupBy(user).agg(F.sum("n").alias("n_scored")), user).select(user, "pos", item, "score", "n_scored"))
