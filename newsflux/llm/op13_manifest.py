"""Merkle dataset manifest: a content-addressed DAG of digests and proofs from it.

Every document is hashed to a leaf; the leaves of a source, in order of doc_id,
are hashed in runs of ``FANOUT`` up to the source's subroot, and the subroots, in
order of source, up to the root. The DAG is stored as records (height, digest,
children): equal subtrees are one record. A proof is found by descent: the roots
ask for their record, the digits of a leaf's rank choose a child on each level,
the children not chosen are collected as the level's segment (those left and
those right of the choice), and in the end the segments are reversed, so that
they run from the leaf to the root. All leaves below one node share its descent,
so a level moves as many rows as it has nodes.

Ranks come from a range partitioning with offsets per partition, so a source
with most of the rows is spread over tasks; ``BLOCK`` consecutive leaves are
hashed in one row, which is all that is ever gathered.

Defined cases: null fields are hashed as ``-``, so a null text differs from an
empty one; a null source is a source of its own, the first; rows without doc_id
come first in their source; rows of one doc_id are ordered by their leaf, and
equal rows are leaves of their own; a single leaf is its own subroot, a single
subroot is the root; an empty table gives an empty result; other columns are not
read; texts are hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflux.session import scratch_path

from . import common as C

FANOUT = 3
LEVELS = 6
BLOCK = FANOUT ** LEVELS
_SEGMENTS = "array<struct<left: binary, right: binary>>"
#: Levels of a descent that are planned together before the rows are written.
_PLANNED = 3


# --- leaves ------------------------------------------------------------------

def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """Digest of a row of documents whose text is ``text``."""
    fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*fields, _field(text)), 256))


def tampered(text: Column) -> Column:
    """The text without line breaks where 2 divides crc32 of the doc_id, else the text."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, offered) of every row, in one scan: ``offered`` is the
    leaf of the row as a reader finds it, the tampered one where there is one."""
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), leaf(tampered(F.col("text"))).alias("offered"))


def _numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Add ``rank``, the row's place by ``order`` (nulls first), from 0. Equal rows
    take any order among them, by where they stand, so they are no hot group."""
    spark = df.sparkSession
    by = [F.col(c).asc_nulls_first() for c in (*order, "__row")]
    placed = C.stage(df.withColumn("__row", F.monotonically_increasing_id())
                     .repartitionByRange(C.shuffle_width(spark), *by).sortWithinPartitions(*by).drop("__row")
                     .withColumn("__at", F.monotonically_increasing_id()), name)
    part, inside = F.expr("shiftright(__at, 33)"), F.expr("__at & 8589934591")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("__part")).count()  # one row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return (placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
            .withColumn("rank", F.col("__start") + inside).drop("__part", "__start", "__at"))


# --- building ----------------------------------------------------------------

@dataclass
class Manifest:
    """leaves (doc_id, leaf, offered, tree, rank), sources (source, tree, n, depth,
    subroot), the records of both parts of the DAG, and the root."""

    leaves: DataFrame
    sources: DataFrame
    below: DataFrame
    above: DataFrame
    root: bytes | None


def _depth(n: Column) -> Column:
    """Levels above n nodes."""
    powers = F.array(*[F.lit(FANOUT ** k).cast("long") for k in range(39)])
    return F.size(F.filter(powers, lambda p: p < n))


def _above(nodes: str) -> str:
    return (f"transform(sequence(0, cast((size({nodes}) - 1) div {FANOUT} as int)), i -> unhex(sha2(array_join("
            f"transform(slice({nodes}, i * {FANOUT} + 1, {FANOUT}), c -> lower(hex(c))), ''), 256)))")


def _hash_up(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of nodes (tree, rank, digest, depth): records (height, digest, children) and
    roots (tree, root). ``depth`` is the number of levels above the tree's nodes."""
    spark, records, roots, height = nodes.sparkSession, [], [], 0
    while True:
        grouped = (nodes.groupBy("tree", F.expr(f"rank DIV {BLOCK}").alias("block"))
                   .agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"), F.max("depth").alias("depth"))
                   .select("tree", "block", "depth", F.col("run.digest").alias("l0")))
        for k in range(1, LEVELS + 1):
            grouped = grouped.withColumn(f"l{k}", F.expr(f"CASE WHEN depth >= {k} THEN {_above(f'l{k - 1}')} END"))
        grouped = C.stage(grouped, f"{name}-blocks")
        for k in range(1, LEVELS + 1):
            one = (f"transform(sequence(0, size(l{k}) - 1), i -> struct({height + k} as height, l{k}[i] as digest, "
                   f"slice(l{k - 1}, i * {FANOUT} + 1, {FANOUT}) as children))")
            records.append(grouped.where(f"l{k} IS NOT NULL").select(F.explode_outer(F.expr(one)).alias("r")).select("r.*"))
        firsts = F.array(*[F.expr(f"get(l{k}, 0)") for k in range(LEVELS + 1)])
        roots.append(grouped.where(f"depth <= {LEVELS}").select("tree", F.get(firsts, F.col("depth")).alias("root")))
        nodes = grouped.where(f"depth > {LEVELS}").select(
            "tree", F.col("block").alias("rank"), F.expr(f"l{LEVELS}[0]").alias("digest"), (F.col("depth") - LEVELS).alias("depth"))
        height += LEVELS
        if nodes.isEmpty():
            break
    path = scratch_path(spark, f"{name}-records")
    (reduce(DataFrame.unionByName, records).dropDuplicates(["height", "digest"])
     .write.partitionBy("height").parquet(path))
    stored = spark.read.schema("digest binary, children array<binary>, height int").parquet(path)
    return stored, reduce(DataFrame.unionByName, roots)


def build(docs: DataFrame) -> Manifest:
    """Hash a document table (doc_id, source, lang, n_chars, text) into a manifest."""
    ranked = _numbered(C.stage(leaves(docs), "manifest-leaves"), "manifest-order", "source", "doc_id", "leaf")
    counted = ranked.groupBy("source").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    sources = C.stage(_numbered(C.stage(counted, "manifest-sources"), "manifest-sources", "source")
                      .withColumnRenamed("rank", "tree").withColumn("depth", _depth(F.col("n"))), "manifest-sources")
    placed = ranked.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    placed = C.stage(placed.select("doc_id", "leaf", "offered", "tree", (F.col("rank") - F.col("first")).alias("rank"), "depth"),
                     "manifest-placed")
    below, subroots = _hash_up(placed.select("tree", "rank", F.col("leaf").alias("digest"), "depth"), "manifest-below")
    sources = C.stage(sources.drop("first").join(subroots.withColumnRenamed("root", "subroot"), "tree"), "manifest-subroots")
    top = sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("subroot").alias("digest"),
                         F.lit(sources.count()).cast("long").alias("n"))
    above, root = _hash_up(top.withColumn("depth", _depth(F.col("n"))).drop("n"), "manifest-above")
    found = root.first()
    return Manifest(placed.drop("depth"), sources, below, above, bytes(found["root"]) if found else None)


# --- descent -----------------------------------------------------------------

def _segment(digit: str) -> Column:
    """The children beside the one at ``digit``, as raw digests left and right of it."""
    joined = lambda part: f"aggregate({part}, X'', (a, c) -> concat(a, c))"
    return F.expr(f"named_struct('left', {joined(f'slice(children, 1, {digit})')}, "
                  f"'right', {joined(f'slice(children, {digit} + 2, {FANOUT})')})")


def descend(records: DataFrame, roots: DataFrame, wanted: DataFrame, all_wanted: bool = True) -> DataFrame:
    """Add to the rows of ``wanted`` (tree, rank, ...) their ``path``, segments from
    the root down, and the digest ``top`` of their tree. ``roots`` are (tree, depth,
    digest, path), with the segments above them. If not ``all_wanted``, branches that lead
    to no wanted leaf are left on every level."""
    deepest = roots.agg(F.max("depth")).first()[0] or 0
    roots = roots.select("tree", "depth", F.lit(0).cast("long").alias("pos"), "digest", F.col("digest").alias("top"), "path")
    front = roots.where("false").drop("depth")
    for height in range(deepest, 0, -1):
        front = front.unionByName(roots.where(F.col("depth") == height).drop("depth"))
        if not all_wanted:
            led = wanted.select("tree", F.expr(f"rank DIV {FANOUT ** height}").alias("pos")).distinct()
            front = front.join(led, ["tree", "pos"], "left_semi")
        front = front.join(records.where(F.col("height") == height).drop("height"), "digest")
        if height == 1:
            break
        front = (front.select("tree", "pos", "top", "path", "children", F.posexplode("children").alias("digit", "child"))
                 .select("tree", (F.col("pos") * FANOUT + F.col("digit")).alias("pos"), F.col("child").alias("digest"), "top",
                         F.array_append("path", _segment("digit")).alias("path")))
        if height % _PLANNED == 0:
            front = C.stage(front, "manifest-front")
    if deepest == 0:
        front = front.withColumn("children", F.lit(None).cast("array<binary>"))
    single = roots.where("depth = 0").drop("depth").withColumn("children", F.lit(None).cast("array<binary>"))
    runs = front.drop("digest").unionByName(single.drop("digest"))
    asked = wanted.withColumn("pos", F.expr(f"rank DIV {FANOUT}")).withColumn("digit", F.expr(f"cast(rank % {FANOUT} as int)"))
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.array_append("path", _segment("digit")))
    return asked.join(runs, ["tree", "pos"]).withColumn("path", path).drop("pos", "digit", "children")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its segments (root first) lead to, as hex text."""
    step = lambda h, s: F.sha2(F.concat(_hex(s["left"]), h, _hex(s["right"])), 256)
    return F.aggregate(F.reverse(path), _hex(leaf), step)


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, offered, top (the subroot) and path of every leaf, or of those in ``wanted``
    (rows of ``manifest.leaves``)."""
    spark: SparkSession = manifest.leaves.sparkSession
    start = spark.createDataFrame([(0, manifest.root, [])] if manifest.root else [],
                                  f"tree long, digest binary, path {_SEGMENTS}")
    start = start.withColumn("depth", _depth(F.lit(manifest.sources.count()).cast("long")))
    asked = manifest.sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "depth", "subroot")
    reached = descend(manifest.above, start, asked).select(F.col("rank").alias("tree"), "depth", F.col("subroot").alias("digest"),
                                                           "path")
    return descend(manifest.below, C.stage(reached, "manifest-paths"), manifest.leaves if wanted is None else wanted,
                   wanted is None)


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    made = build(docs)
    root = F.lit(made.root.hex() if made.root else None).cast("string")
    beside = F.transform(F.reverse("path"), lambda s: F.concat(_hex(s["left"]), _hex(s["right"])))
    return (prove(made).select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("top")).alias("subroot"),
                               root.alias("root"), F.sha2(F.array_join(beside, ""), 256).alias("proof_sha256"),
                               folded(F.col("offered"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
