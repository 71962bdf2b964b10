"""Merkle fixity audit of WARC replicas.

A replica's records are hashed, the hashes of consecutive offset ranges of an
archive file are hashed in offset order into leaves, and every ``FANOUT`` nodes
into one node above, up to a root per archive. Two replicas are compared at the
roots first; only children of mismatching nodes are looked at on the next level,
and only the records of mismatching ranges are compared in the end. The trees
are written once, so an audit reads a few narrow rows, not the archives.

The content is read in one scan that keeps (offset, length, digest); no step
gathers more than a range's records or a node's children.

Defined cases: null contents count as empty; several records at one offset are
taken as one whose digest covers them all, whatever their order, so repeated
rows must repeat in both replicas; records without archive or offset cannot be
placed and are reported apart by ``unplaced``; an archive that only one replica
has is reported record by record; empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

RANGE_BYTES = 1 << 16
FANOUT = 16


# --- records -----------------------------------------------------------------

def warc_record(url: Column, body: Column) -> Column:
    """A WARC response record as text (UTF-8 when hashed or measured)."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
                    F.lit("\r\n\r\n"))


def fingerprints(records: DataFrame, content: str = "content") -> DataFrame:
    """(archive, offset, length, digest) of records (archive, offset, content)."""
    value = F.coalesce(F.col(content), F.lit(""))
    return records.select("archive", F.col("offset").cast("long"), F.octet_length(value).cast("long").alias("length"),
                          F.sha2(value, 256).alias("digest"))


def unplaced(records: DataFrame) -> DataFrame:
    return records.where("archive IS NULL OR offset IS NULL")


# --- trees -------------------------------------------------------------------

def _by_offset(prints: DataFrame) -> DataFrame:
    """One row per offset; a digest over all records that claim it."""
    one = F.count(F.lit(1)) == 1
    claims = F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.min("digest"), F.max("digest"),
                                F.sum(F.xxhash64("digest", "length").cast("decimal(20,0)"))), 256)
    return (prints.where("archive IS NOT NULL AND offset IS NOT NULL").groupBy("archive", "offset")
            .agg(F.sum("length").alias("length"), F.when(one, F.min("digest")).otherwise(claims).alias("digest")))


def depth(prints: DataFrame) -> int:
    """Levels above the ranges until every archive has one node."""
    last = prints.agg(F.max("offset")).first()[0] or 0
    ranges, levels = last // RANGE_BYTES + 1, 0
    while ranges > 1:
        ranges = -(-ranges // FANOUT)
        levels += 1
    return levels


def build_tree(prints: DataFrame, levels: int) -> list[DataFrame]:
    """[(archive, offset, length, digest) by offset, then (archive, node, digest)
    from the ranges up to the roots], each written to the shared folder."""
    records = C.stage(_by_offset(prints), "fixity-records")
    entry = F.struct("offset", "length", "digest")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(entry)),
                                      lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"])), ";")
    tree = [records, C.stage(records.groupBy("archive", F.expr(f"offset DIV {RANGE_BYTES}").alias("node"))
                             .agg(F.sha2(joined, 256).alias("digest")), "fixity-ranges")]
    for _ in range(levels):
        child = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))),
                                         lambda r: F.concat_ws(":", r["node"], r["digest"])), ";")
        tree.append(C.stage(tree[-1].groupBy("archive", F.expr(f"node DIV {FANOUT}").alias("node"))
                            .agg(F.sha2(child, 256).alias("digest")), "fixity-level"))
    return tree


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, node) on which the trees do not agree: not two equal digests."""
    return (a.unionByName(b).groupBy("archive", "node")
            .agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
            .where("n != 2 OR lo != hi").select("archive", "node"))


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(archive, offset, length_a, length_b, status) of every record on which two
    trees of equal depth differ. Status: corrupt (same length), resized, missing
    (only in a) or extra (only in b)."""
    wrong = _differing(a[-1], b[-1])
    for level in range(len(a) - 2, 0, -1):
        below = lambda nodes: (nodes.withColumn("up", F.expr(f"node DIV {FANOUT}"))
                               .join(wrong.select("archive", F.col("node").alias("up")), ["archive", "up"], "left_semi")
                               .drop("up"))
        wrong = C.stage(_differing(below(a[level]), below(b[level])), "fixity-wrong")
    inside = lambda records: (records.withColumn("node", F.expr(f"offset DIV {RANGE_BYTES}"))
                              .join(wrong, ["archive", "node"], "left_semi"))
    side = lambda records, s: inside(records).select("archive", "offset", F.col("length").alias(f"length_{s}"),
                                                     F.col("digest").alias(f"digest_{s}"))
    both = side(a[0], "a").join(side(b[0], "b"), ["archive", "offset"], "full")
    status = (F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra")
              .when(F.col("length_a") == F.col("length_b"), "corrupt").otherwise("resized"))
    return (both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
            .select("archive", "offset", "length_a", "length_b", status.alias("status")))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Audit two replicas, given as fingerprints (archive, offset, length, digest)."""
    levels = max(depth(a), depth(b))
    return audit(build_tree(a, levels), build_tree(b, levels))


# --- replicas derived from a page table --------------------------------------

def page_archives(pages: DataFrame, per_archive: int = 256) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of two replicas of a page table packed into WARC files of
    ``per_archive`` consecutive page ids, the second with damage by page_id mod
    97: 0 has its first character changed, 1 lost its second half, 2 is missing.
    Equal rows are one record; pages without an id are spread over 1024 files."""
    html = F.coalesce("html", F.lit(""))
    damage = F.col("page_id") % 97
    first = F.when(F.substring(html, 1, 1) == "#", "!").otherwise("#")
    spoiled = (F.when(damage == 0, F.concat(first, F.substring(html, 2, 1 << 30)))
               .when(damage == 1, F.substring(html, F.lit(1), (F.char_length(html) / 2).cast("int"))).otherwise(html))
    good, bad = warc_record(F.col("url"), html), warc_record(F.col("url"), spoiled)
    nowhere = F.concat(F.lit("pages-none-"), F.pmod(F.xxhash64("url", html), F.lit(1024)))
    rows = pages.select(
        "page_id", F.when(F.col("page_id").isNull(), nowhere)
        .otherwise(F.concat(F.lit("pages-"), F.floor(F.col("page_id") / per_archive))).alias("archive"),
        F.octet_length(good).cast("long").alias("length"), F.sha2(good, 256).alias("digest"),
        F.octet_length(bad).cast("long").alias("length_b"), F.sha2(bad, 256).alias("digest_b"),
        F.coalesce(damage == 2, F.lit(False)).alias("lost")).distinct()
    # a file holds per_archive ids: its records are few
    order = Window.partitionBy("archive").orderBy("page_id", "digest", "digest_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = C.stage(rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))), "fixity-pages")
    return (placed.select("archive", "offset", "length", "digest"),
            placed.where("NOT lost").select("archive", "offset", F.col("length_b").alias("length"),
                                            F.col("digest_b").alias("digest")))
