"""Final URLs behind chains of redirects.

A crawl logs one hop at a time (requested URL, location). Chains are resolved by
pointer jumping: every round each URL takes over the target of its target, so a chain of
n hops needs log2(n) rounds, each a join of two stored tables (a target that very many
URLs share is split by AQE). A URL that leads into a circle never reaches an end. While any
other is open, some URL of its chain ends in the next round; so after a round in which none
did, all that are open lead into circles, and they have no final URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "redirects")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def final_urls(hops: DataFrame, url: str = "url", target: str = "target") -> DataFrame:
    """(url, final_url, hops) of every URL that redirects: final_url is NULL, and hops too, where
    the chain runs in a circle. Of several targets of a URL the smallest counts; rows with a NULL in
    either column are no redirects."""
    step = _stored(hops.where(F.col(url).isNotNull() & F.col(target).isNotNull())
                   .groupBy(F.col(url).alias("url")).agg(F.min(target).alias("target")))
    ended = step.join(step.select(F.col("url").alias("target")), "target", "left_anti")
    done = _stored(ended.select("url", "target", F.lit(1).cast("long").alias("hops")))
    open_ = _stored(step.join(step.select(F.col("url").alias("target")), "target", "left_semi")
                    .select("url", "target", F.lit(1).cast("long").alias("hops")))
    while not open_.isEmpty():
        # a target that has ended brings its end, one that is open the place it has got to
        known = _stored(done.select(F.col("url").alias("target"), F.col("target").alias("next"), F.col("hops").alias("more"), F.lit(True).alias("end"))
                        .unionByName(open_.select(F.col("url").alias("target"), F.col("target").alias("next"),
                                                  F.col("hops").alias("more"), F.lit(False).alias("end"))))
        moved = _stored(open_.join(known, "target").select("url", F.col("next").alias("target"), (F.col("hops") + F.col("more")).alias("hops"), "end"))
        done = done.unionByName(moved.where("end").drop("end"))
        open_ = moved.where("NOT end").drop("end")
        if moved.where("end").isEmpty():
            break
    none = F.lit(None)
    return (done.withColumnRenamed("target", "final_url")
            .unionByName(open_.select("url", none.cast("string").alias("final_url"), none.cast("long").alias("hops"))))


def with_final(requests: DataFrame, hops: DataFrame, url: str = "url") -> DataFrame:
    """``requests`` with ``final_url`` (their own URL where it does not redirect) and ``looped``."""
    found = final_urls(hops).select(F.col("url").alias("_url"), F.col("final_url").alias("_final"), F.lit(True).alias("_moved"))
    joined = requests.join(found, F.col(url) == F.col("_url"), "left")
    moved = F.coalesce("_moved", F.lit(False))
    return (joined.withColumn("final_url", F.when(moved, F.col("_final")).otherwise(F.col(url)))
            .withColumn("looped", moved & F.col("_final").isNull()).drop("_url", "_final", "_moved"))
