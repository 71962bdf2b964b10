"""Telling rows of a document table apart and removing some of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import common as C
from .bloom import Bloom


def text_key(text: Column) -> Column:
    """Hash of a text (null counts as empty): with doc_id it names a row; rows equal in both are repeats."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame, text: str = "text", once: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text key) is not in ``gone`` (doc_id,
    key), with all columns; of rows whose name is in ``once`` a single one stays.

    Rows that a Bloom filter of the names lets pass never move; only the rest is
    shuffled, for the exact anti-join."""
    spark = docs.sparkSession
    names = lambda t: t.select(F.col("doc_id").alias("__gone_id"), F.col("key").alias("__gone_key")).distinct()
    gone = names(gone)
    touched = gone if once is None else gone.union(names(once))
    wanted = spark.sparkContext.broadcast(
        Bloom.of(C.stage(touched.select(F.xxhash64("__gone_id", "__gone_key").alias("m")), "rows-touched"), "m"))

    def maybe(m: pa.Array) -> pa.Array:
        return pa.array(wanted.value.has(m.to_numpy(zero_copy_only=False)))

    tested = docs.withColumn("__touched", F.arrow_udf(maybe, BooleanType())(F.xxhash64("doc_id", text_key(F.col(text)))))
    stay = tested.where(~F.col("__touched")).drop("__touched")
    rest = tested.where("__touched").drop("__touched")
    same = lambda t: (t["doc_id"].eqNullSafe(F.col("__gone_id")) & (text_key(t[text]) == F.col("__gone_key")))
    left = rest.join(gone, same(rest), "left_anti")
    if once is None:
        return stay.unionByName(left)
    once = names(once)
    single = left.join(once, same(left), "left_anti")
    repeated = left.join(once, same(left), "left_semi").dropDuplicates(["doc_id", text])
    return stay.unionByName(single).unionByName(repeated)
