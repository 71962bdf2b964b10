"""K1, K4-K8 on stored tables without rewriting them whole.

A table is a Parquet folder partitioned by a hash of its key (``bucket=<n>``). A merge
reads, by partition pruning, only the buckets that its delta's keys fall into, and
overwrites only those (dynamic partition overwrite); a plain append reads nothing. The
accepted rows are first written beside the table: the overwrite then reads plain
files, not the table that it replaces, and a merge that failed can be run again.

Keys are unique (the rules keep them so), so no bucket is hotter than the hash makes
it; the number of buckets is fixed when a table is created. The list of touched buckets,
at most as long as that number, is all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import scratch_path
from . import keyed

BUCKET = "bucket"


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class KeyedTable:
    """A stored table with the columns ``key`` as its unique key."""

    def __init__(self, spark: SparkSession, path: str, schema, key: str | Sequence[str], buckets: int):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        self.key = [key] if isinstance(key, str) else list(key)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str | Sequence[str], order: Sequence[str] = (), buckets: int = 64) -> KeyedTable:
        """Store the first row per key by ``order`` (without an order, by the columns)."""
        table = cls(rows.sparkSession, path, rows.schema, key, buckets)
        rest = [c for c in rows.columns if c not in table.key]
        table.append(keyed.first_per_key(rows, table.key, order or rest).select(*rows.columns))
        return table

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets (other folders are not opened)."""
        columns = [f.name for f in self.schema.fields]
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)
        if touched is not None:
            rows = rows.where(F.col(BUCKET).isin(touched))
        return rows.select(*columns)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, _bucket(self.key, self.buckets))

    def touched(self, delta: DataFrame) -> list[int]:
        return sorted(r[0] for r in delta.select(_bucket(self.key, self.buckets)).distinct().collect())

    def append(self, rows: DataFrame) -> None:
        """K4: add rows; nothing is read."""
        (self._placed(rows.select(*[f.name for f in self.schema.fields])).repartition(BUCKET)
         .write.mode("append").partitionBy(BUCKET).parquet(self.path))

    def insert_if_absent(self, delta: DataFrame, order: Sequence[str]) -> DataFrame:
        """K1/K5: the delta's first row per key that the table lacks; returns the rows
        accepted. Only files are added."""
        accepted = self._beside(keyed.insert_if_absent(delta, self.read(self.touched(delta)), self.key, order))
        self.append(accepted)
        return accepted

    def update(self, delta: DataFrame, fields: Sequence[str], order: Sequence[str] = ()) -> None:
        """K7: set ``fields`` of the keys of ``delta``."""
        self._rewrite(delta, lambda now: keyed.update_by_key(now, delta, self.key, fields, order))

    def upsert(self, delta: DataFrame, fields: Sequence[str], order: Sequence[str]) -> None:
        """K6: set ``fields`` of keys that are there, insert the others' last row."""
        last = keyed.last_per_key(delta, self.key, order)

        def rule(now: DataFrame) -> DataFrame:
            new = last.join(now.select(*self.key), self.key, "left_anti").select(*now.columns)
            return keyed.update_by_key(now, last, self.key, fields).unionByName(new)

        self._rewrite(delta, rule)

    def delete(self, keys: DataFrame) -> None:
        """K8: remove the rows of the keys."""
        self._rewrite(keys, lambda now: keyed.delete_by_key(now, keys, self.key)[0])

    def _beside(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "keyed-merge")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _rewrite(self, delta: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> None:
        touched = self.touched(delta)
        if not touched:
            return
        after = self._beside(self._placed(rule(self.read(touched)).select(*[f.name for f in self.schema.fields])))
        (after.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(self.path))
        # a bucket that lost its last row has nothing to be overwritten with: its folder goes
        left = {r[0] for r in after.select(BUCKET).distinct().collect()}
        for b in set(touched) - left:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
