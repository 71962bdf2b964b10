"""Keyed tables as versioned Parquet snapshots in the shared folder.

A keyed write (K1, K5-K8) produces the table's next state as a DataFrame;
``commit`` writes it as a new ``version=<n>`` folder under
``spark.checkpoint.dir`` (or a given base) and returns it read back, which
also cuts the lineage. Readers see the newest complete version; a failed
write leaves no ``_SUCCESS`` marker and is never the newest one.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def _base(spark: SparkSession, base: str | None) -> str:
    return base or ensure_checkpoint_dir(spark)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def versions(spark: SparkSession, table: str, base: str | None = None) -> list[int]:
    """Complete versions of ``table`` (folders with a ``_SUCCESS`` marker)."""
    fs, root, jvm = _fs(spark, f"{_base(spark, base)}/{table}")
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def commit(df: DataFrame, table: str, base: str | None = None,
           partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as the next version of ``table`` and return it read back.
    ``partition_by`` lays the version out in folders (e.g. the candidate pool
    by admission day, so the expiry scan prunes whole days)."""
    spark = df.sparkSession
    done = versions(spark, table, base)
    v = max([int(time.time() * 1000)] + [x + 1 for x in done])
    path = f"{_base(spark, base)}/{table}/version={v}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


def current(spark: SparkSession, table: str, base: str | None = None) -> DataFrame | None:
    """Newest complete version of ``table`` (None before the first commit)."""
    done = versions(spark, table, base)
    if not done:
        return None
    return spark.read.parquet(f"{_base(spark, base)}/{table}/version={done[-1]}")


def merge_first_writes(delta: DataFrame, table: str, key, order, base: str | None = None) -> DataFrame:
    """K1 end to end: accept the delta's first row per new key, append it to
    the current snapshot and commit the result as the next version."""
    from .keyed import first_write_wins
    spark = delta.sparkSession
    cur = current(spark, table, base)
    accepted = first_write_wins(delta, key, order, cur)
    nxt = accepted if cur is None else cur.unionByName(accepted.select(*cur.columns))
    return commit(nxt, table, base)
