"""Keyed writes on immutable tables.

The reference stores documents in collections with unique indexes and relies
on a failed second insert ("first write wins"). On Spark a keyed table is a
Parquet snapshot; a write is "merge a delta into a snapshot":

* ``first_write_wins``: one row per key from the delta (earliest by an
  arrival column), minus keys already in the base. The per-key pick is a
  ``min_by`` hash aggregate, which combines map-side, so a key holding a third
  of the delta never lands whole in one task (a ``row_number`` window would
  sort all of that key's rows in one task).
* ``insert_if_absent``: the same, plus an insert-time column.
* ``update_by_key`` / ``delete_by_key``: left join / anti join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def first_per_key(df: DataFrame, key, order: Sequence[str]) -> DataFrame:
    """The earliest row of every key by ``order`` (lexicographic)."""
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    picked = (df.groupBy(*keys)
              .agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordering).alias("_row")))
    return picked.select(*keys, "_row.*")


def last_per_key(df: DataFrame, key, order: Sequence[str]) -> DataFrame:
    """A5: the latest row of every key by ``order`` (dict override)."""
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    picked = (df.groupBy(*keys)
              .agg(F.max_by(F.struct(*[F.col(c) for c in rest]), ordering).alias("_row")))
    return picked.select(*keys, "_row.*")


def first_write_wins(delta: DataFrame, key, order: Sequence[str],
                     base: DataFrame | None = None) -> DataFrame:
    """K1: rows of ``delta`` that a unique-key insert would accept."""
    firsts = first_per_key(delta, key, order)
    if base is None:
        return firsts
    # an anti join ignores duplicate keys on its right side: no distinct (shuffle) needed
    return firsts.join(base.select(*_keys(key)), _keys(key), "left_anti")


def insert_if_absent(delta: DataFrame, base: DataFrame, key, order: Sequence[str],
                     stamp: Column | None = None, stamp_name: str = "insert_time") -> DataFrame:
    """K5 + J2: first delta row per key whose key is not in ``base``."""
    out = first_write_wins(delta, key, order, base)
    if stamp is not None:
        out = out.withColumn(stamp_name, stamp)
    return out


def update_by_key(base: DataFrame, delta: DataFrame, key, fields: Sequence[str],
                  order: Sequence[str] = ()) -> DataFrame:
    """K7: set ``fields`` from ``delta`` where present; other rows unchanged. Of
    several delta rows with one key the last by ``order`` counts (without an
    order: by the fields)."""
    keys = _keys(key)
    delta = last_per_key(delta.select(*keys, *{*fields, *order} - {*keys}), keys, order or fields)
    d = delta.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = base.join(d, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                           for c in base.columns])


def delete_by_key(base: DataFrame, keys_df: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """K8: (remaining rows, removed rows); removed.count() is the deleted count."""
    keys = _keys(key)
    k = keys_df.select(*keys)  # semi/anti joins ignore duplicate keys
    return base.join(k, keys, "left_anti"), base.join(k, keys, "left_semi")


def route(records: DataFrame, routes: DataFrame, on: str, target: str = "target", strict: bool = False,
          quarantine: str = "quarantine") -> DataFrame:
    """Attach the sink of every record by an exact-match lookup;
    records without a route get the ``quarantine`` sink and a ``reason``, or, in
    strict mode, fail the job (the reference raises on an unknown type). One pass
    over the records; the writer splits by ``target``. ``routes`` is a
    configuration table (a handful of rows), so it is broadcast."""
    routed = records.join(F.broadcast(routes), on, "left")
    if strict:
        routed = routed.withColumn(target, F.coalesce(
            F.col(target), F.raise_error(F.concat(F.lit("no route for "), F.col(on).cast("string")))))
    return (routed.withColumn("reason", F.when(F.col(target).isNull(), F.lit("no route")))
            .withColumn(target, F.coalesce(F.col(target), F.lit(quarantine))))
