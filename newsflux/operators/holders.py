"""Shareholder roll-ups.

The reference keeps one document per holder with an ever-growing
``stockid_list``. A list per holder is an unbounded group, so the roll-up is
kept as aggregates that combine map-side — first-seen attributes by
``min_by``, size by ``count``, first/last stock by ``min_by``/``max_by`` — and
the list itself stays in row form (holder, position, stock) when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import number_within


def holder_id(name, sex, age, edu) -> Column:
    """deterministic holder id over (name, sex, age, edu) — the
    reference's per-process salted ``hash`` is not reproducible."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (name, sex, age, edu)]
    return F.substring(F.md5(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("")) for p in parts])), 1, 16)


def rollup(pairs: DataFrame, key: str, item: str, seq: list, attrs: list[str]) -> DataFrame:
    """A1/K6: first-seen attributes, list size, first and last item per key, in
    the order of ``seq`` (columns or expressions). An upsert of a delta into a
    stored list is the same roll-up with the stored rows ordered first: absent
    keys are inserted, present ones keep their attributes and get the delta's
    items appended. ``list_rows`` gives the list itself."""
    order = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in [*seq, item]])  # the item settles ties
    aggs = [F.count(F.lit(1)).alias("n_items"), F.min_by(item, order).alias("first_item"),
            F.max_by(item, order).alias("last_item")]
    if attrs:
        aggs.append(F.min_by(F.struct(*attrs), order).alias("_attrs"))
    out = pairs.groupBy(key).agg(*aggs)
    return out.select(key, *([F.col(f"_attrs.{a}").alias(a) for a in attrs]), "n_items", "first_item", "last_item")


def list_rows(pairs: DataFrame, key: str, item: str, seq: list[str]) -> DataFrame:
    """A2 in row form: (key, pos, item) in arrival order, duplicates kept."""
    return number_within(pairs.select(key, item, *seq), [key], [*seq, item], name="pos").select(key, "pos", item)
