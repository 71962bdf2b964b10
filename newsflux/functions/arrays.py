"""Array-to-rows helpers.

``explode``/``posexplode`` of a *computed* array makes Catalyst infer a
``size(array) > 0`` filter and push it below the generator, where the whole
array expression (a regex extraction, a JSON parse, a fold) is evaluated a
second time. The ``_outer`` generators get no inferred filter; dropping the
single NULL row they produce for an empty array gives the same rows with
one evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posexplode_rows(df: DataFrame, arr: Column, pos: str, val: str, *keep) -> DataFrame:
    """``select(*keep, posexplode(arr) as (pos, val))`` evaluating ``arr`` once."""
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, val)).where(F.col(pos).isNotNull())


def explode_rows(df: DataFrame, arr: Column, val: str, *keep) -> DataFrame:
    """``select(*keep, explode(arr) as val)`` evaluating ``arr`` once (NULL
    elements are kept, like ``explode``)."""
    return posexplode_rows(df, arr, "_pos", val, *keep).drop("_pos")
