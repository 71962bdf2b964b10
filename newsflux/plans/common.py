"""Small helpers shared by the query catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_str(c) -> Column:
    """Timestamp as text with microseconds (stable across engines)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_str(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd")


def minute_str(c) -> Column:
    """F9 ``%Y-%m-%d %H:%M``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm")
