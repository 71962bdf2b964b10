"""Scans of the landed driver tables.

Parquet carries its schema; we still select columns explicitly so the scan's
``ReadSchema`` holds only what a job uses (``html`` and ``text`` are the wide
columns and must never be read by a job that does not need them).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


class Tables:
    """Lazy accessor: ``t = Tables(spark, dir); t.events("ts", "user_id")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str):
        if name not in TABLES:
            raise AttributeError(name)
        return lambda *cols: load(self.spark, self.sf_dir, name, *cols)
