"""Corpus pipeline: quality rules, line dedup, near-duplicate groups, benchmark
decontamination and tokenisation, each stage one of the operators of
``newsflux.llm``. Every stage is written as Parquet and read again as the next
one's documents; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsflux.llm import common as C
from newsflux.llm import op1_line_dedup as op1
from newsflux.llm import op2_sentencepiece as op2
from newsflux.llm import op5_ngram_join as op5
from newsflux.llm import op6_decontaminate as op6
from newsflux.llm import op7_quality_rules as op7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the repetition coverage rules."""
    C.prepare(spark)
    return op7.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in 10 or more documents."""
    C.prepare(spark)
    return op1.drop_repeated_lines(docs, min_docs=10, min_key_chars=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 80 percent."""
    C.prepare(spark)
    return op5.one_per_group(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    C.prepare(spark)
    return op6.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    C.prepare(spark)
    return op2.tokenize(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]

#: The tokeniser stage cannot be expressed in SQL; tests compare run() with a
#: brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = C.stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
