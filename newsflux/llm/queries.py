"""Registered queries of the operators: each runs one operator with production
parameters over its whole table and shapes the contract's digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflux.sources.tables import load

from . import common as C
from . import op1_line_dedup as op1
from . import op10_preference as op10
from . import op11_toxicity as op11
from . import op12_hard_negatives as op12
from . import op13_manifest as op13
from . import op2_sentencepiece as op2
from . import op3_merkle_audit as op3
from . import op4_language_id as op4
from . import op5_ngram_join as op5
from . import op6_decontaminate as op6
from . import op7_quality_rules as op7
from . import op8_token_counts as op8
from . import op9_html_text as op9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return op7.assess(load(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    cut = op1.apply_bitmaps(docs, op1.keep_bitmaps(docs, min_docs=10, min_key_chars=1))
    return cut.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"),
                      F.col("__n_dropped").cast("long").alias("n_dropped"),
                      F.sha2("__kept_text", 256).alias("kept_sha256"))


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return op5.link_components(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs, items = load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text")
    return op6.leaks(docs, items).select("doc_id", "item_id", "n_covered", "n_item_words", "verbatim")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return op2.tokenize(load(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return op4.identify(load(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    found = op9.extract(load(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    trees = C.stage(op8.build_trees(docs), "token-trees")
    edited = op8.apply_edits(docs, trees, op8.revision_edits(docs))
    return edited.select("doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_encoded",
                         F.sha2("text", 256).alias("text_sha256"))


@query
def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    chosen, rejected = op10.derived_pairs(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    ranges = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return (op10.format_pairs(chosen, rejected)
            .select(F.col("pair").alias("conv_id"), "prompt", "chosen", "rejected", ranges("chosen_spans").alias("chosen_spans"),
                    ranges("rejected_spans").alias("rejected_spans"), "n_prompt_turns", "usable"))


@query
def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return op3.compare(*op3.page_archives(load(spark, sf_dir, "pages", "page_id", "url", "html")))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return op11.assess(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "toxic"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    rows = op12.given_rows(load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return op12.mine(rows, F.col("vec_id") % 100 == 0)


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return op13.audit(load(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))
