"""Article header line parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def parse_header(df: DataFrame, col: str) -> DataFrame:
    """P20: ``title words  date time source [author]`` parsed from the end.

    Whitespace runs collapse, the line splits on single spaces, and the time
    is the last token (before the final one) with exactly two ':'. After it
    come the source, plus the author when exactly two tokens follow; before
    it the date; the tokens before the date, joined without separator, are
    the title. A line without such a token yields NULLs."""
    toks = F.split(T.strip_ws(T.remove_multi_space(col)), " ")
    d = df.withColumn("_t", toks).withColumn("_n", F.size("_t"))
    k = F.array_max(F.transform(F.slice("_t", F.lit(1), F.greatest(F.col("_n") - 1, F.lit(0))),
                                lambda x, i: F.when(T.count_char(x, ":") == 2, i + 1)))
    d = d.withColumn("_k", F.when(k >= 2, k))
    tail = F.slice("_t", F.col("_k") + 1, F.col("_n") - F.col("_k"))
    two = F.size(tail) == 2
    return d.select(
        *df.columns,
        F.array_join(F.slice("_t", F.lit(1), F.greatest(F.col("_k") - 2, F.lit(0))), "").alias("title"),
        F.concat_ws(" ", F.get("_t", F.col("_k") - 2), F.get("_t", F.col("_k") - 1)).alias("_pb"),
        F.when(two, tail[0]).otherwise(F.array_join(tail, " ")).alias("source"),
        F.when(F.col("_k").isNotNull(), F.when(two, tail[1]).otherwise(F.lit(""))).alias("author"),
    ).withColumn("pb_time", F.when(F.col("source").isNotNull(), F.col("_pb"))).drop("_pb") \
        .withColumn("title", F.when(F.col("source").isNotNull(), F.col("title")))


def source_time(df: DataFrame, col: str) -> DataFrame:
    """``source … date time``: first token the source, last two the time,
    only when there are at least two tokens."""
    toks = T.split_ws(col)
    ok = F.size(toks) >= 2
    return df.select("*", F.when(ok, toks[0]).alias("source"),
                     F.when(ok, F.concat_ws(" ", F.element_at(toks, -2), F.element_at(toks, -1))).alias("pb_time"))
