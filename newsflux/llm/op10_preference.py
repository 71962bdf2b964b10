"""Preference formatting: one prompt and two masked completions per pair.

For each pair the longest common turn prefix of the chosen and the rejected
conversation is the prompt, rendered once; what follows in either conversation
is a completion, with the character spans that a trainer learns from (the
assistant's words and their end mark; role headers and other roles are masked).

The prefix is found without gathering conversations: every turn of either side
adds or subtracts its messages' hashes in one sum per (pair, turn), combined
map-side, and the first turn whose sums do not cancel out is a ``min``. Only the rendering gathers the turns
of one conversation, which is one training example and one output row.

Format: ``<|role|>`` newline, text, ``<|end|>`` newline per message. A ``<|`` inside
a role or text is written ``< |``, so that no message can open or end a turn.

Defined cases: a null role is ``unknown``, a null text empty; turns are ordered by
number, null numbers last; several messages with one turn number are compared as
a multiset and rendered in (role, text) order; a side without any turn is an
empty conversation; equal conversations have everything in the prompt and are
not usable; rows with a null pair id belong to no pair and are ignored; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = 2**63 - 1


def _turns(conversations: DataFrame, pair: str) -> DataFrame:
    return (conversations.where(F.col(pair).isNotNull())
            .select(F.col(pair).alias("pair"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
                    F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))


def first_difference(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair, differs): the first turn number at which the two sides differ: where
    the messages' counts and hash sums of both sides do not cancel out."""
    word = lambda seed: F.xxhash64(F.lit(seed), "role", F.lit("\0"), "text").cast("decimal(20,0)")
    signed = lambda turns, sign: turns.select("pair", "turn", F.lit(sign).alias("n"), (word(1) * sign).cast("decimal(38,0)").alias("s1"),
                                              (word(2) * sign).cast("decimal(38,0)").alias("s2"))
    sums = (signed(chosen, 1).unionByName(signed(rejected, -1)).groupBy("pair", "turn")
            .agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")))
    return sums.where("n != 0 OR s1 != 0 OR s2 != 0").groupBy("pair").agg(F.min("turn").alias("differs"))


def segments(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, part, turn, role, text, learned): the messages of every pair, each in
    its part (prompt, chosen, rejected); the prompt's come from the chosen side."""
    a, b = _turns(chosen, pair), _turns(rejected, pair)
    differs = first_difference(a, b)

    def side(turns: DataFrame, name: str) -> DataFrame:
        common = F.col("differs").isNull() | (F.col("turn") < F.col("differs"))
        return (turns.join(differs, "pair", "left")
                .withColumn("part", F.when(common, "prompt").otherwise(name)).drop("differs"))

    parts = side(a, "chosen").unionByName(side(b, "rejected").where("part = 'rejected'"))
    return parts.select("pair", "part", "turn", "role", "text",
                        ((F.col("role") == "assistant") & (F.col("part") != "prompt")).alias("learned"))


def _plain(c: str) -> Column:
    return F.replace(F.col(c), F.lit("<|"), F.lit("< |"))


_RENDERED = "rendered string, spans array<struct<start: int, stop: int>>"


def render(segments: DataFrame) -> DataFrame:
    """(pair, prompt, chosen, rejected, chosen_spans, rejected_spans,
    n_prompt_turns, usable): spans are code point ranges of the completion that
    are learned from; a pair is usable if both completions have one."""

    @F.arrow_udf(_RENDERED)
    def join(messages: pa.Array) -> pa.Array:
        out = []
        for turns in messages.to_pylist():
            pieces, spans, at = [], [], 0
            for m in turns or []:
                header = f"<|{m['role']}|>\n"
                body = f"{m['text']}<|end|>\n"
                if m["learned"]:
                    spans.append({"start": at + len(header), "stop": at + len(header) + len(body) - 1})
                pieces += [header, body]
                at += len(header) + len(body)
            out.append({"rendered": "".join(pieces), "spans": spans})
        return pa.array(out, pa.struct([("rendered", pa.string()), ("spans", pa.list_(
            pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))

    message = F.struct("turn", _plain("role").alias("role"), _plain("text").alias("text"), "learned")
    part = lambda name: F.sort_array(F.collect_list(F.when(F.col("part") == name, message)))
    gathered = segments.groupBy("pair").agg(*(part(p).alias(p) for p in ("prompt", "chosen", "rejected")))
    done = gathered.select("pair", F.size(F.array_distinct(F.transform("prompt", lambda m: m["turn"]))).alias("n_prompt_turns"),
                           *(join(F.col(p)).alias(p) for p in ("prompt", "chosen", "rejected")))
    return done.select("pair", F.col("prompt.rendered").alias("prompt"), F.col("chosen.rendered").alias("chosen"),
                       F.col("rejected.rendered").alias("rejected"), F.col("chosen.spans").alias("chosen_spans"),
                       F.col("rejected.spans").alias("rejected_spans"), "n_prompt_turns",
                       ((F.size("chosen.spans") > 0) & (F.size("rejected.spans") > 0)).alias("usable"))


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    return render(segments(chosen, rejected, pair))


def derived_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs for every conversation c of the table: chosen is c itself, rejected
    starts like c and goes on, from turn ``c mod (turns of c)``, with the turns of
    conversation c + 1 from that number on."""
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    chosen = turns.withColumnRenamed("conv_id", "pair_id")
    cut = (chosen.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
           .select("pair_id", F.pmod("pair_id", "n").alias("cut")))
    shared = chosen.join(cut, "pair_id").where("turn < cut").drop("cut")
    other = turns.withColumn("pair_id", F.col("conv_id") - 1).drop("conv_id").join(cut, "pair_id").where("turn >= cut").drop("cut")
    return chosen, shared.unionByName(other)
