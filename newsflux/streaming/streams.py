"""Structured Streaming versions of the long-lived state.

* ``run_article_stream``: landed documents -> per-sink keyed tables (T1
  first-write-wins across batches kept as one flag of state per key, T5 one
  input many sinks via ``foreachBatch``, T6 file source drained with
  ``availableNow``). Each batch writes its own ``batch_id=<n>`` folders with
  overwrite, so a replayed batch replaces itself instead of duplicating rows.
* ``run_pool_stream``: crawls -> pool admissions with
  ``applyInPandasWithState`` keyed by URL; the state is the last admission
  time (one long), and an event-time timer drops it once the URL has left the pool.
* ``run_two_sinks``: one stream into a keyed store (first write per URL) and the
  expiring pool, each by its own rule, with one recovery point.
* ``run_reads_stream``: reads -> per-user history capped at 50, state is the
  capped list itself; ``run_profile_stream``: the last action per (user, tag), a native
  aggregate. Both are read from the state (state data source), and write per batch only
  what changed.

Before a stream is grouped by key for a Python fold, a stateless ``mapInPandas`` keeps of each
Arrow batch only what the fold can use (the first crawl per URL and run, the
newest 50 reads per user, the lowest doc_id per text): a key holding a third of the rows reaches its task as a few rows per
batch.

Sinks and checkpoints live under ``spark.checkpoint.dir`` (the shared folder
on a cluster). Streams assume arrival in time order (files land in order);
the batch jobs in ``operators`` are the reference results.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path

DAY_US = 86_400_000_000


def _drain(writer, checkpoint: str) -> list:
    """Run a stream over all that has landed; the progress of its batches."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return list(q.recentProgress)


def _stored_before(spark: SparkSession, sink: str, batch_id: int) -> DataFrame | None:
    """What earlier batches wrote to ``sink``; a replayed batch does not see itself."""
    at = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(sink).where(F.col("batch_id") < batch_id)


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None,
                max_bytes: int = 64 << 30) -> DataFrame:
    """Incremental polling of landed parquet files, a micro-batch of up to
    ``max_bytes`` (or ``max_files``) at a time.

    ``path`` is a landing folder, or one file (then its folder is watched
    with a name filter, since the file source lists folders)."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader = reader.option("pathGlobFilter", at.getName())
        path = at.getParent().toString()
    return reader.parquet(path)


def _best_per_key(df: DataFrame, keys: list[str], order: list[str], keep: int = 1, newest: bool = False) -> DataFrame:
    """Stateless: of every Arrow batch the first (or newest) ``keep`` rows per key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(order, ascending=not newest).groupby(keys, sort=False, dropna=False).head(keep)
    return df.mapInPandas(run, df.schema)


# --- T1/T5/T6: keyed article sinks -------------------------------------------

ARTICLE_STATE = "seen boolean"


def _first_write(schema_cols: list[str]):
    """T1 per key: the first batch that brings a key emits its lowest-doc_id
    row; later batches emit nothing (O(1) state per key)."""
    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in pdfs:
            if pdf.empty:
                continue
            top = pdf.nsmallest(1, "doc_id")
            if best is None or int(top["doc_id"].iloc[0]) < int(best["doc_id"].iloc[0]):
                best = top
        if state.exists or best is None:
            yield pd.DataFrame(columns=schema_cols)
            return
        state.update((True,))
        yield best[schema_cols]
    return fold


def run_article_stream(spark: SparkSession, docs: DataFrame, routes: DataFrame,
                       out_dir: str | None = None) -> str:
    """Drain ``docs`` (doc_id, text, source, lang) into
    ``<out>/tables/target=<sink>/batch_id=<n>``: first write per text key
    across all batches (stream state), one folder per sink (K2), one
    sub-folder per batch written with overwrite (a replayed batch replaces
    itself)."""
    out_dir = out_dir or scratch_path(spark, "stream-articles")
    sink = os.path.join(out_dir, "tables")
    keyed_docs = docs.withColumn("text_key", F.md5("text")).drop("text")
    cols = keyed_docs.columns
    firsts = _best_per_key(keyed_docs, ["text_key"], ["doc_id"]).groupBy("text_key").applyInPandasWithState(
        _first_write(cols), keyed_docs.schema, ARTICLE_STATE, "append", GroupStateTimeout.NoTimeout)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        routed = batch.join(F.broadcast(routes), "source", "left").fillna({"target": "quarantine"})
        (routed.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("target", "batch_id").parquet(sink))

    _drain(firsts.writeStream.outputMode("append").foreachBatch(write_batch),
           os.path.join(out_dir, "_ckpt"))
    return sink


# --- T2: candidate pool --------------------------------------------------------

POOL_OUT = "url string, run_us long, db_us long, event_id long"
POOL_STATE = "last_us long"


def _pool_fold(horizon_days: int):
    horizon = horizon_days * DAY_US

    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        firsts: dict[int, tuple[int, int]] = {}
        for pdf in pdfs:
            if pdf.empty:
                continue
            g = pdf.sort_values(["ts_us", "event_id"]).groupby("run_us", sort=False).first()
            for run, row in g.iterrows():
                cand = (int(row["ts_us"]), int(row["event_id"]))
                if run not in firsts or cand < firsts[run]:
                    firsts[int(run)] = cand
        last = state.get[0] if state.exists else None
        rows = []
        for run in sorted(firsts):
            ts, eid = firsts[run]
            if last is None or last < run - horizon:
                rows.append((key[0], run, ts, eid))
                last = ts
        _keep_until_expiry(state, last, horizon)
        yield pd.DataFrame(rows, columns=["url", "run_us", "db_us", "event_id"])

    return fold


def _keep_until_expiry(state: GroupState, last: int | None, horizon: int) -> None:
    """Store the last admission, with a timer for when it no longer matters: every run later
    than it by more than the horizon admits the URL anyway."""
    if last is None:
        return
    due = -(-(last + horizon) // 1000) + 1
    if due > state.getCurrentWatermarkMs():
        state.update((last,))
        state.setTimeoutTimestamp(due)
    elif state.exists:
        state.remove()


def _by_url_with_timers(reduced: DataFrame, fold, out: str, lateness: str) -> DataFrame:
    """The fold per URL, with the runs' start as event time."""
    timed = reduced.withColumn("run_at", F.timestamp_micros("run_us")).withWatermark("run_at", lateness)
    return timed.groupBy("url").applyInPandasWithState(fold, out, POOL_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_pool_stream(spark: SparkSession, crawls: DataFrame, horizon_days: int = 5,
                    out_dir: str | None = None, lateness: str = "1 day", progress: list | None = None) -> str:
    """``crawls`` (url, ts, run_start, event_id) stream -> admissions parquet. State lives for
    the horizon: crawls of runs that are older than the newest by more than ``lateness`` are
    not looked at. ``progress`` receives the progress of the batches."""
    out_dir = out_dir or scratch_path(spark, "stream-pool")
    sink = os.path.join(out_dir, "admissions")
    prepared = crawls.select("url", "event_id",
                             F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                             F.unix_micros(F.col("run_start").cast("timestamp")).alias("run_us"))
    adm = _by_url_with_timers(_best_per_key(prepared, ["url", "run_us"], ["ts_us", "event_id"]), _pool_fold(horizon_days),
                              POOL_OUT, lateness)
    done = _drain(adm.writeStream.format("parquet").option("path", sink).outputMode("append"),
                  os.path.join(out_dir, "_ckpt"))
    if progress is not None:
        progress += done
    return sink


# --- K3: keyed store and pool from one stream --------------------------------------

SINKS_OUT = "sink string, url string, event_id long, ts_us long, run_us long, title string"


def _two_sinks_fold(horizon_days: int):
    horizon = horizon_days * DAY_US
    names = ["sink", "url", "event_id", "ts_us", "run_us", "title"]

    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat([p for p in pdfs if not p.empty]).sort_values(["ts_us", "event_id"])
        first = got.iloc[0]
        rows = [("store", key[0], int(first.event_id), int(first.ts_us), int(first.run_us), first.title)]
        last = state.get[0] if state.exists else None
        for r in got[got["fits"]].drop_duplicates("run_us").sort_values("run_us").itertuples():
            if last is None or last < r.run_us - horizon:
                rows.append(("candidates", key[0], int(r.event_id), int(r.ts_us), int(r.run_us), r.title))
                last = int(r.ts_us)
        _keep_until_expiry(state, last, horizon)
        yield pd.DataFrame(rows, columns=names)

    return fold


def run_two_sinks(spark: SparkSession, articles: DataFrame, out_dir: str | None = None, horizon_days: int = 5,
                  lateness: str = "1 day") -> tuple[str, str]:
    """One stream of ``articles`` (url, event_id, ts, run_start, title, has_body) into two
    sinks that know nothing of each other's rejections: the store keeps the first article of every
    URL, whatever it lacks; the pool admits articles with a body and a title by the rule of expiry and
    re-admission. Pool state is kept per URL until it expires; the store is its own
    memory (URLs of earlier batches are left out by an anti join). Both are written per batch with
    overwrite, so a replayed batch repeats neither."""
    out_dir = out_dir or scratch_path(spark, "stream-sinks")
    store, candidates = os.path.join(out_dir, "store"), os.path.join(out_dir, "candidates")
    prepared = articles.select(
        "url", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.unix_micros(F.col("run_start").cast("timestamp")).alias("run_us"), "title",
        (F.coalesce(F.col("has_body"), F.lit(False)) & F.col("title").isNotNull()).alias("fits"))
    folded = _by_url_with_timers(_best_per_key(prepared, ["url", "run_us", "fits"], ["ts_us", "event_id"]),
                                 _two_sinks_fold(horizon_days), SINKS_OUT, lateness)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # both sinks read it: the fold runs once
        try:
            known = _stored_before(spark, store, batch_id)
            fresh = batch.where("sink = 'store'")
            if known is not None:
                fresh = fresh.join(known.select("url"), "url", "left_anti").select(*batch.columns)
            for sink, rows in ((store, fresh), (candidates, batch.where("sink = 'candidates'"))):
                (rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))
        finally:
            batch.unpersist()

    _drain(folded.writeStream.outputMode("append").foreachBatch(write_batch), os.path.join(out_dir, "_ckpt"))
    return store, candidates


def read_admissions(spark: SparkSession, sink: str) -> DataFrame:
    a = spark.read.schema(POOL_OUT).parquet(sink)
    return a.select("url",
                    F.timestamp_micros("run_us").cast("timestamp_ntz").alias("run_start"),
                    F.timestamp_micros("db_us").cast("timestamp_ntz").alias("db_time"), "event_id")


# --- T3: capped reading history -------------------------------------------------

READS_OUT = "user_id long, ts_us long, event_id long, url string"
READS_STATE = "items string"
READS_ITEMS = "array<struct<ts_us: long, event_id: long, url: string>>"


def _reads_fold(cap: int):
    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items = [tuple(r.values()) for r in json.loads(state.get[0])] if state.exists else []
        old = set(items)
        for pdf in pdfs:
            if pdf.empty:
                continue
            newest = pdf.nlargest(cap, ["ts_us", "event_id"])
            items.extend((int(a), int(b), str(c)) for a, b, c in zip(newest["ts_us"], newest["event_id"], newest["url"]))
            items = sorted(items, key=lambda r: (r[0], r[1]), reverse=True)[:cap]
        state.update((json.dumps([{"ts_us": a, "event_id": b, "url": c} for a, b, c in items]),))
        yield pd.DataFrame([(key[0], *r) for r in items if r not in old], columns=["user_id", "ts_us", "event_id", "url"])

    return fold


def run_reads_stream(spark: SparkSession, reads: DataFrame, cap: int = 50,
                     out_dir: str | None = None) -> str:
    """``reads`` (user_id, ts, event_id, url) stream. The history is the state
    (``read_history``); per batch only the reads that entered a history are written, under
    ``<out>/entered/batch_id=<n>``."""
    out_dir = out_dir or scratch_path(spark, "stream-reads")
    prepared = reads.select("user_id", "event_id", "url",
                            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    hist = _best_per_key(prepared, ["user_id"], ["ts_us", "event_id"], cap, newest=True).groupBy("user_id").applyInPandasWithState(
        _reads_fold(cap), READS_OUT, READS_STATE, "update", GroupStateTimeout.NoTimeout)
    _drain(hist.writeStream.outputMode("update").foreachBatch(_changes_to(os.path.join(out_dir, "entered"))),
           os.path.join(out_dir, "_ckpt"))
    return out_dir


def _changes_to(sink: str):
    """Writes a batch's rows to a folder of its own; a replayed batch replaces itself."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))
    return write_batch


def _state(spark: SparkSession, out_dir: str) -> DataFrame:
    """The state of a stream's last batch (key, value), read from its checkpoint."""
    return spark.read.format("statestore").load(os.path.join(out_dir, "_ckpt"))


def read_history(spark: SparkSession, out_dir: str) -> DataFrame:
    """(user_id, pos, ts_us, event_id, url): every user's current history, newest first."""
    items = F.from_json("value.groupState.items", READS_ITEMS)
    return (_state(spark, out_dir).select(F.col("key.user_id").alias("user_id"), F.posexplode(items).alias("pos", "r"))
            .select("user_id", (F.col("pos") + 1).cast("long").alias("pos"), "r.*"))


# --- T4: profile tags from an action stream ---------------------------------------


def run_profile_stream(spark: SparkSession, actions: DataFrame, out_dir: str | None = None) -> str:
    """``actions`` (user_id, tag, ts, event_id, action in add/del) stream -> latest action per
    (user, tag): a streaming aggregate inside the JVM, whose state is the profile (``read_tags``); the
    pairs that a batch touched are written to ``<out>/touched/batch_id=<n>``."""
    out_dir = out_dir or scratch_path(spark, "stream-profiles")
    last = F.max(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id", "action")).alias("last")
    latest = actions.groupBy("user_id", "tag").agg(last).select("user_id", "tag", "last.*")
    _drain(latest.writeStream.outputMode("update").foreachBatch(_changes_to(os.path.join(out_dir, "touched"))),
           os.path.join(out_dir, "_ckpt"))
    return out_dir


def read_tags(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current tag set per user: tags whose latest action is an add."""
    return (_state(spark, out_dir).where(F.col("value.max.action") == "add")
            .groupBy(F.col("key.user_id").alias("user_id")).agg(F.array_sort(F.collect_set("key.tag")).alias("tags")))
