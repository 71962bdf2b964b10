"""Candidate pool with expiry and re-admission.

Reference behaviour: at the start of every run rows with
``db_time < run_start - 5 days`` are purged; during the run a URL is inserted
unless it is already in the pool. Admission therefore depends on the previous
*admitted* row, which a plain window cannot express.

Scale design: within one run a URL can be admitted at most once (after the
first insert it stays for the rest of the run), so the crawl stream is first
reduced to the first crawl per (url, run) with a partial aggregate — map-side,
so a URL holding a third of all crawls shrinks to one row per run before the
shuffle. The fold then walks each URL's runs, a list bounded by the number of
runs (calendar days), not by the number of crawls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

HORIZON_DAYS = 5  # fixed value: pool age in days


def _horizon(days: int):
    return F.make_dt_interval(F.lit(days))


def first_per_run(crawls: DataFrame, key: str = "url", ts: str = "ts",
                  run: str = "run_start", seq: str = "event_id") -> DataFrame:
    """(key, run) -> the earliest crawl of that run (ties by ``seq``)."""
    return (crawls.groupBy(key, run)
            .agg(F.min(F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))).alias("f"))
            .select(key, run, F.col("f.ts").alias("db_time"), F.col("f.seq").alias(seq)))


def admissions(crawls: DataFrame, key: str = "url", ts: str = "ts", run: str = "run_start",
               seq: str = "event_id", horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """One row per admission: (key, run_start, db_time, seq)."""
    firsts = first_per_run(crawls, key, ts, run, seq)
    runs = (firsts.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"),
                                                      F.col("db_time").alias("t"),
                                                      F.col(seq).alias("seq")))).alias("runs")))
    elem = "struct<run:timestamp_ntz,t:timestamp_ntz,seq:bigint>"
    init = F.struct(F.lit(None).cast("timestamp_ntz").alias("last"),
                    F.array().cast(f"array<{elem}>").alias("adm"))

    def step(acc, x):
        admit = acc["last"].isNull() | (acc["last"] < x["run"] - _horizon(horizon_days))
        return F.when(admit, F.struct(x["t"].alias("last"),
                                      F.concat(acc["adm"], F.array(x)).alias("adm"))).otherwise(acc)

    folded = runs.select(key, F.aggregate("runs", init, step)["adm"].alias("adm"))
    return (A.explode_rows(folded, F.col("adm"), "a", key)
            .select(key, F.col("a.run").alias(run), F.col("a.t").alias("db_time"),
                    F.col("a.seq").cast("bigint").alias(seq)))


def pool_asof(adm: DataFrame, as_of=None, key: str = "url", run: str = "run_start",
              horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Pool right after the last run: each key's latest admission, kept when
    not purged at the last run start (``db_time >= T - horizon``).

    ``as_of`` defaults to the last run start seen in ``adm`` (scalar subquery)."""
    if as_of is None:
        as_of = adm.select(F.max(run)).scalar()
    last = (adm.groupBy(key)
            .agg(F.max(F.struct("db_time", run, *[c for c in adm.columns if c not in (key, "db_time", run)]))
                 .alias("a"))
            .select(key, "a.*"))
    return last.where(F.col("db_time") >= as_of - _horizon(horizon_days))


def expired_counts(adm: DataFrame, run_starts: DataFrame, run: str = "run_start",
                   horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Rows purged at each run start.

    An admission is purged at the first run start ``R > db_time + horizon``,
    whatever time of day runs start. Admissions are first counted per instant
    (combined map-side); each instant looks its run up in the calendar of run
    starts, a scalar subquery with one entry per run.
    """
    calendar = run_starts.select(F.array_sort(F.collect_set(run))).scalar()
    due = (adm.groupBy((F.col("db_time") + _horizon(horizon_days)).alias("due")).agg(F.count(F.lit(1)).alias("n"))
           .withColumn("runs", calendar))
    gone = due.select(F.array_min(F.filter("runs", lambda r: r > F.col("due"))).alias(run), "n")
    return gone.where(F.col(run).isNotNull()).groupBy(run).agg(F.sum("n").cast("bigint").alias("n_expired"))


def latest(pool: DataFrame, n: int = 10, order_col: str = "pb_time", key: str = "url") -> DataFrame:
    """M4: newest first (missing last, ties by key), first ``n`` rows, 0-based rank."""
    top = pool.orderBy(F.col(order_col).desc_nulls_last(), F.col(key).asc()).limit(n)
    w = Window.orderBy(F.col(order_col).desc_nulls_last(), F.col(key).asc())
    return top.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))
