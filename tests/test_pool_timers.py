"""T2 and K3 over several landed files: state expires, stream equals batch, two rules from one stream."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsflux.operators import pool
from newsflux.streaming import streams as S

DAY = timedelta(days=1)
BEGIN = datetime(2024, 1, 1)


def landed(spark, folder, rows, schema, files):
    """Rows (dicts with ts) written in time order, one file after the other."""
    rows = sorted(rows, key=lambda r: r["ts"])
    days = sorted({r["ts"].date() for r in rows})
    for i in range(files):
        part = [r for r in rows if days.index(r["ts"].date()) * files // len(days) == i]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return S.file_stream(spark, folder, spark.createDataFrame([], schema).schema, max_files=1)


def test_state_expires_and_admissions_equal_the_batch(spark, tmp_dir):
    rng = random.Random(2)
    schema = "url string, ts timestamp_ntz, run_start timestamp_ntz, event_id long"
    rows = []
    for i in range(900):
        day = rng.randrange(30)
        # some URLs come again and again, others belong to one day
        url = f"u{rng.randrange(12)}" if rng.random() < 0.4 else f"d{day}-{rng.randrange(20)}"
        rows.append({"url": url, "ts": BEGIN + day * DAY + timedelta(minutes=rng.randrange(1440)),
                     "run_start": BEGIN + day * DAY, "event_id": i})
    progress = []
    stream = landed(spark, os.path.join(tmp_dir, "crawls"), rows, schema, 5)
    sink = S.run_pool_stream(spark, stream, progress=progress)
    got = sorted(map(tuple, S.read_admissions(spark, sink).collect()))
    want = pool.admissions(spark.createDataFrame(rows, schema)).select("url", "run_start", "db_time", "event_id")
    assert got == sorted(map(tuple, want.collect()))
    again = [u for u in {r[0] for r in got} if sum(r[0] == u for r in got) > 1]
    assert len(again) > 5  # re-admitted after expiry
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    urls = len({r["url"] for r in rows})
    assert len([p for p in progress if p["numInputRows"] > 0]) == 5
    assert kept[-1] <= urls * 0.45 and kept[-1] >= 12  # of thirty days' URLs those of the last week


def test_two_rules_from_one_stream(spark, tmp_dir):
    rng = random.Random(3)
    schema = "url string, event_id long, ts timestamp_ntz, run_start timestamp_ntz, title string, has_body boolean"
    rows = []
    for i in range(400):
        day = rng.randrange(25)
        rows.append({"url": f"u{rng.randrange(40)}", "event_id": i, "ts": BEGIN + day * DAY + timedelta(seconds=rng.randrange(86400)),
                     "run_start": BEGIN + day * DAY, "title": rng.choice(["t", "t", None]), "has_body": rng.choice([True, True, False, None])})
    store, candidates = S.run_two_sinks(spark, landed(spark, os.path.join(tmp_dir, "a"), rows, schema, 5))
    got = spark.read.parquet(store)
    first, last, admitted = {}, {}, []
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        first.setdefault(r["url"], r["event_id"])
    fits = [r for r in rows if r["has_body"] and r["title"] is not None]
    seen = set()
    for r in sorted(fits, key=lambda r: (r["run_start"], r["ts"], r["event_id"])):
        if (r["url"], r["run_start"]) in seen:
            continue
        seen.add((r["url"], r["run_start"]))
        if r["url"] not in last or last[r["url"]] < r["run_start"] - 5 * DAY:
            admitted.append((r["url"], r["event_id"]))
            last[r["url"]] = r["ts"]
    assert sorted((r.url, r.event_id) for r in got.collect()) == sorted(first.items())
    assert sorted((r.url, r.event_id) for r in spark.read.parquet(candidates).collect()) == sorted(admitted)
    assert got.select("batch_id").distinct().count() > 1 and got.groupBy("url").count().where(F.col("count") > 1).count() == 0
