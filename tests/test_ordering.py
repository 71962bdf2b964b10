"""P checks: skew-safe numbering equals row_number; pool invariants; stream == batch."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from newsflux.operators import pool
from newsflux.operators.ordering import number_within
from newsflux.plans import catalog
from newsflux.sources.tables import Tables
from newsflux.streaming import streams as S


def test_number_within_matches_row_number_on_a_hot_key(spark):
    # one key holds half of all rows
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 37).alias("k"),
        (F.col("id") * 7919 % 4001).alias("v"))
    got = number_within(df, ["k"], ["v"], partitions=8)
    ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("v")).cast("bigint"))
    assert sorted(map(tuple, got.select("k", "v", "pos").collect())) == \
        sorted(map(tuple, ref.select("k", "v", "pos").collect()))


def test_pool_holds_one_row_per_url(spark):
    t = Tables(spark, SF_SMALL)
    p = catalog._pool(t)
    assert p.count() == p.select("url").distinct().count()


def test_admission_gaps_exceed_horizon(spark):
    adm = catalog._admissions(Tables(spark, SF_SMALL))
    w = Window.partitionBy("url").orderBy("db_time")
    gaps = adm.select(F.col("run_start"), F.lag("db_time").over(w).alias("prev")).where("prev is not null")
    assert gaps.where(F.col("prev") >= F.col("run_start") - F.expr("INTERVAL 5 DAYS")).count() == 0


def test_pool_stream_over_many_files_equals_batch(spark, tmp_dir):
    """B check: events landed as several files, drained in several micro-batches."""
    t = Tables(spark, SF_SMALL)
    land = os.path.join(tmp_dir, "events")
    ev = t.events()
    (ev.withColumn("f", (F.col("event_id") / 300).cast("int"))
     .repartition("f").sortWithinPartitions("event_id")
     .write.partitionBy("f").parquet(land))
    # flatten into one landing folder, files in time order
    files = []
    for d in sorted(os.listdir(land), key=lambda x: int(x.split("=")[1]) if "=" in x else -1):
        sub = os.path.join(land, d)
        if os.path.isdir(sub):
            files += [os.path.join(sub, f) for f in sorted(os.listdir(sub)) if f.endswith(".parquet")]
    flat = os.path.join(tmp_dir, "flat")
    os.makedirs(flat)
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"part-{i:05d}.parquet"))
    stream = S.file_stream(spark, flat, ev.drop("f").schema if "f" in ev.columns else ev.schema)
    n_pages = t.pages("page_id").count()
    crawls = (stream.withColumn("page_id", F.col("event_id") % n_pages)
              .withColumn("run_start", F.date_trunc("DAY", "ts").cast("timestamp_ntz"))
              .join(catalog._pool_articles(t).select("page_id", "url"), "page_id"))
    sink = S.run_pool_stream(spark, crawls.select("url", "ts", "run_start", "event_id"))
    got = S.read_admissions(spark, sink).select("url", "db_time", "event_id")
    ref = catalog._admissions(t).select("url", "db_time", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_expired_counts_handle_gaps_between_runs(spark):
    adm = spark.createDataFrame([("u1", "2024-01-01 10:00:00"), ("u2", "2024-01-02 10:00:00")],
                                "url string, t string").selectExpr(
        "url", "cast(t as timestamp_ntz) as db_time", "cast(date_trunc('DAY', cast(t as timestamp_ntz)) as timestamp_ntz) as run_start")
    runs = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-12",)], "d string").selectExpr(
        "cast(cast(d as timestamp) as timestamp_ntz) as run_start")
    got = pool.expired_counts(adm, runs).collect()
    assert [(str(r.run_start), r.n_expired) for r in got] == [("2024-01-12 00:00:00", 2)]


def _land_events_as_files(spark, t, tmp_dir, rows_per_file=300):
    ev = t.events()
    land = os.path.join(tmp_dir, "events")
    (ev.withColumn("f", (F.col("event_id") / rows_per_file).cast("int"))
     .repartition("f").sortWithinPartitions("event_id").write.partitionBy("f").parquet(land))
    flat = os.path.join(tmp_dir, "flat")
    os.makedirs(flat)
    i = 0
    for d in sorted((x for x in os.listdir(land) if "=" in x), key=lambda x: int(x.split("=")[1])):
        for f in sorted(os.listdir(os.path.join(land, d))):
            if f.endswith(".parquet"):
                os.link(os.path.join(land, d, f), os.path.join(flat, f"part-{i:05d}.parquet"))
                i += 1
    return S.file_stream(spark, flat, ev.schema, max_files=3)


def test_reads_stream_over_many_files_equals_batch(spark, tmp_dir):
    from newsflux.operators import profiles as M
    from newsflux.sources import derived
    t = Tables(spark, SF_SMALL)
    stream = _land_events_as_files(spark, t, tmp_dir)
    n_pages = t.pages("page_id").count()
    reads = (stream.withColumn("page_id", F.col("event_id") % n_pages)
             .join(t.pages("page_id", "url"), "page_id").select("user_id", "ts", "event_id", "url"))
    got = S.read_history(spark, S.run_reads_stream(spark, reads)).select("user_id", "pos", "event_id")
    ref = M.recent_reads(derived.crawl_log(t).select("user_id", "ts", "event_id", "url")).select(
        "user_id", "pos", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_first_write_and_registration_with_a_hot_key(spark):
    """A third of all rows share one key: results equal the brute-force answer."""
    from newsflux.operators import keyed
    from newsflux.operators import profiles as M
    n = 3000
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 97}", f"v{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "seq int, k string, v string")
    got = {r.k: (r.seq, r.v) for r in keyed.first_write_wins(df, "k", ["seq"]).collect()}
    want = {}
    for seq, k, v in rows:
        want.setdefault(k, (seq, v))
    assert got == want
    # email is a function of the username; three of five users share one hot email (60% of rows)
    email = {f"user{u}": ("hot@example.com" if u < 3 else f"e{u}@x") for u in range(5)}
    su_rows = [(i, (i * 7919) % n, f"user{(i * 31) % 5}") for i in range(n)]
    su = spark.createDataFrame([(i, ts, u, email[u]) for i, ts, u in su_rows],
                               "event_id long, ts long, username string, email string")
    codes = {r.event_id: r.code for r in M.register(su).collect()}
    taken_u, taken_e, want = set(), set(), {}
    for i, ts, u in sorted(su_rows, key=lambda r: (r[1], r[0])):
        e = email[u]
        if u in taken_u:
            want[i] = -3
        elif e in taken_e:
            want[i] = -4
        else:
            want[i] = 1
            taken_u.add(u)
            taken_e.add(e)
    assert codes == want


def test_signup_log_holds_usernames_with_several_emails(spark):
    """The input that register() must not assume away occurs in the log."""
    from newsflux.sources import derived
    per_user = derived.signups(Tables(spark, SF_SMALL)).groupBy("username").agg(F.count_distinct("email").alias("n"))
    assert per_user.where("n > 1").count() > 0


def test_article_stream_over_many_files_equals_batch(spark, tmp_dir):
    """Duplicates spread over several micro-batches; first write wins across batches."""
    t = Tables(spark, SF_SMALL)
    docs = t.documents("doc_id", "text", "source", "lang")
    land = os.path.join(tmp_dir, "docs")
    (docs.withColumn("f", (F.col("doc_id") / 40).cast("int")).repartition("f")
     .sortWithinPartitions("doc_id").write.partitionBy("f").parquet(land))
    flat = os.path.join(tmp_dir, "dflat")
    os.makedirs(flat)
    i = 0
    for d in sorted((x for x in os.listdir(land) if "=" in x), key=lambda x: int(x.split("=")[1])):
        for f in sorted(os.listdir(os.path.join(land, d))):
            if f.endswith(".parquet"):
                os.link(os.path.join(land, d, f), os.path.join(flat, f"part-{i:05d}.parquet"))
                i += 1
    stream = S.file_stream(spark, flat, docs.schema, max_files=1)
    sink = S.run_article_stream(spark, stream, catalog.routes_df(spark))
    got = spark.read.parquet(sink)
    assert got.select("batch_id").distinct().count() > 1
    ref = catalog.first_write_articles(spark, SF_SMALL)
    assert sorted(map(tuple, got.select("text_key", "doc_id").collect())) == \
        sorted(map(tuple, ref.select("text_key", "doc_id").collect()))


def test_number_within_carries_runs_across_arrow_batches(spark):
    """Tiny Arrow batches: a hot key's run spans many batches and partitions; null keys number too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 1500).select(
            F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(1))
            .otherwise(F.col("id") % 11).cast("bigint").alias("k"),
            F.col("id").alias("v"))
        got = number_within(df, ["k"], ["v"], partitions=6)
        ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("v")).cast("bigint"))
        assert sorted(map(tuple, got.select("k", "v", "pos").collect()), key=repr) == \
            sorted(map(tuple, ref.select("k", "v", "pos").collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_expired_counts_for_runs_off_midnight(spark):
    adm = spark.createDataFrame([("u1", "2024-01-01 06:30:00"), ("u2", "2024-01-01 07:00:00"), ("u3", "2024-01-20 06:00:00")],
                                "url string, t string").selectExpr("url", "cast(t as timestamp_ntz) as db_time")
    runs = spark.createDataFrame([(f"2024-01-{d:02d} 06:00:00",) for d in (1, 5, 6, 7, 25)], "d string").selectExpr(
        "cast(d as timestamp_ntz) as run_start")
    got = pool.expired_counts(adm, runs).collect()
    # u1 and u2 are due on the 6th after 06:00, so the run of the 7th purges them; u3 is due at a run's very start: kept
    assert [(str(r.run_start), r.n_expired) for r in got] == [("2024-01-07 06:00:00", 2)]


def test_numbering_of_null_keys_across_partitions(spark):
    df = spark.createDataFrame([(None if i % 2 else "k", i) for i in range(2000)], "k string, o int")
    got = number_within(df, ["k"], ["o"], partitions=5)
    for key in (None, "k"):
        rows = sorted((r.o, r.pos) for r in got.where(F.col("k").eqNullSafe(key)).collect())
        assert [p for _, p in rows] == list(range(1, 1001))


def test_registration_with_free_pairs(spark):
    from newsflux.operators import profiles as M

    def codes(rows):
        df = spark.createDataFrame(rows, "event_id long, ts long, username string, email string")
        return [c for _, c in sorted((r.event_id, r.code) for r in M.register(df).collect())]

    def replay(rows):
        users, mails, out = set(), set(), {}
        for i, ts, u, e in sorted(rows, key=lambda r: (r[1], r[0])):
            out[i] = -3 if u in users else -4 if e in mails else 1
            if out[i] == 1:
                users.add(u)
                mails.add(e)
        return [out[i] for i in sorted(out)]

    assert codes([(1, 1, "u1", "e1"), (2, 2, "u1", "e2"), (3, 3, "u2", "e2")]) == [1, -3, 1]
    import random
    rng = random.Random(3)
    for n, users, mails in ((60, 8, 8), (200, 40, 15), (120, 3, 60)):
        rows = [(i, rng.randrange(n), f"u{rng.randrange(users)}", f"e{rng.randrange(mails)}") for i in range(n)]
        assert codes(rows) == replay(rows)
    assert codes([]) == []
    # NULL is a value like any other: one profile may lack it
    assert codes([(1, 1, "u1", None), (2, 2, "u2", "e2")]) == [1, 1]
    assert codes([(1, 1, "u1", None), (2, 2, "u2", None), (3, 3, None, "e3"), (4, 4, None, None), (5, 5, None, "e5")]) == [1, -4, 1, -3, -3]
    rows = [(i, rng.randrange(9), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", "w", None])) for i in range(80)]
    assert codes(rows) == replay(rows)
    assert codes([(1, None, "u", "e"), (2, None, "u", "e2")]) == [1, -3]
