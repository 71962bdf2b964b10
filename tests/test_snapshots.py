"""K1 across runs: snapshots in the shared folder, first write wins across commits."""

from pyspark.sql import functions as F

from newsflux.operators import snapshots


def test_first_write_wins_across_commits(spark, tmp_dir):
    d1 = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, seq int, v string")
    d2 = spark.createDataFrame([("a", 0, "late"), ("c", 5, "w")], "k string, seq int, v string")
    s1 = snapshots.merge_first_writes(d1, "t", "k", ["seq"], base=tmp_dir)
    assert sorted(map(tuple, s1.collect())) == [("a", 1, "x"), ("b", 3, "z")]
    s2 = snapshots.merge_first_writes(d2, "t", "k", ["seq"], base=tmp_dir)
    assert sorted(map(tuple, s2.collect())) == [("a", 1, "x"), ("b", 3, "z"), ("c", 5, "w")]
    assert len(snapshots.versions(spark, "t", base=tmp_dir)) == 2
    assert sorted(map(tuple, snapshots.current(spark, "t", base=tmp_dir).collect())) == \
        sorted(map(tuple, s2.collect()))


def test_partitioned_commit_prunes_days(spark, tmp_dir):
    df = spark.createDataFrame([("u1", "2024-01-01"), ("u2", "2024-01-09")], "url string, day string")
    snap = snapshots.commit(df, "pool", base=tmp_dir, partition_by=["day"])
    old = snap.where(F.col("day") < "2024-01-05")
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and [r.url for r in old.collect()] == ["u1"]
