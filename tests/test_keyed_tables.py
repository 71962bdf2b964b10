import os
import random

from pyspark.sql import functions as F

from newsflux.operators.keyed_tables import KeyedTable

SCHEMA = "k string, seq long, v string, n long"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(table):
    return {r.k: (r.seq, r.v, r.n) for r in table.read().collect()}


def test_random_merges_equal_a_dictionary(spark, tmp_dir):
    rng = random.Random(1)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    make = lambda n, base: [(f"k{rng.randrange(60)}", base + i, rng.choice("abc"), rng.randrange(9)) for i in range(n)]
    start = make(50, 0)
    table = KeyedTable.create(frame(start), os.path.join(tmp_dir, "t"), "k", ["seq"], buckets=8)
    want = {}
    for k, seq, v, n in start:
        want.setdefault(k, (seq, v, n))
    assert rows_of(table) == want
    for turn in range(3):
        delta = make(20, 100 * (turn + 1))
        fresh = {}
        for k, seq, v, n in delta:
            if k not in want:
                fresh.setdefault(k, (seq, v, n))
        accepted = table.insert_if_absent(frame(delta), ["seq"])
        assert {r.k for r in accepted.collect()} == set(fresh)
        want |= fresh
        delta = make(6, 1000)
        table.update(frame(delta).drop("n"), ["v"], ["seq"])
        for k, _, v, _ in delta:
            if k in want:
                want[k] = (want[k][0], v, want[k][2])
        delta = make(6, 2000)
        table.upsert(frame(delta), ["v", "n"], ["seq"])
        last = {k: (seq, v, n) for k, seq, v, n in delta}
        for k, (seq, v, n) in last.items():
            want[k] = (want[k][0], v, n) if k in want else (seq, v, n)
        gone = {k for k, *_ in make(8, 0)}
        table.delete(frame([(k, 0, "", 0) for k in gone]).select("k"))
        want = {k: x for k, x in want.items() if k not in gone}
        assert rows_of(table) == want
    table.delete(table.read().select("k"))
    assert rows_of(table) == {}


def test_only_touched_buckets_are_read_and_written(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    rows = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("seq"), F.lit("old").alias("v"), F.lit(1).cast("long").alias("n"))
    table = KeyedTable.create(rows, path, "k", ["seq"], buckets=32)
    before = files(path)
    delta = spark.createDataFrame([("k5", 1, "new", 2), ("k77", 2, "new", 2)], SCHEMA)
    touched = table.touched(delta)
    assert 1 <= len(touched) <= 2
    plan = table.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    opened = {r[0].removeprefix("file://") for r in table.read(touched).select(F.input_file_name()).distinct().collect()}
    mine = {f for f in before if any(f"bucket={b}/" in f for b in touched)}
    assert opened == mine and sum(os.path.getsize(f) for f in opened) < sum(map(os.path.getsize, before)) * 0.1
    table.update(delta, ["v"])
    after = files(path)
    assert {f: t for f, t in before.items() if f not in mine} == {f: t for f, t in after.items() if f in before and f not in mine}
    assert all(any(f"bucket={b}/" in f for b in touched) for f in set(after) - set(before))
    assert table.read().where("v = 'new'").count() == 2 and table.read().count() == 4000
    # inserts and appends add files and leave every old one alone
    table.insert_if_absent(spark.createDataFrame([("k5", 9, "x", 0), ("other", 9, "x", 0)], SCHEMA), ["seq"])
    assert after.items() <= files(path).items() and table.read().count() == 4001


def test_null_and_empty(spark, tmp_dir):
    empty = spark.createDataFrame([], SCHEMA)
    table = KeyedTable.create(empty, os.path.join(tmp_dir, "t"), "k", ["seq"], buckets=4)
    assert rows_of(table) == {}
    table.insert_if_absent(empty, ["seq"])
    table.update(empty, ["v"])
    table.delete(empty.select("k"))
    table.insert_if_absent(spark.createDataFrame([("a", 2, None, None), ("a", 1, "first", None)], SCHEMA), ["seq"])
    assert rows_of(table) == {"a": (1, "first", None)}
