"""K2/K5/K7/K8 on small fixtures."""

import pytest
from pyspark.sql import functions as F

from newsflux.operators import keyed


def test_route_quarantine_and_strict(spark):
    recs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz")], "id int, kind string")
    routes = spark.createDataFrame([("a", "t_a"), ("b", "t_b")], "kind string, target string")
    got = keyed.route(recs, routes, "kind").collect()
    assert sorted((r.id, r.target, r.reason) for r in got) == [
        (1, "t_a", None), (2, "t_b", None), (3, "quarantine", "no route")]
    with pytest.raises(Exception, match="no route for zz"):
        keyed.route(recs, routes, "kind", strict=True).collect()


def test_update_with_several_rows_for_a_key(spark):
    base = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, email string")
    delta = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, seq int, email string")
    got = keyed.update_by_key(base, delta, "k", ["email"], order=["seq"]).collect()
    assert sorted(map(tuple, got)) == [("a", "new"), ("b", "y")]


def test_insert_update_delete(spark):
    base = spark.createDataFrame([("a", "x@1"), ("b", "y@1")], "k string, email string")
    delta = spark.createDataFrame([("b", 2, "y@2"), ("c", 5, "z@5"), ("c", 3, "z@3")], "k string, seq int, email string")
    ins = keyed.insert_if_absent(delta, base, "k", ["seq"], stamp=F.lit("now"))
    assert [(r.k, r.seq, r.email, r.insert_time) for r in ins.collect()] == [("c", 3, "z@3", "now")]
    upd = keyed.update_by_key(base, keyed.last_per_key(delta, "k", ["seq"]).select("k", "email"), "k", ["email"])
    assert sorted(map(tuple, upd.collect())) == [("a", "x@1"), ("b", "y@2")]
    remaining, removed = keyed.delete_by_key(base, spark.createDataFrame([("b",), ("b",), ("q",)], "k string"), "k")
    assert [r.k for r in remaining.collect()] == ["a"] and removed.count() == 1
