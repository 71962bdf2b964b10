from newsflux.llm import op3_merkle_audit as op3

A = [("x", 0, "aa"), ("x", 100, "bb"), ("x", 70000, "cc"), ("x", 5_000_000, "dd"), ("y", 0, None), ("z", 3, "only in a"),
     ("x", 100_000_000, "far"), ("t", 5, "tie 1"), ("t", 5, "tie 2"), ("r", 9, "row"), ("r", 9, "row"), (None, 4, "lost"),
     ("x", None, "lost too")]


def prints(spark, rows):
    return op3.fingerprints(spark.createDataFrame([(*r, "x") for r in rows],
                                                  "archive string, offset long, content string, digest string"))


def found(spark, a, b):
    return {(r.archive, r.offset): (r.length_a, r.length_b, r.status) for r in op3.compare(prints(spark, a), prints(spark, b)).collect()}


def test_equal_replicas_in_any_order(spark):
    assert found(spark, A, A[::-1]) == {}


def test_damage_is_located(spark):
    b = [(a, o, {"bb": "bB", "dd": "d"}.get(t, t)) for a, o, t in A if t not in ("cc", "only in a", "tie 2")]
    b = b[:-3] + b[-2:]  # a repeated row less
    b += [("x", 70001, "shifted"), ("new", 0, "")]
    assert found(spark, A, b) == {
        ("x", 100): (2, 2, "corrupt"), ("x", 5_000_000): (2, 1, "resized"), ("x", 70000): (2, None, "missing"),
        ("x", 70001): (None, 7, "extra"), ("z", 3): (9, None, "missing"), ("new", 0): (None, 0, "extra"),
        ("t", 5): (10, 5, "resized"), ("r", 9): (6, 3, "resized")}


def test_only_mismatching_branches_are_read(spark):
    rows = [("x", i * 70000, f"c{i}") for i in range(600)]
    a, b = prints(spark, rows), prints(spark, [(x, o, "bad" if o == 70000 * 411 else t) for x, o, t in rows])
    levels = op3.depth(a)
    ta, tb = op3.build_tree(a, levels), op3.build_tree(b, levels)
    assert levels == 3 and len(ta) == 5 and ta[-1].count() == 1
    for level, nodes in enumerate(ta[1:], 1):  # one node per level leads to the damage
        assert op3._differing(nodes, tb[level]).count() == 1
    assert [r.offset for r in op3.audit(ta, tb).collect()] == [70000 * 411]


def test_empty_and_unplaced(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [], A[:1]) == {("x", 0): (None, 2, "extra")}
    rows = spark.createDataFrame(A, "archive string, offset long, content string")
    assert op3.unplaced(rows).count() == 2


def test_pages_without_ids_and_repeated_pages(spark):
    pages = [(None, None, None), (1, "u", "h"), (1, "u", "h"), (97, "u", "#x"), (98, None, "long" * 30000), (99, "u", None), (97, "v", "")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, archive string, length int")
    got = {(r.length_a, r.status) for r in op3.compare(*op3.page_archives(df)).collect()}
    size = lambda u, h: 74 + len(u) + len(str(len(h))) + len(h)
    assert got == {(size("u", "#x"), "corrupt"), (size("v", ""), "resized"), (size("", "long" * 30000), "resized"),
                   (size("u", ""), "missing"), (size("u", "h"), "resized")}
