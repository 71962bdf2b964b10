import numpy as np
from pyspark.sql import functions as F

from newsflux.operators import ranking as R


def frames(spark, items, readers):
    a = spark.createDataFrame(items, "item_id long, vector array<double>")
    r = spark.createDataFrame(readers, "user_id long, vector array<double>, seen array<long>")
    return a, r


def brute(items, readers, size, k=10):
    fine = lambda v: v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and np.any(v)
    items = {i: np.array(v) / np.linalg.norm(v) for i, v in items if i is not None and fine(v)}
    out = {}
    for u, v, seen in readers:
        if u is not None and fine(v):
            q = np.array(v) / np.linalg.norm(v)
            s = sorted((-round(float(q @ x), 9), i) for i, x in items.items() if i not in (seen or []))
            out[u] = [(i, -c) for c, i in s[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.user_id, r.pos)):
        out.setdefault(r.user_id, []).append((r.item_id, r.score))
    return out


def same(a, b):
    assert {u: [i for i, _ in v] for u, v in a.items()} == {u: [i for i, _ in v] for u, v in b.items() if v}
    assert all(abs(x - y) < 1e-6 for u in a for (_, x), (_, y) in zip(a[u], b[u], strict=True))


def grouped(n, groups, size, spread, seed):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((groups, size))
    return [(i, (c[i % groups] + spread * rng.standard_normal(size)).tolist()) for i in range(n)]


def test_equals_scoring_everything_and_skips_lists(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 40)
    monkeypatch.setattr(R, "CHUNK_ROWS", 15)
    items = grouped(1500, 30, 16, 0.15, 1)
    readers = [(u, [x + 0.1 for x in items[u * 7][1]], [u * 7, u * 7 + 30]) for u in range(60)]
    a, r = frames(spark, items, readers)
    out = R.topk(a, r, 10, lists=30)
    same(got(out), brute(items, readers, 16))
    share = out.select("user_id", "n_scored").distinct().agg(F.sum("n_scored")).first()[0] / (1500 * 60)
    assert share <= 0.15  # of all pairs


def test_vectors_without_structure(spark):
    rng = np.random.default_rng(2)
    items = [(i, rng.standard_normal(32).tolist()) for i in range(400)]
    readers = [(u, rng.standard_normal(32).tolist(), [u]) for u in range(20)]
    a, r = frames(spark, items, readers)
    same(got(R.topk(a, r, 7)), brute(items, readers, 32, 7))


def test_awkward_rows(spark):
    v = [1.0, 2.0, 2.0]
    items = [(1, v), (2, v), (3, [2.0, 4.0, 4.0]), (4, None), (5, [0.0] * 3), (6, [1.0, None, 1.0]), (7, [float("nan"), 1.0, 1.0]),
             (8, [1.0, 2.0]), (None, v), (9, [-1.0, -2.0, -2.0]), (10, [0.0, 1.0, 0.0]), (1, v)]
    readers = [(1, v, None), (2, v, [1, 3]), (3, [0.0] * 3, []), (None, v, []), (4, None, []), (5, [0.0, 0.0, 1.0], [1, 2, 3, 9, 10]), (1, v, None)]
    a, r = frames(spark, items, readers)
    same(got(R.topk(a, r, 3)), brute(items, readers, 3, 3))
    assert got(R.topk(a.where("false"), r)) == {} and got(R.topk(a, r.where("false"))) == {}


def test_user_vector_is_the_sum_of_the_history(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "item_id long, vector array<float>")
    reads = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 2, 3), (8, 5, 1)], "user_id long, item_id long, pos long")
    got_ = R.user_vectors(reads, a).collect()
    assert [(r.user_id, r.vector, r.seen) for r in got_] == [(7, [1.0, 4.0], [1, 2])]


def test_a_block_is_scored_in_slices():
    import tracemalloc

    import pyarrow as pa
    from newsflux.operators import ranking as RANK
    n, size = 4096, 8
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(2 * n, size))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    packed = [x.tobytes() for x in unit]
    left = pa.table({"item_id": pa.array(range(n), pa.int64()), "unit": pa.array(packed[:n], pa.binary())})
    right = pa.table({"user_id": pa.array(range(n), pa.int64()), "unit": pa.array(packed[n:], pa.binary()),
                      "seen": pa.array([[i] for i in range(n)], pa.list_(pa.int64()))})
    tracemalloc.start()
    got = RANK.best_of_block(left, right, size, 3, "item_id", "user_id")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * n // 2  # less than half of the whole matrix of cosines
    score = np.round(unit[n:] @ unit[:n].T, 9)
    np.fill_diagonal(score, -np.inf)
    assert got["item_id"].to_pylist() == np.argsort(-score, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_a_reader_goes_to_groups_of_lists(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = [(i, rng.standard_normal(32).tolist()) for i in range(400)]
    readers = [(u, rng.standard_normal(32).tolist(), [u]) for u in range(20)]
    visits, stored = [], R._stored

    def counted(df, name):
        out = stored(df, name)
        if name == "ranking-visits":
            visits.append(out.count())
        return out

    monkeypatch.setattr(R, "_stored", counted)
    a, r = frames(spark, items, readers)
    out = R.topk(a, r, 7, lists=16)
    same(got(out), brute(items, readers, 32, 7))
    assert {x.n_scored for x in out.select("n_scored").collect()} == {400}  # nothing is left out
    assert sum(visits) <= 2 * len(readers)  # not a row for each of 16 lists


def test_a_block_of_several_lists(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(5)
    n, m, size, k = 300, 40, 6, 4
    base = rng.normal(size=(60, size))
    unit = base[rng.integers(0, 60, n)] / np.linalg.norm(base, axis=1).max()  # equal vectors in other lists
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    users = rng.normal(size=(m, size))
    users /= np.linalg.norm(users, axis=1)[:, None]
    ids, lists = rng.permutation(n).astype(str).tolist(), rng.choice([2, 5, 9], n)
    asked = [rng.choice([2, 5, 7, 9], rng.integers(0, 4), replace=False).tolist() for _ in range(m)]
    seen = [None if u % 7 == 0 else [*rng.choice(ids, 30).tolist(), None, "not there, and long"] for u in range(m)]
    score = np.round(users @ unit.T, 9)
    want = []
    for u in range(m):
        mine = sorted((-score[u, i], ids[i]) for i in range(n) if lists[i] in asked[u] and ids[i] not in (seen[u] or []))
        want += [(u, x, -s) for s, x in mine[:k]]
    kth = [None] * m
    left = pa.table({"item_id": ids, "unit": [x.tobytes() for x in unit], "list": pa.array(lists, pa.int32())})
    for cells in (1 << 20, 50):
        monkeypatch.setattr(R, "CELLS", cells)
        right = pa.table({"user_id": range(m), "unit": [x.tobytes() for x in users], "seen": pa.array(seen, pa.list_(pa.string())),
                          "lists": pa.array(asked, pa.list_(pa.int32())), "kth": pa.array(kth, pa.float64())})
        found = R.best_of_block(left, right, size, k, "item_id", "user_id").to_pylist()
        assert [(r["user_id"], r["item_id"]) for r in found] == [w[:2] for w in want]
        assert all(abs(r["score"] - w[2]) < 1e-12 for r, w in zip(found, want, strict=True))
        # once more with the bound that a round hands on
        last = {w[0]: w[2] for w in want}
        kth = [last.get(u) if u % 2 else None for u in range(m)]
