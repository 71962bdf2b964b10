import math

import numpy as np
from conftest import SF_CHECK
from pyspark.sql import functions as F

from newsflux.llm import op12_hard_negatives as op12

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, block int, size string, score double"


def brute(rows, anchor, k=5):
    """All scores of all pairs, from (vec_id, components, label)."""
    ints = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = (label if i % 7 else (label + 1) % 10, [math.floor(256 * float(np.float32(x))) for x in e])
        if all(abs(x) < op12.LIMIT for x in v[1]):
            ints[i] = min(v, ints.get(i, v))
    out = []
    for a, (la, va) in ints.items():
        if anchor(a):
            scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, lb) for i, (lb, v) in ints.items()
                            if i != a and len(v) == len(va))
            for ps, p, _ in [s for s in scored if s[2] == la][:k]:
                far = [s for s in scored if s[2] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:k]
                out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, anchor="vec_id % 100 = 0"):
    df = spark.createDataFrame([(*r, 1, 1, "x", 0.5) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in op12.mine(op12.given_rows(df), F.expr(anchor)).collect())


def vectors(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    e = rng.standard_normal((n, size)) * spread + rng.standard_normal(size)
    return [(i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(0, 10))) for i, v in enumerate(e)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op12, "BLOCK_ROWS", 150)
    monkeypatch.setattr(op12, "CHUNK_ROWS", 20)
    rows = vectors(700, 64, 1)
    assert mined(spark, rows, "vec_id % 20 = 0") == brute(rows, lambda i: i % 20 == 0)
    rows = vectors(400, 70, 2, 0.2)  # more than one word per code, scores close to each other
    assert mined(spark, rows, "vec_id % 20 = 0") == brute(rows, lambda i: i % 20 == 0)


def test_intervals_hold_every_score_and_narrow():
    for size in (1, 7, 64, 130):
        rng = np.random.default_rng(size)
        v, q = rng.integers(-256, 256, (300, size)), rng.integers(-256, 256, size)
        codes, aligned, lengths = op12.encode(v)
        anchor, whole = op12.Planes(q), np.linalg.norm(v, axis=1)
        estimate, width, truth = 0.0, [], v @ q
        for k in range(op12.CODES):
            estimate = estimate + aligned[:, k] * anchor.with_codes(codes[:, k])
            off = lengths[:, k] * anchor.length + (whole + lengths[:, k]) * anchor.rounded + 1e-6
            assert (np.abs(estimate - truth) <= off).all()
            width.append(off.mean())
        assert width[-1] < width[0] * 0.5 or size == 1


def test_codes_spare_most_integer_scores(spark, monkeypatch):
    table = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").toPandas()
    v = np.floor(256 * np.stack(table.embedding).astype(float)).astype(np.int32)
    codes, aligned, lengths = op12.encode(v)
    import pyarrow as pa
    blobs = lambda a: pa.array([x.tobytes() for x in np.ascontiguousarray(a)], pa.binary())
    block = op12.Block(pa.table({"size": [64] * len(v), "vec_id": table.vec_id, "label": table.label * 0, "vector": blobs(v),
                                 "codes": blobs(codes), "aligned": blobs(aligned), "lengths": blobs(lengths)}))
    left = [len(block.survivors(block.same(0), v[i], lambda lo, up: up >= op12._kth(lo, 5))) for i in range(0, 500, 25)]
    assert np.mean(left) <= 150  # of 500


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    e = [[float(np.float32(x)) for x in rng.standard_normal(8)] for _ in range(60)]
    rows = [(i, e[i % 7], i % 3) for i in range(120)]  # many equal vectors: ties
    rows += [(3, e[3], 0), (3, e[3], 0), (5, e[9], 9)]  # repeated and clashing ids
    rows += [(None, e[1], 1), (121, None, 1), (122, e[1], None), (123, [0.1, None], 1), (124, [float("nan")] * 8, 1),
             (125, [float("inf")] * 8, 1), (126, [], 2), (200, [], 2), (127, [], 1), (300, [0.5] * 8, 77), (128, [1e30] * 8, 1),
             (400, e[2][:5], 4), (401, e[3][:5], 4), (402, e[2][:5], 5), (500, [-x for x in e[1]], 1), (-100, e[4], 0)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 100 == 0) and len(got) > 20


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16) * 3e5], i % 2) for i in range(200)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 100 == 0)


def test_empty_table(spark):
    assert mined(spark, []) == []
