import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_CHECK
from llm_cases import docs_frame, lower

from newsflux.llm import op11_toxicity as op11

CLEAN = ["the water of the lake is cold", "a letter from the town hall", "seven ships left the port at noon", "",
         "bread and butter with some tea", "the long road home"]
TOXIC = ["you are a stupid idiot", "what an idiot, a stupid one", "idiot and clown", "such stupid people, idiot!"]


def plain_features(text):
    """The features as tuples, from their definition."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text or ""))
    first = [w.encode()[:op11.STEM_BYTES] for w in words]
    return ({("w", w) for w in words} | {("s", s) for s in first} | {("p", *p) for p in zip(words, words[1:], strict=False)}
            | {("g", *p) for p in zip(words, words[2:], strict=False)})


def plain_ftrl(rows, passes):
    """FTRL-proximal over dictionaries, row by row."""
    z, n = {}, {}

    def weight(f):
        if f == "b":
            return -z.get(f, 0) / ((op11.BETA + math.sqrt(n.get(f, 0))) / op11.ALPHA)
        s = z.get(f, 0)
        if abs(s) <= op11.L1:
            return 0.0
        return -math.copysign(abs(s) - op11.L1, s) / ((op11.BETA + math.sqrt(n[f])) / op11.ALPHA + op11.L2)

    def score(features):
        return 1 / (1 + math.exp(-sum(weight(f) for f in [*features, "b"])))

    for _ in range(passes):
        for text, label in rows:
            features = plain_features(text)
            g = score(features) - label
            old = {f: weight(f) for f in [*features, "b"]}
            for f, w in old.items():
                before = n.get(f, 0)
                z[f] = z.get(f, 0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / op11.ALPHA * w
                n[f] = before + g * g
    return score


def test_learning_equals_plain_ftrl(spark, monkeypatch):
    monkeypatch.setattr(op11, "L1", 0.5)  # few rows: with the real L1 all weights would be zero
    rows = [(t, 1) for t in TOXIC] * 3 + [(t, 0) for t in CLEAN] * 3
    state = op11.State()
    for _ in range(4):
        for (_, buckets), (_, label) in zip(op11._rows(pa.array([t for t, _ in rows])), rows, strict=True):
            state.learn(buckets, label)
    w = state.weights(slice(0, op11.BUCKETS))
    kept = np.flatnonzero(w)
    model = op11.Model(kept, w[kept], float(state.intercept()))
    plain = plain_ftrl(rows, 4)
    texts = [*TOXIC, *CLEAN, "an idiot on the road", None, "idiot " * 5000]
    assert model.scores(pa.array(texts)) == pytest.approx([plain(plain_features(t)) for t in texts], abs=1e-9)


def test_features_are_those_of_the_definition():
    texts = ["One two,two three", None, "", "...", "éa éa éa", "w " * 30000, "end"]
    got = [len(b) for _, b in op11._rows(pa.array(texts))]
    assert got == [len(plain_features(t)) for t in texts]  # no collision among so few


def test_shards_are_averaged_by_rows(spark):
    """Two equal shards give the state of one."""
    rows = [(t, 1) for t in TOXIC] + [(t, 0) for t in CLEAN]
    parts = lambda n: spark.createDataFrame(spark.sparkContext.parallelize(rows * n, n), "text string, label int")
    a, b = op11._one_round(parts(1), op11.State()), op11._one_round(parts(2), op11.State())
    assert np.allclose(a.z, b.z, atol=1e-4) and np.allclose(a.n, b.n, atol=1e-4)


def test_held_out_rows_are_told_apart_and_most_toxic_ones_found(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    got = {r.doc_id: r for r in op11.assess(docs, labels).collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    clean = [got[i].predicted for i, t in toxic.items() if t == 0]
    learned = [got[i].predicted for i, t in toxic.items() if t == 1 and not got[i].held_out]
    held = [got[i].score for i, t in toxic.items() if t == 1 and got[i].held_out]
    rest = [got[i].score for i, t in toxic.items() if t == 0 and got[i].held_out]
    assert np.mean(clean) <= 0.01 and np.mean(learned) >= 0.85
    assert np.mean([a > b for a in held for b in rest]) >= 0.9  # the chance that a toxic one scores higher


def test_labels_lang_and_source_do_not_reach_a_score(spark):
    rows = [(i, TOXIC[i % 4] if i % 2 else CLEAN[i % 6]) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = docs_frame(spark, rows)
    a = {r.doc_id: r.score for r in op11.assess(docs, labels).collect()}
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    b = {r.doc_id: r.score for r in op11.assess(docs, turned).collect()}
    assert held and a == b


def test_awkward_rows(spark):
    rows = [(i, TOXIC[i % 4]) for i in range(40)] + [(i, CLEAN[i % 6]) for i in range(40, 120)]
    rows += [(200, None), (201, ""), (202, "!!! ..."), (None, "idiot"), (203, "stupid idiot " * 30000), (41, CLEAN[41 % 6])]
    marks = [(i, int(i < 40)) for i in range(120)] + [(5, 1), (7, None), (None, 1), (999, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, toxic int, text string")
    got = op11.assess(docs_frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[200].score == by[201].score == by[202].score and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got) and by[203].score > by[201].score
    none = op11.assess(docs_frame(spark, rows), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert op11.assess(docs_frame(spark, []), labels).count() == 0
