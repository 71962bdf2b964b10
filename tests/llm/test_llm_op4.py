import numpy as np
from conftest import SF_CHECK
from llm_cases import docs_frame

from newsflux.llm import op4_language_id as op4


def test_codewords_differ_in_many_bits():
    for k in (2, 3, 4, 7, 8, 20, 60):
        code = op4.codewords(k).astype(int)
        far = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert set(np.unique(code)) <= {-1, 1} and min(far) >= (1 if k == 2 else 2 ** (k - 2) if k <= 7 else code.shape[1] // 5)
        assert all(set(code[:, b]) == {-1, 1} for b in range(code.shape[1]))
    assert op4.codewords(0).shape == (0, 0) and op4.codewords(1).shape == (1, 0)


def test_a_wrong_bit_is_corrected():
    code = op4.codewords(5)
    model = op4.Model(list("abcde"), code, np.zeros((op4.FEATURES, code.shape[1])), np.full(code.shape, 1 / code.shape[1]))
    for i in range(5):
        for bit in range(code.shape[1]):
            margins = code[i].astype(float) * 3
            margins[bit] *= -1
            assert model.distances(margins[None])[0].argmin() == i


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = {r.doc_id: r for r in op4.identify(docs.select("doc_id", "text", "lang")).collect()}
    import zlib
    right = total = 0
    for r in docs.collect():
        p = got[r.doc_id]
        assert p.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= p.score <= 1
        if p.held_out:
            total += 1
            right += p.lang_pred == r.lang
    assert total > 300 and right / total >= 0.97


def test_awkward_rows(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog and the other words", "en") for i in range(6)]
    rows += [(10 + i, "der schnelle braune fuchs springt über den faulen hund und die anderen wörter", "de") for i in range(6)]
    rows += [(20, None, "en"), (21, "", "de"), (22, "123 !!! ²", "en"), (23, "the", None), (None, "über den hund", "xx"),
             (25, "über den faulen hund " * 20000, None), (26, "日本語", None), (23, "the", None)]
    got = op4.identify(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (20, 21, 22))
    assert by[23].lang_pred == "en" and by[25].lang_pred == "de" and by[None].lang_pred == "de" and not by[None].held_out
    assert by[26].lang_pred in ("en", "de")
    nothing = op4.identify(docs_frame(spark, [(1, "some words", None), (2, None, None)])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    only = op4.identify(docs_frame(spark, [(i, "some words", "en") for i in range(6)])).collect()
    assert {r.lang_pred for r in only} == {"en"}
    assert op4.identify(docs_frame(spark, [])).count() == 0


def _plain_grams(text):
    """Byte n-grams by their definition: runs of anything but letters are one blank."""
    import re
    low = re.sub(rb"[^a-z\x80-\xff]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    framed = b" " + low + b" "
    return [framed[i:i + n] for n in op4.ORDERS for i in range(len(framed) - n + 1)]


def _plain_bucket(gram):
    h = gram[0]
    for b in gram[1:]:
        h = (h * 0x01000193 % 2**32) ^ b
    return ((h ^ (h >> 15)) * (0x2C1B3C6D + 2 * len(gram)) % 2**32) >> 18


def test_equals_plain_classifiers_and_decoding(spark):
    """Counts, log-odds per bit, trust and loss-weighted decoding in plain Python."""
    import math
    import random
    import zlib
    from collections import Counter
    rng = random.Random(3)
    stems = {"en": "the and ing tion of wh", "de": "der und sch ung ei ch", "fr": "le et eau ou ai que", "es": "el y cion os ue ll"}
    rows = [(i, " ".join("".join(rng.choices(stems[g].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(2, 12))).title(), g)
            for i, g in ((i, rng.choice(list(stems))) for i in range(240))]
    learned = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    names = sorted(stems)
    code = op4.codewords(len(names)).tolist()
    bits = range(len(code[0]))
    counts = {g: Counter() for g in names}
    for t, g in learned:
        counts[g].update(_plain_bucket(x) for x in _plain_grams(t))
    total = {g: sum(counts[g].values()) + 0.5 * op4.FEATURES for g in names}

    def odds(bucket, b):
        share = lambda sign: [(counts[g][bucket] + 0.5) / total[g] for g, c in zip(names, code, strict=True) if c[b] == sign]
        one, zero = share(1), share(-1)
        return math.log(sum(one) / len(one)) - math.log(sum(zero) / len(zero))

    known = {}

    def margins(text):
        grams = [_plain_bucket(x) for x in _plain_grams(text)]
        for x in set(grams) - set(known):
            known[x] = [odds(x, b) for b in bits]
        return [sum(known[x][b] for x in grams) / math.sqrt(len(grams)) for b in bits]

    right, seen = {g: [0] * len(bits) for g in names}, Counter(g for _, g in learned)
    for t, g in learned:
        m = margins(t)
        for b in bits:
            right[g][b] += (m[b] > 0) - (m[b] < 0) == code[names.index(g)][b]
    trust = {g: [(right[g][b] + 1) / (seen[g] + 2) for b in bits] for g in names}
    got = {r.doc_id: r for r in op4.identify(docs_frame(spark, rows)).collect()}
    for i, t, _ in rows:
        m = margins(t)
        d = {g: sum(trust[g][b] / sum(trust[g]) * math.log1p(math.exp(-m[b] * c[b])) for b in bits)
             for g, c in zip(names, code, strict=True)}
        best = min(names, key=lambda g: (d[g], g))
        assert got[i].lang_pred == best
        assert abs(got[i].score - 1 / sum(math.exp(-(x - d[best]) * len(bits)) for x in d.values())) < 1e-6
