import random

import pytest
from llm_cases import docs_frame, groups, shingles

from newsflux.llm import op5_ngram_join as op5
from newsflux.llm.graph import components


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    """Families of near copies around the limit, chains of copies, shared
    passages, copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 500}"
    texts = [None, "", "  \n", "one", "One", "two words", "TWO words ", "a b c", "a b c", "É b c", "é b c"]
    for size in (12, 40, 70, 150):
        base = [word() for _ in range(size)]
        texts += family(rng, base, 14, max(2, size // 25))
        chain = base
        for _ in range(8):  # each a little further from the first
            chain = chain[:]
            chain[rng.randrange(len(chain))] = f"c{rng.randrange(10**6)}"
            texts.append(" ".join(chain))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(n)) for n in (0, 1, 2, 3, 4, 6, 9, 30)]
    texts += [texts[20]] * 5
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,n,percent,hubs,few", [(1, 3, 90, 3, 16), (2, 5, 80, 1, 1), (3, 3, 90, 0, 4)])
def test_components_are_those_of_the_full_join(spark, monkeypatch, seed, n, percent, hubs, few):
    monkeypatch.setattr(op5, "HUB_ROUNDS", hubs)
    monkeypatch.setattr(op5, "FEW", few)
    texts = corpus(seed)
    sets = [shingles(t, n) for t in texts]
    want = groups(sets, percent)
    got = {r.doc_id: r for r in op5.link_components(docs_frame(spark, list(enumerate(texts))), n=n, percent=percent).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert got[i].n_shingles == len(s)
        assert got[i].component_id == want[i], (texts[i], texts[want[i]])


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base), (3, base + " x"), (3, base + " x"), (9, "other text of its own here"), (None, base), (7, None), (8, ""),
            (None, "no id but alone"), (4, "x " * 50000 + "long tail")]
    docs = docs_frame(spark, rows)
    out = op5.one_per_group(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
        [(3, base + " x"), (9, rows[3][1]), (7, None), (8, ""), (None, "no id but alone"), rows[8]], key=repr)


def test_empty_table(spark):
    docs = docs_frame(spark, [])
    assert op5.link_components(docs).count() == 0
    assert op5.one_per_group(docs).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(500, 300), (300, 500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and got[500] == 300


def test_linked_sets_share_an_equal_part(spark):
    """Of d + 1 parts at least one is equal, whatever the sizes, and sets meet in the larger one's band."""
    import numpy as np
    import pyarrow as pa

    class Everything:
        value = type("All", (), {"has": staticmethod(lambda keys: np.ones(len(keys), bool))})

    rng = random.Random(11)
    for n, percent in ((1, 90), (2, 80), (1, 60)):
        texts = []
        for size in (1, 2, 5, 9, 10, 11, 30, 31, 80, 200):
            base = [f"w{size}-{i}" for i in range(size)]
            for _ in range(6):
                words = base[:rng.randint(max(1, size * percent // 100), size)]
                texts.append(" ".join([*words, *(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 1 + size // 20)))]))
        sets = [shingles(t, n) for t in texts]
        run = op5._equal_parts(Everything, n, percent, max(map(len, sets)))
        held = {}
        for t in texts:
            rows = [r for b in run(iter([pa.RecordBatch.from_arrays([pa.array([t])], names=["text"])])) for r in b.to_pylist()]
            held[t] = {r["part"] for r in rows}
        linked = 0
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= percent * len(a | b):
                    linked += 1
                    assert held[texts[i]] & held[texts[j]], (texts[i], texts[j])
        assert linked > 60


def test_unlike_texts_of_few_words_are_not_paired(spark, monkeypatch):
    """Texts that share most shingles, none a link: candidates grow about as their number."""
    counts = []
    verify = op5._Verifier.__call__
    monkeypatch.setattr(op5._Verifier, "__call__", lambda self, pairs: (counts.append(pairs.count()), verify(self, pairs))[1])
    totals = []
    for n in (400, 800):
        rng = random.Random(5)
        rows = [(i, " ".join(rng.choice("abcde") for _ in range(60))) for i in range(n)]
        counts.clear()
        got = op5.link_components(docs_frame(spark, rows), n=3, percent=90)
        assert got.select("component_id").distinct().count() == n
        totals.append(sum(counts))
    assert totals[1] <= totals[0] * 2 ** 1.3 and totals[1] < 10 * 800


def near_misses(n, edits, seed=3):
    """Texts that differ from one text by a few words of their own: most pairs are just beyond the limit."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randint(1, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(900)}"
        texts.append(" ".join(words))
    return texts


def test_near_copies_beyond_the_limit_are_not_paired(spark, monkeypatch):
    """Near copies of one text that share equal parts but do not link: candidates grow about as their number."""
    counts = []
    verify = op5._Verifier.__call__
    monkeypatch.setattr(op5._Verifier, "__call__", lambda self, pairs: (counts.append(pairs.count()), verify(self, pairs))[1])
    totals = []
    for n in (300, 600):
        counts.clear()
        texts = near_misses(n, 4)
        got = op5.link_components(docs_frame(spark, list(enumerate(texts))), n=3, percent=90)
        want = groups([shingles(t, 3) for t in texts], 90)
        assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(want))
        totals.append(sum(counts))
    assert totals[1] <= totals[0] * 2 ** 1.5 and totals[1] < 10 * 600


@pytest.mark.parametrize("n,percent,splits", [(3, 90, 2), (5, 80, 1), (1, 90, 3)])
def test_groups_split_by_deviations_keep_every_link(spark, monkeypatch, n, percent, splits):
    for name, value in (("HUB_ROUNDS", 0), ("FEW", 1), ("FEW_EQUAL", 1), ("FEW_SPLIT", 2), ("SPLITS", splits)):
        monkeypatch.setattr(op5, name, value)
    rng = random.Random(n)
    texts = near_misses(60, 5) + corpus(7)[:60] + [" ".join(rng.choice("abcd") for _ in range(14)) for _ in range(30)]
    want = groups([shingles(t, n) for t in texts], percent)
    got = op5.link_components(docs_frame(spark, list(enumerate(texts))), n=n, percent=percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(want))


def test_unlike_sets_do_not_meet_by_empty_or_frequent_parts(spark):
    """Parts of a few shingles are often empty, or hold one that many texts have: unlike texts share neither."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    class Everything:
        value = type("All", (), {"has": staticmethod(lambda keys: np.ones(len(keys), bool))})

    passage = " ".join(f"p{i}" for i in range(12))
    texts = [passage + " " + " ".join(f"w{t}-{i}" for i in range(120)) for t in range(1000)]
    table = [pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]
    counts = np.zeros(1 << op5.RANK_BITS, np.int64)
    for _, s in op5._sets(table[0].column(0), 5):
        counts += np.bincount((s >> np.uint64(64 - op5.RANK_BITS)).astype(np.int64), minlength=len(counts))
    ranks = type("Ranks", (), {"value": np.minimum(np.round(6 * np.log2(1 + counts)), 255).astype(np.uint8)})
    held = Counter()
    for batch in op5._equal_parts(Everything, 5, 80, 128, ranks)(iter(table)):
        held.update(batch.column(1).to_pylist())
    assert max(held.values()) <= 4


def test_centres_are_made_of_few_rows_and_links_stay(spark, monkeypatch):
    """A group's sets are not expanded to find its centre, and the components do not depend on how it is dealt."""
    rows = []
    deviations = op5._by_deviations

    def watched(groups, sets, ranks, percent):
        held = groups.join(sets, "node").select("g", "node", "members")
        run = (held.selectExpr("g", "1000L AS m", "0L AS share", "members").repartition("g").sortWithinPartitions("g")
               .mapInArrow(op5._majorities, "g long, m long, token long, count long"))
        rows.append((held.select("node").count(), run.count()))
        return deviations(groups, sets, ranks, percent)

    monkeypatch.setattr(op5, "_by_deviations", watched)
    texts = near_misses(300, 6, seed=8)
    want = groups([shingles(t, 5) for t in texts], 80)
    for members, shingles_ in ((64, 1 << 20), (3, 500)):
        for name, value in (("HUB_ROUNDS", 0), ("FEW", 4), ("FEW_EQUAL", 1), ("FEW_SPLIT", 4), ("CENTRE_MEMBERS", members),
                            ("CENTRE_SHINGLES", shingles_)):
            monkeypatch.setattr(op5, name, value)
        got = op5.link_components(docs_frame(spark, list(enumerate(texts))), n=5, percent=80)
        assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(want))
    assert rows[0][0] > 200 and rows[0][1] < 4 * 150
