from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import docs_frame, quality

import pyarrow as pa

from newsflux.llm import common as C
from newsflux.llm import op7_quality_rules as op7

TEXTS = [None, "", " ", "\n", "a b c " * 30, "one two three four five six\n" * 9 + "x " * 60,
         " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + "\nw1 w2 w3 w4 w5 w6 w7 w8",
         "# $ % é日本 " + " ".join(f"é{i}" for i in range(80)), "x" * 200000, "a b\n\n a b\na b\r\na b \n" * 3,
         " ".join(f"w{i % 41}" for i in range(50000))]


def check(texts, got):
    for t, r in zip(texts, got, strict=True):
        base, kept = quality(t, op7.RULES.max_window_share, op7.RULES.max_line_share, copies=op7.RULES.max_copies_share,
                        copy_words=op7.RULES.max_copy_words)
        assert {k: r[k] for k in base} == base, t
        assert r["kept"] == kept, t


def test_rules_equal_plain_python(spark):
    rows = list(enumerate(TEXTS)) + [(2, " ")]
    docs = docs_frame(spark, rows)
    got = sorted(op7.assess(docs).collect(), key=lambda r: r.doc_id)
    want = sorted(rows, key=lambda r: r[0])
    check([t for _, t in want], [r.asDict() for r in got])
    kept = op7.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert op7.assess(docs_frame(spark, [])).count() == 0


def test_long_copies_meet_the_customary_limits(spark):
    def words(n, mark="w"):
        return [f"{mark}{i:03}" for i in range(n)]

    passage, title = words(190, "p"), words(9, "t")
    texts = [" ".join(passage + words(620) + passage),                      # 0 a passage of 190 of 1000 words twice
             " ".join(words(40) + title + words(20, "x") + title),           # 1 one title twice
             " ".join(title + words(30) + title[:6] + words(30, "x") + title[2:8]),  # 2 copies at two places
             " ".join(words(900) + title + words(80, "x") + title),          # 3 a small share
             " ".join(words(100) + title * 2)]                               # 4 one short copy
    got = {r.doc_id: r for r in op7.assess(docs_frame(spark, list(enumerate(texts)))).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {d: r.kept for d, r in got.items()} == {0: False, 1: True, 2: False, 3: True, 4: True}
    for d, t in enumerate(texts):  # the doubled limits alone would keep all of them
        assert quality(t, op7.RULES.max_window_share, op7.RULES.max_line_share)[1], d
        assert quality(t, op7.RULES.max_window_share, op7.RULES.max_line_share, copies=op7.RULES.max_copies_share,
                       copy_words=op7.RULES.max_copy_words)[1] == got[d].kept


def test_query_equals_plain_python(spark):
    from newsflux.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = QUERIES["op7_quality_rules"](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    check([texts[r.doc_id] for r in got], [r.asDict() for r in got])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té|\x0b", max_size=80), min_size=1, max_size=4))
def test_counts_of_any_texts(texts):
    lengths = tuple(n for n, _ in op7.RULES.max_window_share)
    at = 0
    for _, data, offsets in C.text_blocks(pa.array(texts)):
        m = op7._measure(data, offsets, lengths)
        for i in range(len(offsets) - 1):
            base, _ = quality(texts[at], (), 2)
            base.pop("base_failed")
            assert {k: int(m[k][i]) for k in base} == base
            at += 1
    assert at == len(texts)
