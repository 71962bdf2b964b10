import random

from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import docs_frame

from newsflux.llm import op8_token_counts as op8

BITS = ["", " ", "  ", "'re", "x", " hello", "\n", "it's 5", "　", "a b c d e f " * 20, "'", "\x1c ", "é"]
count = op8.counter("test", op8.load_ranks)


def applied(text, at, removed, inserted):
    at = min(max(at, 0), len(text))
    return text[:at] + inserted + text[at + max(removed, 0):]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab  '\n\tre5.é　\x1c", max_size=200),
       st.lists(st.tuples(st.integers(-2, 220), st.integers(-1, 60), st.sampled_from(BITS)), max_size=8))
def test_counts_after_edits_are_those_of_a_fresh_encoding(text, edits):
    old, op8.LEAF_CHARS = op8.LEAF_CHARS, 12
    try:
        tree = op8.SegmentTree.of(text, count)
        for at, removed, inserted in edits:
            want = applied(text, at, removed, inserted)
            text, _ = tree.edit(text, at, removed, inserted, count)
            assert text == want and tree.total == (len(want), count(want))
    finally:
        op8.LEAF_CHARS = old


def test_only_touched_regions_are_encoded():
    rng = random.Random(5)
    text = " ".join(f"word{rng.randrange(1000)}" for _ in range(20000))
    read = []
    tree = op8.SegmentTree.of(text, count)
    text, again = tree.edit(text, 70000, 3, "new words", lambda t: read.append(len(t)) or count(t))
    assert sum(read) == again <= 4 * op8.LEAF_CHARS and tree.total[1] == count(text)


def test_tables(spark):
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, "no edits here"), (None, "a null id"),
            (5, "x" * 30000), (6, "long text " * 20000)]
    docs = docs_frame(spark, rows)
    trees = op8.build_trees(docs)
    edits = (op8.revision_edits(docs.where("doc_id IS NULL OR doc_id != 4"))
             .unionByName(spark.createDataFrame([(77, 1, 1, 0, 0, "unknown document")],
                                                "doc_id long, key long, seq int, at int, removed int, inserted string")))
    got = op8.apply_edits(docs, trees, edits).collect()
    assert len(got) == len(rows)
    logs = {}
    for e in sorted(edits.collect(), key=lambda e: e.seq):
        logs.setdefault((e.doc_id, e.key), []).append(e)
    keys = {(r.doc_id, r.key) for r in trees.collect()}
    want = []
    for d, t in rows:
        key = next(k for i, k in keys if i == d)
        text = t or ""
        log = logs.get((d, key), [])
        for e in log:
            text = applied(text, e.at, e.removed, e.inserted)
        want.append((d, count(t or ""), count(text), len(log), text))
    assert sorted(((r.doc_id, r.n_tokens_before, r.n_tokens, r.n_edits, r.text) for r in got), key=repr) == sorted(want, key=repr)
    empty = docs_frame(spark, [])
    assert op8.apply_edits(empty, op8.build_trees(empty), op8.revision_edits(empty)).count() == 0


def test_query_counts_equal_fresh_encodings(spark):
    from newsflux.llm.queries import QUERIES
    got = QUERIES["op8_token_counts"](spark, SF_SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        t = docs[r.doc_id] or ""
        assert r.n_tokens_before == count(t)
        n = len(t)
        for at, removed, inserted in ((n // 3, 12, " revised wording, 3rd draft"), (n // 2, 0, f"[{r.doc_id}]"), (n - 40, 25, "")):
            t = applied(t, at, removed, inserted)
        assert r.n_tokens == count(t)
