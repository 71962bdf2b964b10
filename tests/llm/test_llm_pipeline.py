"""The pipeline's result equals plain Python versions of its stages."""

import os

import pyarrow.parquet as pq
import sentencepiece
from conftest import SF_SMALL
from llm_cases import common_lines, groups, line_key, quality, shingles

import corpus_pipeline
from newsflux.llm import op2_sentencepiece as op2
from newsflux.llm import op7_quality_rules as op7


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5
    assert all(isinstance(n, str) and callable(f) for n, f in corpus_pipeline.STAGES)


def brute(docs, items):
    rows = [(d, t or "") for d, t in docs
            if quality(t, op7.RULES.max_window_share, op7.RULES.max_line_share, copies=op7.RULES.max_copies_share,
                        copy_words=op7.RULES.max_copy_words)[1]]
    gone = common_lines([t for _, t in rows], 10)
    rows = [(d, "\n".join(x for x in t.split("\n") if line_key(x) not in gone)) for d, t in rows]
    rows.sort()
    sets = [shingles(t, 5) for _, t in rows]
    root = groups(sets, 80)
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    rows = [(d, t) for d, t in rows if not any(i.lower() in t.lower() for i in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=op2.MODEL)
    return {d: library.encode(t) for d, t in rows}


def test_run_equals_plain_python(spark, tmp_dir):
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet")
    want = brute(list(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist())),
                 pq.read_table(f"{SF_SMALL}/benchmark.parquet")["text"].to_pylist())
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got == want and 50 < len(got) < docs.num_rows


def test_stages_on_awkward_tables(spark, tmp_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "en", "s", 1), (2, words, None, None, None), (1, words, "en", "s", 1), (None, words + " x", None, None, 3),
            (3, None, None, None, None), (4, "", "en", "s", 0), (5, "v " * 60 + words.replace("w", "y"), None, None, 9)]
    items = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16")], "item_id long, text string")
    for name, table in (("some", rows), ("none", [])):
        sf = os.path.join(tmp_dir, name)
        items.write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.createDataFrame(table, schema)
        for k, (step, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, sf)
            if k < 4:
                assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), step
            out.write.parquet(f"{sf}/out{k}")
            docs = spark.read.parquet(f"{sf}/out{k}")
        assert {r.doc_id for r in docs.collect()} <= {5}
