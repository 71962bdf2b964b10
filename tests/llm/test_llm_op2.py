import itertools

import numpy as np
import pytest
import sentencepiece
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import docs_frame

from newsflux.llm import op2_sentencepiece as op2

TEXTS = ["", " ", "  a  b ", "Hello world", "\n\tx　é😀 zz", "a" * 700, "日本語テキスト" * 40, "    " * 70, "the" * 300,
         "=-" * 200 + "\x00\x01", "<0x0A> <s> </s> <unk>", "trailing  ", "don't stop\r\nnow"]


@pytest.fixture(scope="module")
def encoder():
    return op2.Encoder(op2.load_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=op2.MODEL)


def ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


def test_ids_equal_the_library(encoder, library):
    for text, raw in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert ids(raw) == library.encode(text)
        assert encoder.decode(raw) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefghij ethn's.,\n▁éßñ中😀0123", max_size=60))
def test_ids_equal_the_library_on_any_text(text):
    coder = test_ids_equal_the_library_on_any_text.coder
    lib = test_ids_equal_the_library_on_any_text.lib
    raw = coder.encode([text])[0]
    assert ids(raw) == lib.encode(text)
    assert coder.decode(raw) == text.replace("▁", " ")


test_ids_equal_the_library_on_any_text.coder = op2.Encoder(op2.load_model())
test_ids_equal_the_library_on_any_text.lib = sentencepiece.SentencePieceProcessor(model_file=op2.MODEL)


def test_unigram_scores_are_maximal():
    texts = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
    scores = np.array([0, -2.0, -3, -3.1, -3.2, -4, -4.5, -6.05, -4.2, -5.9, -4.1])
    kinds = np.array([2] + [1] * 10)
    coder = op2.Encoder(op2.Pieces(texts, scores, kinds, False, True))
    score = dict(zip(texts, scores.tolist()))

    def best(word):
        options = []
        for cut in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cut) if c], len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:])]
            if all(p in score for p in parts):
                options.append(sum(score[p] for p in parts))
        return max(options)

    for n in range(1, 7):
        for chars in itertools.product("abc", repeat=n):
            word = "".join(chars)
            got = ids(coder.encode([word])[0])
            assert "".join(texts[i] for i in got) == "▁" + word
            assert abs(sum(scores[i] for i in got) - best("▁" + word)) < 1e-9
    # unknown characters without byte pieces: one id for a run
    assert ids(coder.encode(["axyb"])[0]) == [texts.index("▁a"), 0, texts.index("b")]


def test_long_words_are_cut_without_change(encoder, library):
    word = "".join(chr(97 + i * i % 26) for i in range(3000))
    assert ids(encoder.encode([word])[0]) == library.encode(word)


def test_table(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "Hello world")]
    got = op2.tokenize(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        for r in by[i]:
            assert r.ids == library.encode(t or "") and r.n_tokens == len(r.ids) and r.round_trip
    assert op2.tokenize(docs_frame(spark, [])).count() == 0
    back = spark.createDataFrame([(1, library.encode("a  b\nç")), (2, None)], "i int, ids array<int>")
    assert {r.i: r.t for r in back.select("i", op2.decoded(spark)("ids").alias("t")).collect()} == {1: "a  b\nç", 2: ""}


def test_query_round_trip(spark):
    from newsflux.llm.queries import QUERIES
    got = QUERIES["op2_sentencepiece"](spark, SF_SMALL)
    assert got.where("NOT round_trip").count() == 0
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
