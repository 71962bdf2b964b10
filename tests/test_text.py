"""P checks: whitespace rules equal Python's str methods on arbitrary text."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from newsflux.functions import text as T

WS = [chr(c) for c in range(0x10000) if chr(c).isspace()]
alphabet = st.sampled_from(WS + list("ab,:çé中") + ["​", "﻿"])


def py_multi_space(s):
    s = re.sub("\xa0", " ", s)
    return re.sub(r"\s{2,}", " ", s)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=alphabet, max_size=12), min_size=1, max_size=25))
def test_whitespace_rules_match_python(spark, samples):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    out = df.select("i", T.strip_ws("s").alias("strip"), T.remove_multi_space("s").alias("multi"),
                    T.split_ws("s").alias("split"), T.remove_newline("s").alias("nl")).collect()
    for r in out:
        s = samples[r["i"]]
        assert r["strip"] == s.strip()
        assert r["multi"] == py_multi_space(s)
        assert list(r["split"]) == s.split()
        assert r["nl"] == s.replace("\n", " ")


def test_signed_format_matches_python(spark):
    xs = [1.005, -0.125, 2.675, 0.0, -0.0, -0.001, 0.001, 123456789.125, -98765.435, 0.5, 1e-9]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(T.fmt2("x").alias("a"), T.fmt2_signed("x").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [("{:.2f}".format(x), "{:+.2f}".format(x)) for x in xs]


def test_delete_at(spark):
    df = spark.createDataFrame([(["a", "b", "c"], i) for i in range(-1, 5)], "a array<string>, i int")
    got = [list(r[0]) for r in df.select(T.delete_at("a", "i")).collect()]
    assert got == [["a", "b", "c"], ["a", "b", "c"], ["b", "c"], ["a", "c"], ["a", "b"], ["a", "b", "c"]]


def test_unescape_and_tags(spark):
    df = spark.createDataFrame([("<b>A&amp;lt;B</b>&nbsp;&copy;  x",)], "h string")
    assert df.select(T.html_text("h")).first()[0] == "A&lt;B ©  x".replace("  ", " ")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=alphabet, max_size=15), min_size=1, max_size=20))
def test_segment_matches_python_join_split(spark, samples):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: r["seg"] for r in df.select("i", T.segment("s").alias("seg")).collect()}
    assert all(got[i] == " ".join(s.split()) for i, s in enumerate(samples))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=alphabet, max_size=15), min_size=1, max_size=20))
def test_count_tokens_matches_python(spark, samples):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: r["n"] for r in df.select("i", T.count_tokens("s").alias("n")).collect()}
    assert all(got[i] == len(s.split()) for i, s in enumerate(samples))


def test_character_references_and_link_forms(spark):
    from newsflux.functions import urls as U
    from newsflux.sources import pages as P
    rows = [("A &mdash; B&#8217;s &hellip; &#x1F600;&amp;lt; &bogus; &#0; a&b &eacute",
             "A \u2014 B\u2019s \u2026 \U0001F600&lt; &bogus; &#0; a&b &eacute"), ("&", "&"), ("", ""), (None, None), ("&amp;&lt;", "&<")]
    got = spark.createDataFrame(rows, "x string, want string").select(T.unescape_html("x").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got
    html = """<a href='/x'>1</a><A HREF="/y?a=1&amp;b=2">2</A><a class="q>r" href=/z>3</a><a name=n>4</a><abbr href="no">"""
    row = spark.createDataFrame([(html,)], "h string").select(P.links("h").alias("l")).first()
    assert row.l == ["/x", "/y?a=1&b=2", "/z"]
    urls = [("http://news.cctv.com/a", True), ("http://tv.hexun.com/a", False), ("http://blog.x.example.com/a", False),
            ("http://x.com/index.html", False), ("/blog.html", True), ("http://myblog.example.com/", True)]
    df = spark.createDataFrame(urls, "u string, want boolean").select(U.is_comparable("u").alias("ok"), "want")
    assert all(r.ok == r.want for r in df.collect())
    links = [("http://q/sh600000.html", "sh600000"), ("http://q/sz1.html?x=1#y", "sz1"), ("/a.html/b.html", "b"), ("/a/b", "")]
    df = spark.createDataFrame(links, "u string, want string").select(U.code_from_link("u").alias("c"), "want")
    assert all(r.c == r.want for r in df.collect())
