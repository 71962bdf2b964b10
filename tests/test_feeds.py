"""G checks: hand-written payloads of every feed shape."""

import json


from newsflux.functions import urls as U
from newsflux.sources import feeds


def test_json_feed(spark):
    p = json.dumps({"result": {"data": [{"url": "https://a.example.com/1", "title": "T1", "mtime": "1704067260"},
                                        {"url": "https://a.example.com/2", "title": "T2", "mtime": "x"}]}})
    rows = feeds.json_feed(spark.createDataFrame([(p,)], "payload string")).collect()
    assert [(r.url, r.title, r.pb_time) for r in rows] == [
        ("https://a.example.com/1", "T1", "2024-01-01 00:01"), ("https://a.example.com/2", "T2", None)]


def test_js_feed(spark):
    p = "var jsonData = {serverSeconds:1,list:[{title:'Rise',time:1704067200,url:'http://r.example.com/a'}]};"
    rows = feeds.js_feed(spark.createDataFrame([(p,)], "payload string")).collect()
    assert [(r.url, r.title, r.pb_time) for r in rows] == [("http://r.example.com/a", "Rise", "2024-01-01 00:00")]


def test_jsonp_feed_from_gbk_bytes(spark):
    text = 'hx_json1({"result":[{"entityurl":"http://n.example.com/a.html"},{"entityurl":"http://tv.example.com/b"}]})'
    raw = bytearray(text.replace("a.html", "新闻.html").encode("gbk"))
    df = spark.createDataFrame([(raw,)], "raw binary").select(feeds.decode_payload("raw").alias("payload"))
    rows = feeds.jsonp_feed(df).where(U.is_comparable("entityurl")).collect()
    assert [r.entityurl for r in rows] == ["http://n.example.com/新闻.html"]


def test_utf8_payload_stays_utf8(spark):
    raw = bytearray("价格".encode("utf-8"))
    got = spark.createDataFrame([(raw,)], "raw binary").select(feeds.decode_payload("raw")).first()[0]
    assert got == "价格"


def test_manager_rows(spark):
    p = json.dumps({"Result": {"RptManagerList": [
        {"xm": "Li", "xb": "M", "nl": "50", "xl": "MBA", "zw": "CEO", "rzsj": "2015-01-01", "jj": "bio"}]}})
    r = feeds.manager_rows(spark.createDataFrame([(p,)], "payload string")).first()
    assert (r.name, r.sex, r.age, r.edu, r.duty, r.start_time, r.intro) == \
        ("Li", "M", "50", "MBA", "CEO", "2015-01-01", "bio")


def test_code_table_rules(spark):
    lines = [(1, "sh600000:浦发银行"), (2, " sz000001 : 平安银行 "), (3, "bad:line:x"), (4, "noline"),
             (5, "sh600000:Later Name")]
    got = {r.code: r.name for r in feeds.code_table(spark.createDataFrame(lines, "line_no int, line string")).collect()}
    assert got == {"sh600000": "Later Name", "sz000001": "平安银行"}


def test_quotes_and_percent(spark):
    rows = [("sh600000", 'var hq_str_sh600000="浦发银行,10.00,10.00,10.50,0";'),
            ("sz000002", 'var hq_str_sz000002="万科A,5.00,0.00,5.10,0";')]
    got = {r.code: r for r in feeds.quotes(spark.createDataFrame(rows, "code string, payload string")).collect()}
    assert got["sh600000"].name == "浦发银行" and abs(got["sh600000"].percent - 5.0) < 1e-12
    assert got["sz000002"].percent == 0.0


def test_url_rules(spark):
    df = spark.createDataFrame([("/a/1", "https://w.example.com/x/y?q=1"), ("http://o.example.com/z", "https://w.example.com/"),
                                ("b.html", "https://w.example.com/x/y"), ("//cdn.example.com/i", "https://w.example.com/")],
                               "href string, page string")
    got = [r[0] for r in df.select(U.resolve("href", "page")).collect()]
    assert got == ["https://w.example.com/a/1", "http://o.example.com/z", "https://w.example.com/x/b.html",
                   "https://cdn.example.com/i"]
    codes = spark.createDataFrame([("http://quote.example.com/sh600000.html", "浦发(银行)(sh600000)"),
                                   ("http://quote.example.com/sz550001.html", "noparen")], "href string, label string")
    got = codes.select(U.code_from_link("href"), U.name_from_label("label"), U.asset_class(U.code_from_link("href"))).collect()
    assert [tuple(r) for r in got] == [("sh600000", "浦发(银行)", "stock"), ("sz550001", "noparen", "fund")]


def test_references_of_the_standard(spark):
    """The normal and abnormal examples of RFC 3986, 5.4."""
    base = "http://a/b/c/d;p?q"
    cases = {
        "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
        "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
        "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s",
        "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
        "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
        "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
        ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
        "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
        "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
        "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http://a/b/c/g"}
    df = spark.createDataFrame([(h, base) for h in cases], "href string, page string")
    assert {r.href: r.u for r in df.select("href", U.resolve("href", "page").alias("u")).collect()} == cases


def test_references_as_the_standard_library_resolves_them(spark):
    import random
    from urllib.parse import urljoin
    rng = random.Random(8)
    part = lambda: rng.choice(["a", "b.html", "..", ".", "x y", "é", "g;p", ".hid", "a..b"])
    rows = []
    for _ in range(400):
        page = "https://h.example.com" + "".join("/" + rng.choice(["d", "e.html"]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "/", "?k=v/w"])
        ref = rng.choice(["", "/", "./", "../", "//o.example.com/", "http://o.example.com/"]) + "/".join(part() for _ in range(rng.randint(1, 4)))
        rows.append((ref + rng.choice(["", "/", "?q=../x", "#f/.."]), page))
    got = spark.createDataFrame(rows, "href string, page string").select("href", "page", U.resolve("href", "page").alias("u")).collect()
    # the library leaves dot segments of absolute references as they are
    assert [r.u for r in got if "//" not in r.href] == [urljoin(r.page, r.href) for r in got if "//" not in r.href]
    assert spark.createDataFrame([(None, "http://a/"), ("x", None)], rows and "href string, page string").select(
        U.resolve("href", "page").alias("u")).collect() == [(None,), (None,)]


def test_feed_page_bound(spark):
    df = spark.createDataFrame([(p,) for p in range(1, 9)], "page int")
    assert feeds.bounded_pages(df, 5).count() == 5
    assert feeds.bounded_pages(df, None).count() == 8


def test_landed_payload_files(spark, tmp_dir):
    import os
    with open(os.path.join(tmp_dir, "a.txt"), "wb") as fh:
        fh.write('cb({"result":[{"entityurl":"http://n.example.com/股票.html"}]})'.encode("gbk"))
    with open(os.path.join(tmp_dir, "b.txt"), "wb") as fh:
        fh.write('cb({"result":[{"entityurl":"http://n.example.com/ok"}]})'.encode("utf-8"))
    got = feeds.jsonp_feed(feeds.landed_payloads(spark, tmp_dir, "*.txt"), keep=("path",)).collect()
    assert sorted(r.entityurl for r in got) == ["http://n.example.com/ok", "http://n.example.com/股票.html"]


def test_payloads_that_do_not_parse_are_returned(spark):
    from pyspark.sql import Observation
    good = {"json": '{"result":{"data":[{"url":"u","title":"t","mtime":"60"}]}}', "js": "var x = {list:[{title:'t',time:60,url:'u'}]};",
            "jsonp": 'cb({"result":[{"entityurl":"u"}]})', "managers": '{"Result":{"RptManagerList":[{"xm":"n"}]}}'}
    parsers = {"json": feeds.json_feed, "js": feeds.js_feed, "jsonp": feeds.jsonp_feed, "managers": feeds.manager_rows}
    for kind, parse in parsers.items():
        bad = [good[kind][:-12], "", "no payload", None, "{}", "[1]"]
        df = spark.createDataFrame([(i, p) for i, p in enumerate([good[kind], *bad])], "id int, payload string")
        seen = Observation(kind)
        ok, wrong = feeds.split_bad(feeds.watch(parse(df, keep=("id",), bad="bad_record"), "bad_record", seen), "bad_record")
        assert [r.id for r in ok.collect()] == [0], kind
        assert sorted((r.id, r.bad_record) for r in wrong.collect()) == [(i, p or "") for i, p in enumerate(bad, 1)], kind
        assert seen.get == {"n_good": 1, "n_bad": 6}
        assert parse(df, keep=("id",)).count() == 1  # without a place for them they are left out


def test_markup_in_upper_case(spark):
    from newsflux.sources import pages as P
    rows = [(1, "http://h/", "<HTML><TITLE>T</TITLE><ARTICLE CLASS=x><H1>Head</H1><P>One</P><P>Two</ARTICLE>"),
            (2, "http://h/", "<article><p>One</P><P id=a>Two</p ></article>"), (3, "http://h/", "<title >T</title><articles>no</articles>")]
    got = {r.page_id: r for r in P.page_articles(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert (got[1].title, got[1].blocks) == ("Head", ["One", "Two"]) and got[2].blocks == ["One", "Two"]
    assert (got[3].title, got[3].blocks) == ("T", None)
