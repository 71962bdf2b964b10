"""G checks: hand-written page of every site shape through the tokeniser and rules."""

import pytest
from pyspark.sql import functions as F

from newsflux.operators import extract as X
from newsflux.operators.headers import parse_header, source_time
from newsflux.sources.nodes import nodes as tokenise
from newsflux.sources.nodes import parse_html

PAGES = {
    1: ("https://wallstreetcn.example.com/news",
        """<html><body>
        <div class="article article-item"><a href="/articles/1"><img src="t.png"></a>
          <a class="title" href="/articles/1"> Rates rise </a><a class="content"> Summary one </a>
          <div class="left-item"><div class="author"> 来源: Desk A </div></div></div>
        <div class="article article-item"><a href="https://other.example.com/x">x</a>
          <a class="title">Elsewhere</a><a class="content">S2</a></div>
        <div class="article article-item"><a href="/premium/9">p</a><a class="title">Paid</a><a class="content">S3</a></div>
        </body></html>"""),
    2: ("https://wallstreetcn.example.com/articles/1",
        """<html><body><div class="info"><time class="meta-item time"> 2024-01-02 10:00 </time></div>
        <div class="rich-text"><p> First </p><h2>Head</h2><p><img src=" pic.png "></p><p>  </p></div></body></html>"""),
    3: ("http://roll.example.com/",
        """<html><body><div class="list c"><ul>
        <li><span class="t-tit">[财经]</span><a href="http://new.example.com/a1"> Alpha </a></li>
        <li><span class="t-tit">[股票]</span><a href="http://new.example.com/a2">Beta</a></li></ul></div></body></html>"""),
    4: ("http://news.example.com",
        """<html><body><div class="l"><ul><li><a href="http://n.example.com/1.html">one</a><a href="http://n.example.com/x">x</a></li>
        <li><a href="http://tv.example.com/v">tv</a></li><li>no link</li></ul></div>
        <div class="w620"><ul><li><a href="http://n.example.com/2">two</a></li></ul></div></body></html>"""),
    5: ("http://quote.example.com/stocklist.html",
        """<html><body><div class="quotebody"><ul><li><a href="http://quote.example.com/sh600000.html">浦发银行(600000)</a></li>
        <li><a href="http://quote.example.com/sz000001.html">平安银行(000001)</a></li>
        <li><a href="http://quote.example.com/list.html">more</a></li><li><a name="x">no href</a></li></ul></div></body></html>"""),
    6: ("http://quote.example.com/sz150001.html",
        """<html><body><div class="report "><div class="news_list fl">
        <a href="http://f.example.com/1" title="Fund one">Fund one</a><a href="http://f.example.com/more">more</a>
        </div></div></body></html>"""),
    7: ("http://quote.example.com/sh600000.html",
        """<html><body><div class="layout mt10">
        <div class="fl w390 mb10"><h3>个股要闻</h3><a href="http://s.example.com/n1" title="News 1">News 1</a><a href="#">x</a></div>
        <div class="fl w390 mb10"><h3>个股研报</h3><table class="linehleft w100p">
          <tr><td>机构</td><td>评级</td><td>时间</td></tr>
          <tr><td>Broker A</td><td>Buy</td><td><span class="dt">01-02</span><a href="http://r.example.com/1">Report 1</a></td></tr>
          <tr><td>only two</td><td>cells</td></tr></table></div>
        <div class="fr w390 mb10"><h3>公司公告</h3><a href="http://s.example.com/a1" title="Notice 1">Notice 1</a></div>
        <div class="fr w390 mb10"><h3>行业研报</h3><table class="linehleft w100p txtUL">
          <tr><td>Broker B</td><td>Hold</td><td><span class="dt">01-03</span><a href="http://r.example.com/2">Report 2</a></td></tr></table></div>
        </div></body></html>"""),
    8: ("http://quote.example.com/sh120001.html",
        """<html><body><div class="news_list tabExchangeCon"><a href="http://b.example.com/1" title="Bond news">B</a></div>
        <div class="news_list mL10 fr"><a href="http://b.example.com/2" title="Bond notice">N</a></div></body></html>"""),
    9: ("http://finance.example.com/a/1.html",
        """<html><body>
        <div class="date-source"><span class="source"> Span Source </span></div>
        <p class="article-editor">责任编辑：王五 </p>
        <div class="main-title">  Main   title </div>
        <div class="channel-path"><a> 财经 </a></div>
        <div id="artibody"><p>  First   para </p><div><img src="http://img.example.com/banner.png"></div>
          <p><img src=" http://img.example.com/photo.jpg "></p><p>   </p><div>div text is not kept</div>
          <section><p>nested is not a direct child</p></section><p>Last</p></div></body></html>"""),
    10: ("http://new.example.com/a1",
         """<html><head><meta name="_pbtime" content=" 2024-01-03 09:00 "></head><body><div class="LEFT"><h1> Left title </h1>
         <div class="LeftTool"><span data-bosszone="ly"> LY source </span></div>
         <div class="a-src-time"><a> Src  2024-01-04 08:00 </a></div>
         <div class="content-article"><p>P1</p><p><img src="i.png"></p><p> </p></div></div></body></html>"""),
    11: ("http://new.example.com/a2",
         """<html><body><div class="qq_article"><div class="hd"><h1>QQ title</h1></div>
         <div class="a_Info"><span class="a_source">QS</span><span class="a_time">2024-01-05</span>
         <span class="a_author">AU</span><span class="a_catelog">CAT</span></div>
         <div class="bd"><div class="Cnt-Main-Article-QQ">line one<br>line two<br><br>line four</div></div></div></body></html>"""),
    12: ("http://new.example.com/a3", "<html><body><div class='gallery'></div></body></html>"),
    13: ("http://new.example.com/a4", "<html><body><div>nothing</div></body></html>"),
    14: ("http://news.example.com/2024/1.html",
         """<html><body><div class="logonav clearfix"><div class="links"><a>和讯网</a><a>新闻</a></div></div>
         <div class="layout mg articleName">Big   News Today  2024-01-02 10:11:12 Hexun Wang</div>
         <div class="art_context">Lead text <p>First para</p><img src="a.png"><img alt=" Chart " src="b.png">
         <p>Middle</p><p>End para</p> tail words 看全文 more</div></body></html>"""),
    15: ("http://finance.example.com/news/1.html",
         """<html><body><div id="Column_Navigation"><a>财经</a><a>要闻</a></div>
         <div class="left-content"><div class="Info"><div class="time">2024-01-06 07:00</div>
         <div class="source"><img alt="EM Source" src="s.png"></div>
         <span>责任编辑：<a>赵六</a></span></div>
         <div class="AboutCtrl"><span class="cNumShow num">12</span></div></div>
         <div id="ContentBody" class="Body"><p>Only para</p><img src="x.png"></div></body></html>"""),
    16: ("http://data.example.com/notices/1.html",
         """<html><body><div class="content"><div style="text-align: right; margin-right: 50px;">2024-01-07</div>
         <a style="color: #039; text-decoration: underline; font-family: 宋体; font-size: 14px; display: inline-block;" href="http://pdf.example.com/1.pdf">pdf</a>
         <div style="font-size: 14px; line-height: 164.28%; overflow-wrap: break-word; word-wrap: break-word; white-space: pre-wrap;">Notice body</div>
         </div></body></html>"""),
    17: ("http://data.example.com/report/1.html",
         """<html><body><div class="report-infos"><span>Org</span><span>Analyst Z</span></div>
         <div class="report-body Body" id="ContentBody">
         <p style="text-align: center;text-indent:0em;"><img border="0" alt="K line" src="k.png"></p>
         <div class="newsContent"><p>Body one</p><img src="c.png"><p>Body two</p></div></div></body></html>"""),
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in PAGES.items()], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def nodes(pages):
    return tokenise(pages).cache()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*[c for c in ("page_id", "item", "ord", "row") if c in df.columns]).collect()]


def test_tokeniser_repairs_broken_html():
    out = parse_html(1, '<p>a<div>b</div><p>c<script>var s="</p>";</script>&amp;</p><ul><li>x<li>y</ul>')
    tags = [(r[2], r[9]) for r in out]
    assert tags[:4] == [("p", "a"), ("div", "b"), ("p", "c&"), ("script", "")]
    assert [r[9] for r in out if r[2] == "li"] == ["x", "y"]


def test_wallstreet_listing(nodes, pages):
    got = rows(X.wallstreet_listing(nodes, pages).where(F.col("page_id") == 1),
               "sub_url", "url", "title", "summary", "source", "free")
    assert got == [("/articles/1", "https://wallstreetcn.example.com/articles/1", "Rates rise", "Summary one", "Desk A", True),
                   ("https://other.example.com/x", "https://other.example.com/x", "Elsewhere", "S2", None, False),
                   ("/premium/9", "https://wallstreetcn.example.com/premium/9", "Paid", "S3", None, False)]


def test_wallstreet_article(nodes):
    r = X.wallstreet_article(nodes).where("page_id = 2").first()
    assert r.pb_time == "2024-01-02 10:00"
    assert list(r.blocks) == ["First", "Head", "pic.png", ""]


def test_tencent_listing(nodes):
    assert rows(X.tencent_listing(nodes), "category", "url", "title") == [
        ("财经", "http://new.example.com/a1", "Alpha"), ("股票", "http://new.example.com/a2", "Beta")]


def test_hexun_listing(nodes):
    got = X.column_listing(nodes, "l").unionByName(X.column_listing(nodes, "w620"))
    assert sorted(r.url for r in got.collect()) == ["http://n.example.com/1.html", "http://n.example.com/2"]


def test_stock_list(nodes):
    assert rows(X.stock_list(nodes), "stock_market", "stock_id", "stock_name") == [
        ("sh", "600000", "浦发银行"), ("sz", "000001", "平安银行")]


def test_fund_and_bond_links(nodes, pages):
    assert rows(X.fund_links(nodes, pages), "id", "title", "type", "href") == [
        ("150001", "Fund one", "fund_news", "http://f.example.com/1")]
    assert rows(X.bond_links(nodes, pages), "id", "title", "type") == [
        ("120001", "Bond news", "bond_news"), ("120001", "Bond notice", "bond_announce")]


def test_stock_page(nodes, pages):
    assert rows(X.stock_page_links(nodes, pages), "id", "title", "type") == [
        ("600000", "News 1", "stock_news"), ("600000", "Notice 1", "stock_trade_news")]
    assert rows(X.report_tables(nodes), "ji_gou", "ping_ji", "time", "title", "href", "type") == [
        ("Broker A", "Buy", "01-02", "Report 1", "http://r.example.com/1", "个股研报"),
        ("Broker B", "Hold", "01-03", "Report 2", "http://r.example.com/2", "行业研报")]


def test_sina_article(nodes):
    r = X.sina_article(nodes).where("page_id = 9").first()
    assert list(r.blocks) == ["First para", "http://img.example.com/photo.jpg", "Last"]
    assert (r.source, r.author, r.title, r.category) == ("Span Source", "王五", "Main title", "财经")


def test_tencent_layouts(nodes):
    got = {r.page_id: r for r in X.tencent_article(nodes).where("page_id >= 10 and page_id <= 13").collect()}
    assert got[10].layout == "LEFT" and got[10].title == "Left title"
    assert (got[10].source, got[10].pb_time) == ("Src", "2024-01-04 08:00")
    assert list(got[10].blocks) == ["P1", "i.png"]
    assert got[11].layout == "qq_article"
    assert (got[11].title, got[11].source, got[11].pb_time, got[11].author, got[11].category) == \
        ("QQ title", "QS", "2024-01-05", "AU", "CAT")
    assert list(got[11].blocks) == ["line one", "line two", "", "line four"]
    assert got[12].layout == "gallery" and got[13].layout == "other"


def test_hexun_article(nodes, pages):
    r = X.hexun_article(nodes, pages).where("page_id = 14").first()
    assert list(r.cur_source) == ["和讯网", "新闻"]
    assert (r.title, r.pb_time, r.source, r.author) == ("BigNewsToday", "2024-01-02 10:11:12", "Hexun", "Wang")
    blocks = [(b.kind, b.text, b.src) for b in r.blocks]
    assert blocks == [("text", "Lead text ", None), ("text", "First para", None), ("image", "Chart", "b.png"),
                      ("text", "Middle", None), ("text", "End para", None), ("text", "tail words", None)]


def test_header_rules(spark):
    df = spark.createDataFrame([(1, "Big  News Today  2024-01-02 10:11:12 Hexun Wang"),
                                (2, "T 2024-01-02 10:11:12 A B C"), (3, "no time here")], "id int, h string")
    got = {r.id: (r.title, r.pb_time, r.source, r.author) for r in parse_header(df, "h").collect()}
    assert got[1] == ("BigNewsToday", "2024-01-02 10:11:12", "Hexun", "Wang")
    assert got[2] == ("T", "2024-01-02 10:11:12", "A B C", "")
    assert got[3] == (None, None, None, None)
    st = source_time(spark.createDataFrame([(" Src 2024-01-04 08:00 ",), ("one",)], "s string"), "s").collect()
    assert [(r.source, r.pb_time) for r in st] == [("Src", "2024-01-04 08:00"), (None, None)]


def test_em_article(nodes):
    r = X.em_article(nodes).where("page_id = 15").first()
    assert list(r.cur_source) == ["财经", "要闻"]
    assert (r.pb_time, r.source, r.author, r.editor) == ("2024-01-06 07:00", "EM Source", "", "赵六")
    assert (r.comment_list.commenters, r.comment_list.participants) == (12, -1)
    # a single paragraph found at offset 0 still emits the (empty) text before it
    assert [(b.kind, b.text, b.src) for b in r.blocks] == [("text", "", None), ("text", "Only para", None),
                                                           ("image", "", "x.png")]


def test_announcement(nodes):
    r = X.announcement(nodes).where("page_id = 16").first()
    assert (r.anno_time, r.source_pdf_url, r.content) == ("2024-01-07", "http://pdf.example.com/1.pdf", "Notice body")


def test_research_report(nodes, spark):
    types = spark.createDataFrame([(17, "个股研报")], "page_id long, type string")
    r = X.research_report(nodes, types).first()
    assert (r.author, r.img_k_url, r.img_k_alt, list(r.two_img_url)) == ("Analyst Z", "k.png", "K line", ["", ""])
    assert [(b.kind, b.text) for b in r.blocks] == [("text", ""), ("text", "Body one"), ("image", ""),
                                                    ("text", "Body two"), ("text", "")]


def test_wallstreet_items_join_listing_to_pages(nodes, pages):
    got = rows(X.wallstreet_items(nodes, pages), "url", "title", "pb_time", "blocks", "reads")
    got = [(u, t, p, list(b) if b is not None else None, r) for u, t, p, b, r in got]
    assert got == [("https://wallstreetcn.example.com/articles/1", "Rates rise", "2024-01-02 10:00",
                    ["First", "Head", "pic.png", ""], 0),
                   ("https://wallstreetcn.example.com/premium/9", "Paid", None, None, 0)]


def test_gallery_body_in_slide_order(spark):
    slides_html = [
        (101, "<div class='galleryPic'><img src=' s1.jpg '></div><div id='contTxt'><p>one</p><p> uno </p></div>"),
        (102, "<div class='galleryPic'><img src='s2.jpg'></div><div id='contTxt'><p>two</p></div>"),
        (103, "<div id='contTxt'><p>caption only</p></div>")]
    pg = spark.createDataFrame([(i, f"http://g.example.com/1#p={i - 100}", h) for i, h in slides_html],
                               "page_id long, url string, html string")
    nd = tokenise(pg)
    order = spark.createDataFrame([(1, 2, 102), (1, 1, 101), (1, 3, 103)], "gallery_id int, slide int, page_id long")
    got = X.gallery_body(X.gallery_slides(nd), order).first()
    assert list(got.blocks) == ["s1.jpg", "one", "uno", "s2.jpg", "two", "caption only"]


def test_parse_pb_time(spark):
    from newsflux.functions.text import parse_pb_time
    df = spark.createDataFrame([("2024-01-02 10:11:12",), (" 2024-01-02 10:11 ",), ("2024年01月02日 10:11",),
                                ("2024/01/02 10:11",), ("yesterday",)], "s string")
    got = [str(r[0]) if r[0] is not None else None for r in df.select(parse_pb_time("s")).collect()]
    assert got == ["2024-01-02 10:11:12", "2024-01-02 10:11:00", "2024-01-02 10:11:00", "2024-01-02 10:11:00", None]
