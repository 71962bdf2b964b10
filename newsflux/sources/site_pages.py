"""Pages in the shapes of the crawled sites, built from the driver tables.

The driver lands generic pages only; the site rules (X1-X21) need pages with the
sites' containers. Each builder makes one page per document, part or supplier
with plain column expressions, whole texts included, so the pages grow with
their table and the SQL oracles can state what a rule must take from them.
Every builder varies the cases its rule distinguishes by the row's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import extract as X
from . import derived
from .tables import Tables


def esc(c) -> Column:
    """Text as HTML."""
    out = F.col(c) if isinstance(c, str) else c
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return out


def cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def when(cond: Column, *parts) -> Column:
    return F.when(cond, cat(*parts)).otherwise("")


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def paragraphs(c: str = "text", tag: str = "p") -> Column:
    """Every line of a text as an element."""
    return F.array_join(F.transform(F.split(esc(F.coalesce(F.col(c), F.lit(""))), "\n", -1),
                                    lambda line: cat(f"<{tag}>", line, f"</{tag}>")), "")


def _page(df: DataFrame, key: Column, url: Column, html: Column, *keep) -> DataFrame:
    return df.select(key.alias("page_id"), url.alias("url"), cat("<html><body>", html, "</body></html>").alias("html"), *keep)


def _docs(t: Tables) -> DataFrame:
    return t.documents("doc_id", "text", "lang", "source")


def wallstreet(t: Tables) -> DataFrame:
    """Listing pages (negative ids) of ten cards each, and the article pages of
    three of four documents."""
    d, k = _docs(t), F.col("doc_id")
    sub = F.when(k % 5 == 3, cat("/premium/", text(k))).when(k % 5 == 4, cat("https://other.example.com/", text(k))) \
        .otherwise(cat("/articles/", text(k)))
    card = cat('<div class="article article-item"><a href="', sub, '"><img src="t.png"></a><a class="title" href="x"> Title ',
               text(k), ' </a><a class="content"> About ', F.col("lang"), " ", text(k), " </a>",
               when(k % 2 == 0, '<div class="left-item"><div class="author"> ' + X.SOURCE_LABEL + " ", F.col("source"), " </div></div>"),
               "</div>")
    cards = (d.select(F.floor(k / 10).alias("n"), k.alias("k"), card.alias("card")).groupBy("n")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda c: c["card"]), "").alias("cards")))
    listing = _page(cards, -1 - F.col("n"), F.lit("https://wallstreetcn.example.com/news"), F.col("cards"))
    article = _page(d.where((k % 4 != 3) & (k % 5 < 3)), k, cat("https://wallstreetcn.example.com/articles/", text(k)), cat(
        '<div class="info"><time class="meta-item time"> 2024-01-02 10:00 #', text(k), ' </time></div><div class="rich-text"><h2> Head ',
        text(k), " </h2>", paragraphs(), '<p><img src=" ', text(k), '.png "></p></div>'))
    return listing.unionByName(article)


def sina(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    body = cat('<div id="artibody">', paragraphs(), '<div><img src="http://img.example.com/banner', text(k), '.png"></div><p><img src=" http://img.example.com/',
               text(k), '.jpg "></p><div>no text of this</div><section><p>nor of this</p></section></div>')
    return _page(_docs(t), k, cat("http://finance.example.com/a/", text(k), ".html"), cat(
        '<div class="date-source">', F.when(k % 2 == 0, cat('<a class="source"> link ', F.col("source"), " </a>")).otherwise(
            cat('<span class="source"> span ', F.col("source"), " </span>")), "</div>",
        when(k % 3 == 0, '<p class="article-editor">责任编辑：editor ', text(k), " </p>"),
        when(k % 5 != 0, '<div class="main-title">  Main   title ', text(k), " </div>"),
        '<div class="channel-path"><a> ', F.col("lang"), " </a><a>x</a></div>", when(k % 7 != 0, body)))


def tencent_lists(t: Tables) -> DataFrame:
    p, k = t.part("p_partkey", "p_name", "p_brand"), F.col("p_partkey")
    item = cat('<li><span class="t-tit">[', F.col("p_brand"), ']</span><a href="http://new.example.com/', text(k), '"> ', esc("p_name"), " </a></li>")
    lists = (p.select(F.floor(k / 20).alias("n"), k.alias("k"), item.alias("item")).groupBy("n")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda c: c["item"]), "").alias("items")))
    return _page(lists, F.col("n"), F.lit("http://roll.example.com/"), cat('<div class="list c"><ul>', F.col("items"), "</ul></div>"))


def tencent(t: Tables) -> DataFrame:
    """Layout by doc_id mod 5: left column, paragraphs, br lines, gallery, none."""
    k = F.col("doc_id")
    info = cat('<div class="hd"><h1> QQ ', text(k), ' </h1></div><div class="a_Info"><span class="a_source">', F.col("source"),
               '</span><span class="a_time">2024-01-05</span><span class="a_author">author ', text(k),
               '</span><span class="a_catelog">', F.col("lang"), "</span></div>")
    left = cat('<div class="LEFT"><h1> Left ', text(k), ' </h1><div class="LeftTool"><span data-bosszone="ly"> LY </span></div><div class="a-src-time"><a>',
               F.when(k % 2 == 0, cat(" ", F.col("source"), "  2024-01-04 08:00 ")).otherwise(" one "), '</a></div><div class="content-article">',
               paragraphs(), '<p><img src=" ', text(k), '.png "></p></div></div>')
    lines = F.array_join(F.split(esc(F.coalesce("text", F.lit(""))), "\n", -1), "<br>")
    return _page(_docs(t), k, cat("http://new.example.com/", text(k)), cat(
        '<meta name="_pbtime" content=" 2024-01-03 09:00 ">',
        F.when(k % 5 == 0, left)
        .when(k % 5 == 1, cat('<div class="qq_article">', info, '<div class="bd">', paragraphs(), "</div></div>"))
        .when(k % 5 == 2, cat('<div class="qq_article">', info, '<div class="bd">', when(k % 2 == 0, "<p> </p>"),
                              '<div class="Cnt-Main-Article-QQ">', lines, "</div></div></div>"))
        .when(k % 5 == 3, cat('<div class="qq_article">', info, '</div><div class="gallery"></div>'))
        .otherwise("<div>nothing</div>")))


def gallery_slides(t: Tables) -> DataFrame:
    """Three slide pages per gallery document (gallery_id, slide)."""
    k, n = F.col("doc_id"), F.col("slide")
    d = _docs(t).where(k % 5 == 3).withColumn("slide", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))))
    return _page(d, k * 4 + n, cat("http://new.example.com/", text(k), "#p=", text(n)), cat(
        when(n != 3, "<div class='galleryPic'><img src=' ", text(k), "-", text(n), ".jpg '></div>"), "<div id='contTxt'>",
        F.when(n == 2, paragraphs()).otherwise(cat("<p> caption ", text(n), " </p>")), "</div>"), k.alias("gallery_id"), n)


def hexun(t: Tables) -> DataFrame:
    """Word-per-paragraph bodies from the first lines, with images between and
    after, and a tail that carries the cut phrase."""
    k = F.col("doc_id")
    return _page(_docs(t), k, cat("http://news.example.com/", text(k), ".html"), cat(
        when(k % 6 != 0, '<div class="logonav clearfix"><div class="links"><a>', F.col("source"), "</a><a>", F.col("lang"), "</a></div></div>"),
        '<div class="layout mg articleName">Big   News ', text(k), "  2024-01-02 10:11:12 ", F.col("source"),
        when(k % 2 == 0, " writer"), '</div><div class="art_context">Lead ', text(k), ' <p>first §', text(k), '§</p><img src="a.png"><img alt=" Chart ',
        text(k), ' " src="b.png">', paragraphs(), "<p>last §§", text(k), "§§</p>", when(k % 3 != 2, " tail words "),
        when(k % 3 == 0, X.CUT_PHRASE + " more"), when(k % 4 == 0, '<img alt="after" src="c.png">'), "</div>"))


def eastmoney(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    return _page(_docs(t), k, cat("http://finance.example.com/news/", text(k), ".html"), cat(
        '<div id="Column_Navigation"><a>', F.col("lang"), "</a><a>", F.col("source"), '</a></div><div class="left-content"><div class="Info"><div class="time">2024-01-06 07:00</div>',
        '<div class="source">', F.when(k % 2 == 0, '<img alt="EM Source" src="s.png">').otherwise(F.col("source")), "</div>",
        when(k % 3 == 0, '<div class="author">writer ', text(k), "</div>"),
        when(k % 4 != 0, "<span>责任" + X.EDITOR_WORD + "：<a>ed ", text(k), "</a></span>"), '</div><div class="AboutCtrl">',
        when(k % 5 != 0, '<span class="cNumShow num">', F.when(k % 5 == 1, "n/a").otherwise(text(k)), "</span>"),
        '<span class="num ml5">', text(k * 2), '</span></div></div><div id="ContentBody" class="Body"><p>only §', text(k),
        '§</p><img src="x.png"></div>'))


def announcements(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    return _page(_docs(t), k, cat("http://data.example.com/notices/", text(k), ".html"), cat(
        '<div class="content"><div style="', X.ANNO_TIME_STYLE, '">2024-01-07 ', text(k), '</div><a style="', X.ANNO_PDF_STYLE,
        '" href="http://pdf.example.com/', text(k), '.pdf">pdf</a><div style="', X.ANNO_BODY_STYLE, '">', esc(F.coalesce("text", F.lit(""))), "</div></div>"))


def research_reports(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    stock = cat('<p style="', X.REPORT_IMG_STYLE, '"><img border="0" alt="K line ', text(k), '" src="k', text(k), '.png"></p>')
    charts = F.concat(*[cat(f'<div class="report-img-cont img-chart{i}"><img src="c{i}-', text(k), '.png"></div>') for i in (1, 2)])
    kind = F.when(k % 2 == 0, X.STOCK_REPORT_WORD).otherwise(X.INDUSTRY_REPORT_WORD)
    return _page(_docs(t), k, cat("http://data.example.com/report/", text(k), ".html"), cat(
        '<div class="report-infos"><span>', F.col("source"), "</span><span>Analyst ", text(k), '</span></div><div class="report-body Body" id="ContentBody">',
        F.when(k % 2 == 0, stock).otherwise(charts), '<div class="newsContent"><p>one §', text(k), '§</p><img src="c.png"><p>two §§', text(k),
        "§§</p></div></div>"), kind.alias("type"))


def br_texts(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    lines = F.array_join(F.split(esc(F.coalesce("text", F.lit(""))), "\n", -1), " <br> ")
    return _page(_docs(t), k, cat("http://x.example.com/", text(k)), cat('<div class="brs">', lines, "</div>"))


def stock_lists(t: Tables) -> DataFrame:
    links = derived.stock_links(t)
    a = cat('<li><a href="', F.col("href"), '">', esc("label"), "</a><a name='x'>no href</a></li>")
    rows = (links.select(F.floor(F.col("line_no") / 50).alias("n"), "line_no", a.alias("a")).groupBy("n")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "a"))), lambda c: c["a"]), "").alias("links")))
    return _page(rows, F.col("n"), F.lit("http://quote.example.com/stocklist.html"), cat('<div class="quotebody"><ul>', F.col("links"), "</ul></div>"))


def _stock_page(t: Tables, html: Column) -> DataFrame:
    p, k = t.part("p_partkey", "p_name", "p_brand", "p_type"), F.col("p_partkey")
    return _page(p, k, cat("http://quote.example.com/", derived.stock_code(k), ".html"), html)


def _link(what: str) -> Column:
    k = text("p_partkey")
    return cat(f'<a href="http://s.example.com/{what}', k, '" title="', esc("p_name"), f" {what}", '">x</a><a href="#">untitled</a>')


def fund_pages(t: Tables) -> DataFrame:
    return _stock_page(t, when(F.col("p_partkey") % 4 != 0, '<div class="report "><div class="news_list fl">', _link("f1"), _link("f2"), "</div></div>"))


def bond_pages(t: Tables) -> DataFrame:
    return _stock_page(t, cat('<div class="news_list tabExchangeCon">', _link("n"), '</div><div class="news_list mL10 fr">', _link("a"), "</div>"))


def stock_pages(t: Tables) -> DataFrame:
    """News and notice boxes, and the two report tables."""
    k = F.col("p_partkey")

    def table(cls: str, kind: str) -> Column:
        row = cat("<tr><td>", F.col("p_type"), "</td><td>", F.col("p_brand"), '</td><td><span class="dt">01-02</span><a href="http://r.example.com/',
                  kind, text(k), '">', esc("p_name"), "</a></td></tr>")
        return cat(f'<table class="{cls}"><tr><td>', X.REPORT_HEADER_WORD, "</td><td>x</td><td>y</td></tr>", row,
                   "<tr><td>only two</td><td>cells</td></tr></table>")

    return _stock_page(t, cat(
        '<div class="layout mt10"><div class="fl w390 mb10"><h3>', X.STOCK_NEWS_WORD, "</h3>", _link("news"), '</div><div class="fl w390 mb10"><h3>',
        X.STOCK_REPORT_WORD, "</h3>", table("linehleft w100p", "s"), '</div><div class="fr w390 mb10"><h3>', X.COMPANY_NOTICE_WORD, "</h3>",
        _link("notice"), "</div>", when(k % 3 != 0, '<div class="fr w390 mb10"><h3>' + X.INDUSTRY_REPORT_WORD + "</h3>",
                                        table("linehleft w100p txtUL", "i"), "</div>"), "</div>"))


def reports_of_parts(t: Tables) -> DataFrame:
    """The report pages that the tables of ``stock_pages`` lead to (their first
    table only; ids are negative)."""
    k = F.col("p_partkey")
    return _page(t.part("p_partkey", "p_brand"), -k - 1, cat("http://r.example.com/s", text(k)), cat(
        '<div class="report-infos"><span>org</span><span>Analyst ', text(k), '</span></div><div class="report-body Body" id="ContentBody"><p style="',
        X.REPORT_IMG_STYLE, '"><img border="0" alt="K" src="k', text(k), '.png"></p><div class="newsContent"><p>one §', text(k), "§ ",
        F.col("p_brand"), "</p></div></div>"))
