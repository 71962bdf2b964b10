"""Site rules over tokenised pages.

The reference walks a parse tree per page; here every rule is one column
expression over a page's array of elements (see ``sources/nodes.py``), so that a
page is read, ruled and reported in one pass without joining its elements:

* ``find`` / ``find_all``  = filters on tag / classes / id / attributes;
* "inside a container"     = elements that list the container's ord among their
  ancestors;
* "first match"            = the first element of the filtered array (arrays are
  in document order);
* ordered lists of pieces  = the filtered array itself.

Every rule takes trees (one row per page) or element rows, which it gathers
per page. Class selectors match when the element carries all listed classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..functions import urls as U
from ..session import scratch_path

# --- fixed values -----------------------------------------------------------
CUT_PHRASE = "看全文"             # X10: body text is cut here
EDITOR_WORD = "编辑"              # P28: the span holding the editor link
REPORT_HEADER_WORD = "机构"       # P10: header row of report tables
SOURCE_LABEL = "来源:"            # P23
AD_IMAGE_WORDS = ["banner", "icon"]  # P12
STOCK_NEWS_WORD = "个股要闻"       # X6 box headings
STOCK_REPORT_WORD = "个股研报"
COMPANY_NOTICE_WORD = "公司公告"
INDUSTRY_REPORT_WORD = "行业研报"
ANNO_TIME_STYLE = "text-align: right; margin-right: 50px;"
ANNO_PDF_STYLE = ("color: #039; text-decoration: underline; font-family: 宋体; font-size: 14px; "
                  "display: inline-block;")
ANNO_BODY_STYLE = ("font-size: 14px; line-height: 164.28%; overflow-wrap: break-word; "
                   "word-wrap: break-word; white-space: pre-wrap;")
REPORT_IMG_STYLE = "text-align: center;text-indent:0em;"
# -----------------------------------------------------------------------------

BLOCK = "struct<kind:string,text:string,src:string>"


def trees(nodes: DataFrame) -> DataFrame:
    """(page_id, nodes) from trees (as they are) or from element rows."""
    if "nodes" in nodes.columns:
        return nodes
    fields = [c for c in nodes.columns if c != "page_id"]
    by_ord = lambda a, b: a["ord"] - b["ord"]
    return (nodes.where(F.col("page_id").isNotNull()).groupBy("page_id")
            .agg(F.collect_list(F.struct(*fields)).alias("nodes")).select("page_id", F.array_sort("nodes", by_ord).alias("nodes")))


def _is(n: Column, tag=None, classes: Sequence[str] = (), id=None, attrs: dict | None = None,
        tag_re: str | None = None) -> Column:
    c = F.lit(True)
    if tag is not None:
        c = c & (n["tag"] == tag)
    if tag_re is not None:
        c = c & n["tag"].rlike(tag_re)
    for cl in classes:
        c = c & F.array_contains(n["classes"], cl)
    if id is not None:
        c = c & (n["id"] == id)
    for k, v in (attrs or {}).items():
        c = c & (n["attrs"][k].isNotNull() if v is None else (n["attrs"][k] == v))
    return c


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def every(ns, **sel) -> Column:
    """The matching elements of an array."""
    return F.filter(ns, lambda n: _is(n, **sel))


def one(ns, **sel) -> Column:
    """The first matching element, or NULL (``soup.find``)."""
    return F.get(every(ns, **sel), F.lit(0))


def last(ns, **sel) -> Column:
    return F.try_element_at(every(ns, **sel), F.lit(-1))


def under(ns, box: Column) -> Column:
    """Descendants of the element ``box`` (none when it is NULL)."""
    return let(box["ord"], lambda o: F.filter(ns, lambda n: F.array_contains(n["anc"], o)))


def under_each(ns, boxes: Column) -> Column:
    """Descendants of every element of ``boxes``, one after the other."""
    return F.flatten(F.transform(boxes, lambda b: under(ns, b)))


def once(ns: Column) -> Column:
    """An array of elements in document order without repeats of an ord."""
    return let(ns, lambda a: F.filter(a, lambda n, i: (i == 0) | (n["ord"] != F.get(a, i - 1)["ord"])))


def within(ns, container: dict, *more: dict) -> Column:
    """Descendants of the first ``container``, of the first of the next kind in it, and so on."""
    found = under(ns, one(ns, **container))
    for sel in more:
        found = under(ns, one(found, **sel))
    return found


def _rows(t: DataFrame, structs: Column) -> DataFrame:
    """One row (page_id, fields) per struct of an array."""
    return t.select("page_id", F.explode(structs).alias("_r")).select("page_id", "_r.*")


def _div(*classes: str) -> dict:
    return {"tag": "div", "classes": list(classes)}


def _text(n: Column) -> Column:
    return T.strip_ws(n["text"])


def _src(n: Column) -> Column:
    return T.strip_ws(n["attrs"]["src"])


def find_all(nodes: DataFrame, **sel) -> DataFrame:
    """Every match as a row."""
    return trees(nodes).select("page_id", F.inline(every("nodes", **sel)))


def find(nodes: DataFrame, **sel) -> DataFrame:
    """First match per page (``soup.find``) as a row."""
    return trees(nodes).select("page_id", F.inline(F.slice(every("nodes", **sel), 1, 1)))


def inside(nodes: DataFrame, **container) -> DataFrame:
    """Descendants of a page's first matching element as rows."""
    return trees(nodes).select("page_id", F.inline(within("nodes", container)))


def href(n: Column) -> Column:
    return n["attrs"]["href"]


def _none() -> Column:
    return F.array().cast("array<string>")


# --- listings (S5) ----------------------------------------------------------------

def _wallstreet_cards(ns) -> Column:
    """``div.article.article-item`` cards that hold anything."""
    def card(c: Column) -> Column:
        return let(under(ns, c), lambda d: F.struct(
            c["ord"].alias("item"), F.size(d).alias("size"), href(one(d, tag="a")).alias("sub_url"),
            _text(one(d, tag="a", classes=["title"])).alias("title"),
            _text(one(d, tag="a", classes=["content"])).alias("summary"),
            F.when(F.exists(d, lambda n: _is(n, **_div("left-item"))),
                   T.strip_ws(F.replace(_text(one(d, **_div("author"))), F.lit(SOURCE_LABEL), F.lit("")))).alias("source")))

    return F.filter(F.transform(once(every(ns, **_div("article", "article-item"))), card), lambda r: r["size"] > 0)


def _wallstreet_rows(cards: DataFrame, pages: DataFrame) -> DataFrame:
    out = cards.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    return out.select("page_id", "item", "sub_url", U.resolve("sub_url", "page_url").alias("url"), "title", "summary",
                      "source", F.col("sub_url").startswith("/a").alias("free"))


def wallstreet_listing(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """``div.article.article-item`` cards -> listing rows."""
    return _wallstreet_rows(_rows(trees(nodes), _wallstreet_cards("nodes")), pages)


def tencent_listing(nodes: DataFrame) -> DataFrame:
    """``div.list.c`` -> each ``li``: category ``[x]`` -> ``x``, link, title."""
    def item(ns: Column, li: Column) -> Column:
        return let(under(ns, li), lambda d: F.struct(
            li["ord"].alias("item"), F.size(d).alias("size"),
            let(_text(one(d, tag="span", classes=["t-tit"])), lambda c: c.substr(F.lit(2), F.length(c) - 2)).alias("category"),
            href(one(d, tag="a")).alias("url"), _text(one(d, tag="a")).alias("title")))

    rows = _rows(trees(nodes), let(within("nodes", _div("list", "c")), lambda ns: F.transform(
        once(every(ns, tag="li")), lambda li: item(ns, li))))
    return rows.where("size > 0").select("page_id", "item", "category", "url", "title")


def column_listing(nodes: DataFrame, container_class: str | None = None, tag: str = "div") -> DataFrame:
    """Every ``li`` of every ``div.<class>`` -> its first link, deny-listed out."""
    boxes = F.transform(every("nodes", tag=tag, classes=[container_class] if container_class else []), lambda b: b["ord"])
    lis = let(boxes, lambda os: F.filter("nodes", lambda n: _is(n, tag="li") & F.arrays_overlap(n["anc"], os)))
    # only links are looked at within an item
    rows = _rows(trees(nodes), let(every("nodes", tag="a"), lambda links: F.transform(once(lis), lambda li: F.struct(
        li["ord"].alias("item"), href(F.get(under(links, li), F.lit(0))).alias("url")))))
    return rows.where(F.col("url").isNotNull() & U.is_comparable("url"))


def stock_list(nodes: DataFrame) -> DataFrame:
    """``div.quotebody`` links -> (market, stock_id, stock_name)."""
    links = F.filter(within("nodes", _div("quotebody")), lambda n: _is(n, tag="a", attrs={"href": None}))
    rows = _rows(trees(nodes), F.transform(links, lambda n: F.struct(n["ord"].alias("ord"), U.code_from_link(href(n)).alias("code"),
                                                                     n["text"].alias("text"))))
    return (rows.where(F.length("code") == 8)
            .select("page_id", "ord", F.substring("code", 1, 2).alias("stock_market"),
                    F.substring("code", 3, 6).alias("stock_id"),
                    U.name_from_label("text").alias("stock_name")))


def _titled(found: Column, kind: str) -> Column:
    """The links with a ``title`` attribute among elements."""
    return F.transform(every(found, tag="a", attrs={"title": None}), lambda n: F.struct(
        n["ord"].alias("ord"), n["attrs"]["title"].alias("title"), F.lit(kind).alias("type"), href(n).alias("href")))


def _titled_links(nodes: DataFrame, links: Column, pages: DataFrame) -> DataFrame:
    """Titled links with the id in their page's URL."""
    return (_rows(trees(nodes), links).join(pages.select("page_id", "url"), "page_id")
            .select("page_id", "ord", F.substring("url", -11, 6).alias("id"), "title", "type", "href"))


def fund_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Fund page -> fund news links (pages without the report box yield nothing, P33)."""
    return _titled_links(nodes, _titled(within("nodes", _div("report"), _div("news_list", "fl")), "fund_news"), pages)


def bond_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Bond page -> news links and announcement links."""
    return _titled_links(nodes, F.concat(
        _titled(within("nodes", _div("news_list", "tabExchangeCon")), "bond_news"),
        _titled(within("nodes", _div("news_list", "mL10", "fr")), "bond_announce")), pages)


def _boxes(ns, side: str, word: str, other: str | None = None) -> Column:
    """Boxes of one side of a stock page's layout headed by ``word`` and not by ``other``."""
    boxes = every(within(ns, _div("layout", "mt10")), **_div(side, "w390", "mb10"))
    return F.filter(boxes, lambda b: b["text"].contains(word) & (F.lit(True) if other is None else ~b["text"].contains(other)))


def stock_page_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Stock page -> news (left boxes headed by the stock-news word) and
    announcements (right boxes headed by the company-notice word)."""
    return _titled_links(nodes, F.concat(
        _titled(under_each("nodes", _boxes("nodes", "fl", STOCK_NEWS_WORD)), "stock_news"),
        _titled(under_each("nodes", _boxes("nodes", "fr", COMPANY_NOTICE_WORD)), "stock_trade_news")), pages)


def report_tables(nodes: DataFrame) -> DataFrame:
    """Research-report tables -> (institution, rating, time, title, href, type).

    A box headed by the stock-report word (left column, ``table.linehleft.w100p``)
    or the industry-report word (right column, ``table.linehleft.w100p.txtUL``)."""
    def row(ns: Column, tr: Column, kind: str) -> Column:
        def of(tds: Column) -> Column:
            return let(under(ns, F.get(tds, F.lit(2))), lambda d: F.struct(
                tr["ord"].alias("row"), F.get(tds, F.lit(0))["text"].alias("ji_gou"), F.get(tds, F.lit(1))["text"].alias("ping_ji"),
                one(d, tag="span", classes=["dt"])["text"].alias("time"), one(d, tag="a")["text"].alias("title"),
                href(one(d, tag="a")).alias("href"), F.lit(kind).alias("type"),
                ((F.size(tds) == 3) & ~tr["text"].contains(REPORT_HEADER_WORD) & (F.size(d) > 0)).alias("kept")))
        return let(every(under(ns, tr), tag="td"), of)

    def table(ns, boxes: Column, classes: list[str], kind: str) -> Column:
        # the first table of all boxes in document order
        tables = every(under_each(ns, boxes), tag="table", classes=classes)
        first = F.get(F.array_sort(tables, lambda a, b: a["ord"] - b["ord"]), F.lit(0))
        rows = let(under(ns, first), lambda d: F.transform(once(every(d, tag="tr")), lambda tr: row(d, tr, kind)))
        return F.filter(rows, lambda r: r["kept"])

    return _rows(trees(nodes), F.concat(
        table("nodes", _boxes("nodes", "fl", STOCK_REPORT_WORD, STOCK_NEWS_WORD), ["linehleft", "w100p"], STOCK_REPORT_WORD),
        table("nodes", _boxes("nodes", "fr", INDUSTRY_REPORT_WORD, COMPANY_NOTICE_WORD), ["linehleft", "w100p", "txtUL"],
              INDUSTRY_REPORT_WORD))).drop("kept")


# --- article bodies (S6) ----------------------------------------------------------

def breadcrumb(ns, found: Column) -> Column:
    """Link texts of a navigation container's elements, in order; NULL without links."""
    return let(F.transform(every(found, tag="a"), lambda n: n["text"]), lambda c: F.when(F.size(c) > 0, c))


def sina_article(nodes: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Body of direct ``p*``/``d*`` children of
    ``#artibody`` (image src, adverts dropped, or non-empty ``p`` text), plus
    source, author, title and category. Pages without the body container are
    not articles (P33)."""
    def piece(imgs: Column, k: Column) -> Column:
        def of(img: Column) -> Column:
            ad = F.lit(False)
            for w in AD_IMAGE_WORDS:
                ad = ad | img.contains(w)
            clean = T.clean(k["text"])
            return (F.when(img.isNotNull(), F.when(~ad & (F.length(img) > 0), img))
                    .when(k["tag"] == "p", F.when(F.length(clean) > 0, clean)))
        return let(_src(F.get(under(imgs, k), F.lit(0))), of)

    body = one("nodes", id="artibody")
    kids = let(body["ord"], lambda o: F.filter("nodes", lambda n: (n["parent"] == o) & n["tag"].rlike("^[pd]")))
    imgs = every(within("nodes", {"id": "artibody"}), tag="img")
    blocks = let(imgs, lambda im: F.filter(F.transform(kids, lambda k: piece(im, k)), lambda x: x.isNotNull()))
    ds = within("nodes", _div("date-source"))
    ed = _text(one("nodes", tag="p", classes=["article-editor"]))
    out = trees(nodes).select(
        "page_id", body.isNotNull().alias("_is"), blocks.alias("blocks"),
        let(ds, lambda d: F.coalesce(_text(one(d, tag="a", classes=["source"])), _text(one(d, tag="span", classes=["source"]))))
        .alias("source"),
        let(ed, lambda e: F.when(F.instr(e, "：") > 0, e.substr(F.instr(e, "：") + 1, F.length(e)))).alias("author"),
        T.clean(one("nodes", **_div("main-title"))["text"]).alias("page_title"),
        _text(one(within("nodes", _div("channel-path")), tag="a")).alias("category")).where("_is").drop("_is")
    if listing is not None:
        out = out.join(listing.select("page_id", F.col("title").alias("listing_title")), "page_id", "left")
        out = out.withColumn("title", F.coalesce("page_title", "listing_title")).drop("listing_title")
    else:
        out = out.withColumnRenamed("page_title", "title")
    return out


def _wallstreet_body(ns) -> Column:
    """(pb_time, blocks) of ``div.rich-text``; NULL without it."""
    time = _text(one(within(ns, _div("info")), tag="time", classes=["meta-item", "time"]))

    def blocks(d: Column) -> Column:
        return let(every(d, tag="img"), lambda imgs: F.transform(
            every(d, tag_re="^[ph]"), lambda p: F.coalesce(_src(F.get(under(imgs, p), F.lit(0))), _text(p))))

    return F.when(one(ns, **_div("rich-text")).isNotNull(), F.struct(
        time.alias("pb_time"), let(within(ns, _div("rich-text")), blocks).alias("blocks")))


def wallstreet_article(nodes: DataFrame) -> DataFrame:
    """Publication time and body of ``div.rich-text`` (every ``p*``/``h*``:
    image src when it holds one, else its stripped text; empty kept)."""
    return (trees(nodes).select("page_id", _wallstreet_body("nodes").alias("_a")).where("_a IS NOT NULL")
            .select("page_id", "_a.*"))


def _p_body(found: Column) -> Column:
    """Tencent paragraphs: each ``p`` -> its first image src, else its
    non-empty stripped text; NULL without paragraphs (blank ones give no piece,
    but a page that has only those still has paragraphs)."""
    def piece(imgs: Column, p: Column) -> Column:
        return F.coalesce(_src(F.get(under(imgs, p), F.lit(0))), F.when(F.length(_text(p)) > 0, _text(p)))

    def body(d: Column) -> Column:
        return let(every(d, tag="img"), lambda imgs: let(every(d, tag="p"), lambda ps: F.when(
            F.size(ps) > 0, F.filter(F.transform(ps, lambda p: piece(imgs, p)), lambda x: x.isNotNull()))))

    return let(found, body)


def tencent_article(nodes: DataFrame) -> DataFrame:
    """Layout by first match (LEFT, gallery, qq_article,
    other) with per-layout metadata and body; ``other`` is quarantined by
    the caller (``layout = 'other'``)."""
    ns = "nodes"
    qq = _div("qq_article")
    has = lambda *c: one(ns, **_div(*c)).isNotNull()
    sp = lambda d, c: _text(one(d, tag="span", classes=[c]))
    j = trees(nodes).select(
        "page_id", F.when(has("LEFT"), "LEFT").when(has("gallery"), "gallery").when(has("qq_article"), "qq_article")
        .otherwise("other").alias("layout"),
        # layout 1
        _text(one(within(ns, _div("LEFT")), tag="h1")).alias("l1_title"),
        T.strip_ws(one(ns, attrs={"name": "_pbtime"})["attrs"]["content"]).alias("l1_time"),
        _text(one(within(ns, _div("LeftTool")), tag="span", attrs={"data-bosszone": "ly"})).alias("l1_src"),
        T.split_ws(_text(one(within(ns, _div("a-src-time")), tag="a"))).alias("st"),
        _p_body(within(ns, _div("content-article"))).alias("b1"),
        # layout 2
        _text(one(within(ns, qq, _div("hd")), tag="h1")).alias("l2_title"),
        let(within(ns, qq, _div("a_Info")), lambda d: F.struct(
            sp(d, "a_source").alias("src"), sp(d, "a_time").alias("time"), sp(d, "a_author").alias("author"),
            sp(d, "a_catelog").alias("cat"))).alias("l2"),
        _p_body(within(ns, qq, _div("bd"))).alias("b2"),
        let(one(within(ns, qq, _div("bd")), **_div("Cnt-Main-Article-QQ")),
            lambda c: F.split(T.strip_ws(F.coalesce(c["text_br"], c["text"])), "\n")).alias("b2_lines"))
    two = F.size("st") >= 2
    is1, is2 = F.col("layout") == "LEFT", F.col("layout") == "qq_article"
    meta2 = is2 | (F.col("layout") == "gallery")  # a gallery page has the header of layout 2
    empty = _none()
    return j.select(
        "page_id", "layout",
        F.when(is1, F.col("l1_title")).when(meta2, F.col("l2_title")).alias("title"),
        F.when(is1, F.when(two, F.concat_ws(" ", F.element_at("st", -2), F.element_at("st", -1)))
               .otherwise(F.col("l1_time"))).when(meta2, F.col("l2.time")).alias("pb_time"),
        F.when(is1, F.when(two, F.col("st")[0]).otherwise(F.col("l1_src"))).when(meta2, F.col("l2.src")).alias("source"),
        F.when(meta2, F.col("l2.author")).alias("author"),
        F.when(meta2, F.col("l2.cat")).alias("category"),
        F.when(is1, F.coalesce("b1", empty))
        .when(is2, F.coalesce("b2", "b2_lines", empty)).otherwise(empty).alias("blocks"))


def rich_body(ns, container: Column, keep_img_without_alt: bool) -> Column:
    """Paragraphs and ``(alt, src)`` images of ``container`` in document
    order; text before the first paragraph is prepended, text after the last
    appended, and that tail is cut at the cut phrase when present.
    Images without ``alt`` are skipped, or kept with an empty alt. NULL when there
    are none of either. The container's whole text is cleaned once per page."""
    flat = lambda c: T.remove_newline(T.clean(c))
    cut = lambda c: T.strip_ws(F.when(F.instr(c, CUT_PHRASE) > 0, F.substring_index(c, CUT_PHRASE, 1)).otherwise(c))
    block = lambda kind, text, src: F.struct(F.lit(kind).alias("kind"), text.alias("text"), src.alias("src"))
    null, none = F.lit(None).cast("string"), F.array().cast(f"array<{BLOCK}>")

    def image(x: Column) -> Column:
        return F.array(block("image", F.when(x["attrs"]["alt"].isNotNull(), flat(x["attrs"]["alt"])).otherwise(F.lit("")),
                             x["attrs"]["src"]))

    def edge(x: Column, whole: Column, first: Column) -> Column:
        def of(both: Column) -> Column:
            p, j = both["p"], both["j"]
            before = block("text", whole.substr(F.lit(1), j - 1), null)
            # the cut belongs to the piece the last paragraph ends with, whatever images follow it
            after = block("text", cut(whole.substr(j + F.length(p), F.lit(1 << 30))), null)
            text = block("text", p, null)
            return (F.when(first, F.concat(F.when(j > 0, F.array(before)).otherwise(none), F.array(text)))
                    .otherwise(F.when(j > 0, F.array(text, after)).otherwise(F.array(block("text", cut(p), null)))))
        return let(flat(x["text"]), lambda p: let(F.struct(p.alias("p"), F.instr(whole, p).alias("j")), of))

    def pieces(items: Column, whole: Column) -> Column:
        def of(ends: Column) -> Column:
            first, last_ = ends["first"], ends["last"]
            return F.flatten(F.transform(items, lambda x: F.when(x["tag"] == "img", image(x))
                                         .when((x["ord"] == first) | (x["ord"] == last_), edge(x, whole, x["ord"] == first))
                                         .otherwise(F.array(block("text", flat(x["text"]), null)))))
        return let(F.struct(one(items, tag="p")["ord"].alias("first"), last(items, tag="p")["ord"].alias("last")), of)

    def body(box: Column) -> Column:
        kept = lambda n: (n["tag"] == "p") | ((n["tag"] == "img")
                                              & (F.lit(True) if keep_img_without_alt else n["attrs"]["alt"].isNotNull()))
        return let(F.filter(under(ns, box), kept), lambda items: F.when(
            F.size(items) > 0, let(flat(box["text"]), lambda whole: pieces(items, whole))).cast(f"array<{BLOCK}>"))

    return let(container, body)


def hexun_article(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """X9/X10/X17/P20 for the Hexun layout; pages without the breadcrumb are skipped."""
    from .headers import parse_header
    ns = "nodes"
    got = trees(nodes).select(
        "page_id", breadcrumb(ns, within(ns, _div("logonav", "clearfix"), _div("links"))).alias("cur_source"),
        T.strip_ws(T.remove_multi_space(one(ns, **_div("layout", "mg", "articleName"))["text"])).alias("head"),
        rich_body(ns, one(ns, **_div("art_context")), keep_img_without_alt=False).alias("blocks"))
    h = parse_header(got.where("cur_source IS NOT NULL"), "head")
    return (h.select("page_id", "cur_source", "head", "title", "source", "author", "pb_time", "blocks")
            .join(pages.select("page_id", "url"), "page_id"))


def em_article(nodes: DataFrame) -> DataFrame:
    """EastMoney article header and body."""
    ns, left = "nodes", _div("left-content")

    def header(d: Column) -> Column:
        def of(ends: Column) -> Column:
            alt = one(under(ns, ends["src"]), tag="img")["attrs"]["alt"]
            return F.struct(one(d, **_div("time"))["text"].alias("pb_time"), F.coalesce(alt, ends["src"]["text"]).alias("source"),
                            one(d, **_div("author"))["text"].alias("author"),
                            one(under(ns, ends["ed"]), tag="a")["text"].alias("editor"))
        editors = F.filter(d, lambda n: (n["tag"] == "span") & n["text"].contains(EDITOR_WORD))
        return let(F.struct(one(d, **_div("source")).alias("src"), F.try_element_at(editors, F.lit(-1)).alias("ed")), of)

    def count(d: Column, *classes: str) -> Column:
        return F.coalesce(one(d, tag="span", classes=classes)["text"].try_cast("int"), F.lit(-1))

    j = trees(nodes).select(
        "page_id", breadcrumb(ns, within(ns, {"tag": "div", "id": "Column_Navigation"})).alias("cur_source"),
        let(within(ns, left, _div("Info")), header).alias("h"),
        let(within(ns, left, _div("AboutCtrl")), lambda d: F.struct(
            count(d, "cNumShow", "num").alias("commenters"), count(d, "num", "ml5").alias("participants"))).alias("comment_list"),
        rich_body(ns, one(ns, tag="div", id="ContentBody", classes=["Body"]), keep_img_without_alt=True).alias("blocks"))
    return j.where("cur_source IS NOT NULL").select(
        "page_id", "cur_source", "h.pb_time", "h.source", F.coalesce("h.author", F.lit("")).alias("author"),
        F.coalesce("h.editor", F.lit("")).alias("editor"), "comment_list", "blocks")


def announcement(nodes: DataFrame) -> DataFrame:
    """Announcement time, PDF link and content."""
    def styled(d: Column, tag: str, style: str) -> Column:
        return one(d, tag=tag, attrs={"style": style})

    got = trees(nodes).select("page_id", let(within("nodes", _div("content")), lambda d: F.struct(
        F.size(d).alias("size"), styled(d, "div", ANNO_TIME_STYLE)["text"].alias("anno_time"),
        href(styled(d, "a", ANNO_PDF_STYLE)).alias("source_pdf_url"),
        styled(d, "div", ANNO_BODY_STYLE)["text"].alias("content"))).alias("a"))
    return got.where("a.size > 0").select("page_id", "a.anno_time", "a.source_pdf_url", "a.content")


def research_report(nodes: DataFrame, report_type: DataFrame) -> DataFrame:
    """author = last span of ``div.report-infos``; chart images by type
    (stock report: the centred image with alt; industry report: two charts);
    body as X9 with alt-less images kept. ``report_type``: (page_id, type)."""
    ns, body = "nodes", {"tag": "div", "id": "ContentBody", "classes": ["report-body", "Body"]}
    chart = lambda i: one(within(ns, body, _div("report-img-cont", f"img-chart{i}")), tag="img")["attrs"]["src"]
    parts = trees(nodes).select(
        "page_id", last(within(ns, _div("report-infos")), tag="span")["text"].alias("author"),
        one(within(ns, body, {"tag": "p", "attrs": {"style": REPORT_IMG_STYLE}}), tag="img", attrs={"border": "0"})["attrs"].alias("k"),
        chart(1).alias("chart1"), chart(2).alias("chart2"),
        rich_body(ns, one(within(ns, body), **_div("newsContent")), keep_img_without_alt=True).alias("blocks"))
    j = report_type.join(parts, "page_id", "left")
    stock = F.col("type") == STOCK_REPORT_WORD
    ind = F.col("type") == INDUSTRY_REPORT_WORD
    return (j.where(stock | ind)
            .select("page_id", F.col("type").alias("research_report_type"), "author",
                    F.when(stock, F.col("k")["src"]).otherwise(F.lit("")).alias("img_k_url"),
                    F.when(stock, F.col("k")["alt"]).otherwise(F.lit("")).alias("img_k_alt"),
                    F.when(ind, F.array("chart1", "chart2")).otherwise(F.array(F.lit(""), F.lit(""))).alias("two_img_url"),
                    "blocks"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_with_newlines(nodes: DataFrame, container: DataFrame) -> DataFrame:
    """Container text with each ``<br>`` as a newline, lines stripped."""
    c = container.select("page_id", F.split(F.coalesce("text_br", "text"), "\n").alias("l"))
    return c.select("page_id", F.array_join(F.transform("l", lambda s: T.strip_ws(s)), "\n").alias("text"))


def wallstreet_items(nodes: DataFrame, pages: DataFrame, site_word: str = "wallstreet") -> DataFrame:
    """Listing cards joined to their article pages on the requested URL.

    Only pages whose URL contains the site word count (P3), free or not. Free
    cards (``/a…``) take time and body from the article page; premium cards
    (``/premium…``) become ``site + path`` without body; other cards keep their
    URL, without body."""
    # cards and article of a page in one pass over it, written: both sides of the join read them
    both = _written(trees(nodes).select("page_id", _wallstreet_cards("nodes").alias("cards"), _wallstreet_body("nodes").alias("article")),
                    "wallstreet")
    listing = _wallstreet_rows(_rows(both, F.col("cards")), pages)
    art = (both.where("article IS NOT NULL").select("page_id", "article.*").join(pages.select("page_id", "url"), "page_id")
           .where(F.col("url").contains(site_word))
           .select(F.col("url").alias("art_url"), "pb_time", "blocks"))
    j = listing.join(art, listing.url == art.art_url, "left")
    origin = U.origin(F.col("url"))
    item_url = (F.when(F.col("free"), F.col("art_url"))
                .when(F.col("sub_url").startswith("/premium"), F.concat(origin, F.col("sub_url")))
                .otherwise(F.col("sub_url")))
    ours = F.when(F.col("free"), F.col("art_url").isNotNull()).otherwise(listing.url.contains(site_word))
    return (j.where(ours)
            .select("page_id", "item", "title", "summary", "source", item_url.alias("url"),
                    F.when(F.col("free"), F.col("pb_time")).alias("pb_time"),
                    F.when(F.col("free"), F.col("blocks")).alias("blocks"),
                    F.lit(0).cast("bigint").alias("reads"),
                    F.array().cast("array<string>").alias("likedby")))


def gallery_slides(nodes: DataFrame) -> DataFrame:
    """X15, one slide page: its picture (``div.galleryPic`` first img src)
    followed by the caption paragraphs of ``#contTxt``."""
    pic = within("nodes", _div("galleryPic"))
    got = trees(nodes).select(
        "page_id", let(pic, lambda d: F.struct(F.size(d).alias("n"), _src(one(d, tag="img")).alias("img"))).alias("pic"),
        F.transform(every(within("nodes", {"id": "contTxt"}), tag="p"), _text).alias("captions"))
    return got.where("pic.n > 0 OR size(captions) > 0").select(
        "page_id", F.concat(F.when(F.col("pic.img").isNotNull(), F.array("pic.img")).otherwise(_none()), "captions").alias("pieces"))


def gallery_body(slides: DataFrame, slide_pages: DataFrame) -> DataFrame:
    """A gallery's body = its slides' pieces in slide order.
    ``slide_pages``: (gallery_id, slide int, page_id) — the ``#p=<n>`` pages."""
    s = slide_pages.join(slides, "page_id")
    return (A.posexplode_rows(s, F.col("pieces"), "pos", "piece", "gallery_id", "slide")
            .groupBy("gallery_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("slide", "pos", "piece"))),
                             lambda x: x["piece"]).alias("blocks")))


def tencent_items(articles: DataFrame, listing: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles joined to the listing row that requested them: a missing
    title or category comes from the listing. ``articles`` is the result of
    ``tencent_article``, ``listing`` (url, title, category)."""
    asked = listing.select(F.col("url").alias("l_url"), F.col("title").alias("l_title"), F.col("category").alias("l_cat"))
    j = articles.join(pages.select("page_id", "url"), "page_id")
    j = j.join(asked, j["url"] == asked["l_url"])
    return j.select("url", "layout", F.coalesce("title", "l_title").alias("title"), "pb_time", "source", "author",
                    F.coalesce("category", "l_cat").alias("category"), "blocks")


def report_items(listing: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Research reports joined to the report-table row that led to them:
    institution, rating, time, title and type come from the table, author, images
    and body from the report page. ``listing`` is the result of ``report_tables``."""
    asked = listing.join(pages.select(F.col("page_id").alias("report_id"), "url"), listing["href"] == F.col("url"))
    # read twice: the listing is not tokenised for both
    asked = _written(asked.select("report_id", "url", "ji_gou", "ping_ji", "time", "title", "type"), "report-items")
    body = research_report(nodes, asked.select(F.col("report_id").alias("page_id"), "type"))
    return asked.join(body.withColumnRenamed("page_id", "report_id"), "report_id").select(
        "url", "title", "ji_gou", "ping_ji", "time", "type", "author", "img_k_url", "two_img_url", "blocks")
