"""Registered jobs of the site rules: site-shaped pages -> tokeniser -> rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import extract as X
from ..sources import nodes as N
from ..sources import site_pages as P
from ..sources.tables import Tables

QUERIES = {}
MARK = "¶"  # joins the blocks of a body in the reports


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _joined(c="blocks"):
    return F.array_join(c, MARK)


def _pieces(c="blocks"):
    """Rich blocks as text, images as ``alt|src``."""
    return F.array_join(F.transform(c, lambda b: F.when(b["kind"] == "image", F.concat_ws("|", b["text"], b["src"]))
                                    .otherwise(b["text"])), MARK)


def _numbered(rows: DataFrame, by: str, *keep) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy(by)  # one page's items
    return rows.select("page_id", F.row_number().over(w).cast("bigint").alias("pos"), *keep)


@query
def site_wallstreet(spark, sf_dir):
    """Listing cards joined to their article pages."""
    pages = P.wallstreet(Tables(spark, sf_dir))
    got = X.wallstreet_items(N.trees(pages), pages)
    return got.select("title", "summary", "source", "url", "pb_time", _joined().alias("blocks"))


@query
def site_sina(spark, sf_dir):
    """Direct children of the body, adverts and blanks dropped."""
    t = Tables(spark, sf_dir)
    listing = t.documents("doc_id").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("Listing "), "doc_id").alias("title"))
    got = X.sina_article(N.trees(P.sina(t)), listing)
    return got.select("page_id", "source", "author", "title", "category", _joined().alias("blocks"))


@query
def site_tencent_list(spark, sf_dir):
    """Rolling listing."""
    got = X.tencent_listing(N.trees(P.tencent_lists(Tables(spark, sf_dir))))
    return _numbered(got, "item", "category", "url", "title")


@query
def site_tencent(spark, sf_dir):
    """Four layouts; a gallery's body comes from its slide pages."""
    t = Tables(spark, sf_dir)
    got = X.tencent_article(N.trees(P.tencent(t)))
    slides = P.gallery_slides(t)
    body = X.gallery_body(X.gallery_slides(N.trees(slides)), slides.select("gallery_id", "slide", "page_id"))
    return (got.join(body.select(F.col("gallery_id").alias("page_id"), F.col("blocks").alias("slides")), "page_id", "left")
            .select("page_id", "layout", "title", "pb_time", "source", "author", "category",
                    _joined(F.coalesce("slides", "blocks")).alias("blocks")))


@query
def site_hexun(spark, sf_dir):
    """Body with images in order, edges and the cut phrase."""
    pages = P.hexun(Tables(spark, sf_dir))
    got = X.hexun_article(N.trees(pages), pages)
    return got.select("page_id", F.array_join("cur_source", MARK).alias("cur_source"), "title", "pb_time", "source", "author",
                      _pieces().alias("blocks"))


@query
def site_eastmoney(spark, sf_dir):
    """Article header, counts and body."""
    got = X.em_article(N.trees(P.eastmoney(Tables(spark, sf_dir))))
    return got.select("page_id", F.array_join("cur_source", MARK).alias("cur_source"), "pb_time", "source", "author", "editor",
                      "comment_list.commenters", "comment_list.participants", _pieces().alias("blocks"))


@query
def site_announcements(spark, sf_dir):
    """Time, PDF link and content."""
    return X.announcement(N.trees(P.announcements(Tables(spark, sf_dir))))


@query
def site_research(spark, sf_dir):
    """Author, chart images by report type, body with alt-less images."""
    pages = P.research_reports(Tables(spark, sf_dir))
    got = X.research_report(N.trees(pages), pages.select("page_id", "type"))
    return got.select("page_id", "research_report_type", "author", "img_k_url", "img_k_alt",
                      F.array_join("two_img_url", MARK).alias("charts"), _pieces().alias("blocks"))


@query
def site_br_text(spark, sf_dir):
    """Container text with br as newline."""
    nodes = N.trees(P.br_texts(Tables(spark, sf_dir)))
    return X.text_with_newlines(nodes, X.find(nodes, tag="div", classes=["brs"]))


@query
def site_stock_list(spark, sf_dir):
    """Stock-list links."""
    got = X.stock_list(N.trees(P.stock_lists(Tables(spark, sf_dir))))
    return _numbered(got, "ord", "stock_market", "stock_id", "stock_name")


@query
def site_funds(spark, sf_dir):
    """Fund news links."""
    pages = P.fund_pages(Tables(spark, sf_dir))
    return _numbered(X.fund_links(N.trees(pages), pages), "ord", "id", "title", "type", "href")


@query
def site_bonds(spark, sf_dir):
    """Bond news and announcement links."""
    pages = P.bond_pages(Tables(spark, sf_dir))
    return _numbered(X.bond_links(N.trees(pages), pages), "ord", "id", "title", "type", "href")


@query
def site_stocks(spark, sf_dir):
    """News and notice links of the stock page's boxes."""
    pages = P.stock_pages(Tables(spark, sf_dir))
    return _numbered(X.stock_page_links(N.trees(pages), pages), "ord", "id", "title", "type", "href")


@query
def site_reports(spark, sf_dir):
    """Rows of the two report tables, header and short rows dropped."""
    pages = P.stock_pages(Tables(spark, sf_dir))
    got = X.report_tables(N.trees(pages))
    return _numbered(got, "row", "ji_gou", "ping_ji", "time", "title", "href", "type")


@query
def site_tencent_items(spark, sf_dir):
    """Articles with the title and category of their listing row where
    the page has none (left-column pages bring no category, other layouts nothing)."""
    t = Tables(spark, sf_dir)
    pages = P.tencent(t)
    listing = t.documents("doc_id", "lang").select(
        F.concat(F.lit("http://new.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("Listed "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("cat "), "lang").alias("category"))
    got = X.tencent_items(X.tencent_article(N.trees(pages)), listing, pages)
    return got.select("url", "layout", "title", "category")


@query
def site_report_items(spark, sf_dir):
    """Report-table rows joined to the report pages they lead to."""
    t = Tables(spark, sf_dir)
    listing, reports = P.stock_pages(t), P.reports_of_parts(t)
    rows = X.report_tables(N.trees(listing))
    got = X.report_items(rows, N.trees(reports), reports)
    return got.select("url", "title", "ji_gou", "ping_ji", "time", "type", "author", "img_k_url", _pieces().alias("blocks"))
