"""Article pages -> article fields with column expressions.

The landed HTML is broken the way real pages are: unclosed ``<p>``, a
``</p>`` inside a script string, missing ``</html>``. Paragraph extraction
therefore splits the ``<article>`` body on opening ``<p>`` tags (a new ``<p>``
closes the previous one, like an HTML tree builder) and cuts each piece at its
first ``</p>``; inline tags are stripped before whitespace cleanup.
Everything here is a JVM expression evaluated once per page; the wide ``html``
column is projected away right after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..functions import urls as U

P_OPEN = r"(?i)<p(?:\s[^>]*)?>"
P_CLOSE = r"(?i)</p\s*>"
# the value of the first href of an <a>, quoted either way or not at all
A_HREF = r"""(?i)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def article_inner(html) -> Column:
    """Inner HTML of ``<article>``; NULL when the page has no article body."""
    h = F.col(html) if isinstance(html, str) else html
    inner = F.regexp_extract(h, r"(?is)<article(?:\s[^>]*)?>(.*?)(?:</article\s*>|$)", 1)
    return F.when(h.rlike(r"(?i)<article[\s>]"), inner)


def has_article(html) -> Column:
    """P1 presence: the page has an ``<article>`` body container."""
    h = F.col(html) if isinstance(html, str) else html
    return h.rlike(r"(?i)<article[\s>]")


def heading(html) -> Column:
    """P17 page part: ``<h1>`` text, else ``<title>`` text, else NULL."""
    h = F.col(html) if isinstance(html, str) else html
    h1 = T.html_text(F.regexp_extract(h, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>", 1))
    tt = T.html_text(F.regexp_extract(h, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))
    return F.when(h1 != "", h1).when(tt != "", tt)


def paragraphs(inner) -> Column:
    """Cleaned paragraph texts in document order, empty ones dropped.
    NULL in -> NULL out, so field presence (P1) survives."""
    i = F.col(inner) if isinstance(inner, str) else inner
    pieces = F.split(i, P_OPEN)
    texts = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
                        lambda x: T.html_text(F.get(F.split(x, P_CLOSE, 2), F.lit(0))))
    return F.filter(texts, lambda x: F.length(x) > 0)


def links(html) -> Column:
    """Every ``<a href>`` value of a page, in document order."""
    h = F.col(html) if isinstance(html, str) else html
    return F.transform(F.regexp_extract_all(h, F.lit(A_HREF), 1),
                       lambda v: T.unescape_html(F.regexp_replace(v, "^[\"']|[\"']$", "")))


def page_articles(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, title, blocks)."""
    return (pages
            .select("page_id", "url", heading("html").alias("title"),
                    paragraphs(article_inner("html")).alias("blocks")))


def page_links(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, pos, href, abs_url): one row per link."""
    return (A.posexplode_rows(pages, links("html"), "pos", "href", "page_id", "url")
            .select("page_id", F.col("pos").cast("bigint").alias("pos"), "href",
                    U.resolve("href", "url").alias("abs_url")))
