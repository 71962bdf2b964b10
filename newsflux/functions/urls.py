"""URL expressions: deny-list (P2), site filter (P3), access class (P4),
relative-link resolution (P5/F17), codes taken from links (P6, P7, P25)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Sections (first host label) of these sites, and pages, that are not followed.
DENY_SECTIONS = ["tv", "guba", "blog"]
DENY_SITES = ["hexun.com", "example.com", "example.net", "example.org"]
DENY_PAGES = ["index.html"]
# Third character of a code -> asset class (anything else is a stock).
ASSET_CLASS_BY_DIGIT = {"2": "bond", "5": "fund"}
# -----------------------------------------------------------------------------

QUOTE_BASE = "http://quote.example.com/"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def denied_host(sections=DENY_SECTIONS, sites=DENY_SITES) -> str:
    """Pattern of the hosts that P2 drops: a section of one of the sites."""
    return rf"^({'|'.join(sections)})\.(.*\.)?({'|'.join(s.replace('.', chr(92) + '.') for s in sites)})$"


def is_comparable(url, sections=DENY_SECTIONS, sites=DENY_SITES, pages=DENY_PAGES) -> Column:
    """True unless the host is a dropped section of a site (``news.cctv.com``
    is none, though it holds ``tv.``) or the URL names a dropped page."""
    u = _c(url)
    return ~reduce(lambda a, b: a | b, [u.contains(s) for s in pages], host(u).rlike(denied_host(sections, sites)))


def origin(url) -> Column:
    """scheme://host[:port] of an absolute URL."""
    return F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def remove_dots(path) -> Column:
    """A path that begins with '/', its '.' and '..' segments resolved: a fold over the segments
    with the path so far as a stack."""
    p = _c(path)
    step = lambda done, s: (F.when(s == "..", F.regexp_replace(done, "/[^/]*$", "")).when(s == ".", done)
                            .otherwise(F.concat(done, F.lit("/"), s)))
    # a dot segment at the end leaves its directory: an empty segment follows it
    ended = F.when(p.rlike(r"/\.{1,2}$"), F.concat(p, F.lit("/"))).otherwise(p)
    segments = F.split(F.substring(ended, 2, 1 << 30), "/", -1)
    return F.when(p.startswith("/") & p.rlike(r"/\.{1,2}(/|$)"), F.aggregate(segments, F.lit(""), step)).otherwise(p)


def resolve(href, page_url) -> Column:
    """P5: a reference resolved against its page's URL by the rules of RFC 3986 (a
    reference with the page's own scheme and no host counts as relative, as browsers
    and the crawler take it)."""
    r, u = F.trim(_c(href)), _c(page_url)
    part = lambda x, i: F.regexp_extract(x, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$", i)
    scheme, base = part(r, 1), part(u, 1)
    authority, path, query, fragment = (part(r, i) for i in (2, 3, 4, 5))
    other = (scheme != "") & ((F.lower(scheme) != F.lower(base)) | (authority != ""))
    site, base_path = F.concat(base, F.lit(":"), part(u, 2)), part(u, 3)
    joined = F.when((base_path == "") & (part(u, 2) != ""), F.concat(F.lit("/"), path)).otherwise(
        F.concat(F.regexp_extract(base_path, r"(?s)^(.*/)", 1), path))
    return (F.when(other, F.concat(scheme, F.lit(":"), authority, remove_dots(path), query, fragment))
            .when(authority != "", F.concat(base, F.lit(":"), authority, remove_dots(path), query, fragment))
            .when(path == "", F.concat(site, base_path, F.when(query != "", query).otherwise(part(u, 4)), fragment))
            .when(path.startswith("/"), F.concat(site, remove_dots(path), query, fragment))
            .otherwise(F.concat(site, remove_dots(joined), query, fragment)))


def host(url) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)


def host_prefix(url) -> Column:
    """First label of the host when the host has more than three labels
    (``blog.site.example.com`` -> ``blog``), else ''."""
    h = host(url)
    return F.when(F.size(F.split(h, r"\.")) > 3, F.substring_index(h, ".", 1)).otherwise(F.lit(""))


def access_class(url) -> Column:
    """P4 on our hosts: ``blog`` = external, ``m`` = premium, else free."""
    p = host_prefix(url)
    return F.when(p == "blog", "external").when(p == "m", "premium").otherwise("free")


def access_url(url, cls) -> Column:
    """P4 URL rule: premium -> site + path, otherwise as is."""
    u = _c(url)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(_c(cls) == "premium", F.concat(origin(u), path)).otherwise(u)


def code_url(code, base: str = QUOTE_BASE) -> Column:
    """Quote page of a code."""
    return F.concat(F.lit(base), _c(code), F.lit(".html"))


def asset_class(code) -> Column:
    """Asset class from the code's third character."""
    d = F.substring(_c(code), 3, 1)
    out = F.lit("stock")
    for digit, cls in reversed(list(ASSET_CLASS_BY_DIGIT.items())):
        out = F.when(d == digit, cls).otherwise(out)
    return out


def code_from_link(href) -> Column:
    """Text between the last '/' before the last '.html' and that '.html',
    whatever follows it (a query, a fragment)."""
    return F.regexp_extract(_c(href), r"^(?:.*/)?([^/]*)\.html", 1)


def name_from_label(label) -> Column:
    """Label text before its last '(' (whole label when there is none, B12)."""
    lab = _c(label)
    return F.when(lab.contains("("), F.regexp_extract(lab, r"^(.*)\(", 1)).otherwise(lab)
