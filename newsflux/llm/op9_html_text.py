"""HTML extraction with site template removal.

Every page is cut into blocks (runs of inline text between block borders) and
every block element's subtree gets a hash of its tag, attributes, text and child
subtrees. Spark counts, per host, on how many different pages a subtree stands;
subtrees that recur on many pages of their host are the site's template, and
blocks inside them are deleted. Many is a share of a small host's pages and a fixed
number on a large one, where section boxes, rotating adverts and notices are on few of
all pages; only short paragraphs, headings, list items, table cells and elements
without attributes, which articles of their own may have in common ("Yes"), need the
share on any host. What is boilerplate by its markup on any site
(navigation, headers, footers, asides, forms, scripts, hidden parts, and elements
whose class, id or role says advert, notice, comments and the like) is left out
too, and where a page marks its article (or main part), only that is taken.

Names mislead: headings and sections get ids made of their titles, wrappers say
which parts they have. So ids of headings and words after has, with or no do not
count, names of prose and sections (and ids of inline elements) only where all
their words are of boilerplate or layout, and where no prose is left on a page, the
names around its least nested and then longest prose are ignored. Prose is a
paragraph, quote or preformatted text, or any run of ``PROSE_WORDS`` words. The
page's main prose is its longest outside what is hidden, what is named without doubt
and reader comments: no form, no name that also speaks of content ("promo-content",
"post share-post") and no name round a marked article removes it; article marks
count only if it stands in one or they hold most of the page's prose. A header stays
where it is an article's headline: it holds a heading, and stands in a marked
article or is named after one.

Copies of one article must not turn its own text into a template: pages count
as different by their prose, and prose elements (paragraphs, headings, quotes,
preformatted text) of a marked article are never template.

Text inside a block has its character references decoded and its white space
turned into single blanks; blocks are joined by one newline in page order.

Defined cases: null or empty html gives an empty text; broken markup is read as
browsers do (open paragraphs and list items end where the next one begins,
unclosed elements end with their parent, an open head where the body's content
begins, an open menu where an article does; a quote that no value opens is part of a name); a page without a host has no site, so
only the page's own markup counts; repeated rows get equal results and count as
one page; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import common as C
from .bloom import Bloom

#: A subtree is template on this many different pages of a host, and on this share of them,
MIN_PAGES = 5
MIN_SHARE = 0.3
#: or on this many whatever the share is, unless it is short and may be anyone's text.
MANY_PAGES = 50
SHORT_WORDS = 8

# Elements by their role in HTML, and words of class, id and role that name boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
PARTS = set("caption dd dt legend li summary tbody td tfoot th thead tr".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
NO_CONTENT = set("""
aside button canvas dialog footer form head header iframe input menu nav noscript object script select style svg template
textarea title
""".split())
BOILERPLATE = set("""
ad adbox ads adsbygoogle adslot adunit advert adverts advertisement advertising alert alerts banner bottombar breadcrumb breadcrumbs colophon comment
comments consent contentinfo complementary cookie cookies copyright dfp dialog disclaimer disqus feedback footer gdpr
header login masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification overlay pager
pagination paywall popup promo promoted promotion reactions recommended related replies respond search share sharing
sidebar signup skip social sponsor sponsored sponsors subscribe subscription tabbar toolbar topbar widget widgets
""".split())
#: Words that stand beside those in names of parts of a page.
LAYOUT = set("""
area articles bar block blocks body bottom box btn button buttons caption container content count heading icon icons inner item
items label left line link links list main media message outer panel post posts right row section slot small stories text
thread title top unit wrap wrapper
""".split())
#: Words of names that speak of the article, beside which a word of boilerplate is in doubt.
CONTENT = {"article", "body", "content", "entry", "main", "post", "story", "text"}
COMMENTS = {"comment", "comments", "disqus", "feedback", "reactions", "replies", "respond"}
#: What may stand in a head; the start of anything else ends it.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title"}
#: Open elements that the start of an article or main part ends: they cannot hold one.
OUTSIDE = {"article": {"nav"}, "main": {"nav", "aside", "header", "footer"}}
#: Words after which a name tells what an element has or lacks.
QUALIFIER = {"has", "have", "with", "no", "non", "not", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RUNNING = {"p", "blockquote", "pre"}
PROSE_WORDS = 10
#: Open elements that the start of one of these ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"},
        "tfoot": {"tbody", "thead", "tr", "td", "th"}}
#: Elements beyond which such an ending does not reach.
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|noscript|svg)\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S | re.I)
_ATTR = re.compile(r"([^\s=/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _name_words(name: str) -> list[str]:
    words = [t.lower() for t in _TOKEN.findall(name)]
    return words[:next((i for i, w in enumerate(words) if w in QUALIFIER), len(words))]


class _Element:
    """An element with what its tag and attributes say of it: ``hidden`` by the tag, ``unseen`` by an
    attribute, ``by_name`` for any such attribute or name, ``doubted`` if a name also speaks of
    content, ``comments`` if it is of reader comments, ``headline`` if named as an article's header."""

    __slots__ = ("tag", "attrs", "hidden", "by_name", "unseen", "doubted", "comments", "headline", "heading", "article", "parts",
                 "subtree", "words", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.heading = tag in HEADINGS or parent is not None and parent.heading
        self.hidden = tag in NO_CONTENT
        self.by_name = self.unseen = self.doubted = self.comments = self.headline = False
        self.article = tag == "article" or tag == "main"
        self.parts, self.subtree, self.words = [], 0, 0
        if attrs and tag not in ("body", "html"):
            self._read(attrs)

    def _read(self, attrs: str) -> None:
        names = []
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                self.unseen = True
            elif name in ("class", "id", "role") and not (name == "id" and self.heading):
                names += [(name, n) for n in value.split()]
                self.article = self.article or name == "role" and value.lower() == "main"
        text = self.tag in PROSE or self.tag == "section" or ("class", "section") in names
        every = set()
        for name, n in names:
            words = _name_words(n)
            every.update(words)
            whole = text or name == "id" and self.tag not in BLOCK  # such names count if they say nothing else
            if any(w in BOILERPLATE for w in words) and (
                    not whole or all(w in BOILERPLATE or w in LAYOUT or w.isdigit() for w in words)):
                self.by_name = True
        self.doubted = self.by_name and not self.unseen and bool(every & CONTENT)
        self.comments = self.by_name and bool(every & COMMENTS)
        self.headline = bool(every & CONTENT) and bool(every & {"header", "masthead"})
        self.by_name = self.by_name or self.unseen


def parse(html: str) -> tuple[list[tuple[str, bool, list[int]]], list[int], int]:
    """(blocks, subtree hashes, prose hash): a block is its text, whether the
    page itself rules it out, and the hashes of the subtrees around it."""
    root = _Element("html", "", None)
    # a run's pieces stand in one block element, each in the inline elements open at it
    stack, elements, runs, run = [root], [root], [], []
    open_now: dict[str, int] = defaultdict(int)  # elements on the stack by tag

    def flush():
        if any(not piece.isspace() for piece, _ in run):
            runs.append(run.copy())
            stack[-1].parts.append(len(runs) - 1)
        run.clear()

    def close(k: int):
        """End the open elements from the k-th on."""
        if any(e.tag in BLOCK for e in stack[k:]):
            flush()
        for e in stack[k:]:
            open_now[e.tag] -= 1
        del stack[k:]

    at = 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            run.append((html[at:m.start()], stack[-1]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if open_now[tag] else 0
            if k and (tag in BLOCK or all(e.tag not in BLOCK for e in stack[k + 1:])):
                close(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            run.append((" ", stack[-1]))
            continue
        if tag in BLOCK:
            flush()
            if open_now["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
        for ended in {"head"} - {tag} if tag not in HEAD else (), OUTSIDE.get(tag, ()):
            if any(open_now[t] for t in ended):
                close(next(k for k in range(1, len(stack)) if stack[k].tag in ended))
        if tag in ENDS and any(open_now[t] for t in ENDS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS[tag]:
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in VOID:
            continue
        e = _Element(tag, m["attrs"].strip().rstrip("/").strip(), stack[-1])
        stack[-1].parts.append(e)
        stack.append(e)
        open_now[tag] += 1
        elements.append(e)
    if at < len(html):
        run.append((html[at:], stack[-1]))
    close(1)
    flush()

    seen: dict[int, tuple[bool, bool]] = {}

    def around(e: _Element) -> tuple[bool, bool]:
        """(ruled out, in a marked article) of what stands in e."""
        chain = []
        while e is not None and id(e) not in seen:
            chain.append(e)
            e = e.parent
        out, inside = seen[id(e)] if e is not None else (False, False)
        for e in reversed(chain):
            out, inside = out or e.hidden or e.by_name, inside or e.article
            seen[id(e)] = out, inside
        return out, inside

    def read(pieces: list[tuple[str, _Element]]) -> str:
        return " ".join(unescape("".join(p for p, _ in pieces)).split())

    def judge() -> list[tuple[str, bool, bool]]:
        """(text, ruled out, in a marked article) of every run."""
        got = []
        for pieces in runs:
            stays = [p for p in pieces if not around(p[1])[0]]
            text = read(stays)
            of = stays if text else pieces
            got.append((text or read(pieces), not text, any(around(e)[1] for _, e in of)))
        return got

    def is_prose(text: str, e: _Element) -> bool:
        while e is not None and e.tag not in BLOCK:
            e = e.parent
        return bool(text) and (e is not None and e.tag in RUNNING or text.count(" ") + 1 >= PROSE_WORDS)

    def believed(blocks: list[tuple[str, bool, bool]]) -> bool:
        """Do the page's article marks hold its longest or most of its prose (or is there none)?"""
        if not any(inside and not out for _, out, inside in blocks):
            return False
        sizes = [(len(text), inside) for (text, out, inside), pieces in zip(blocks, runs, strict=True)
                 if not out and is_prose(text, pieces[0][1])]
        inner = sum(n for n, inside in sizes if inside)
        return not sizes or max(sizes)[1] or 2 * inner >= sum(n for n, _ in sizes)

    def misnamed() -> list[_Element]:
        """The named elements around the least nested, then longest prose that only names rule out."""
        held, named = defaultdict(int), {}
        for pieces in runs:
            hidden, names = False, []
            lead = e = next(e for piece, e in pieces if not piece.isspace())
            while e is not None:
                hidden = hidden or e.hidden or e.by_name and e.unseen
                if e.by_name:
                    names.append(e)
                e = e.parent
            text = read(pieces)
            if names and not hidden and is_prose(text, lead):
                held[id(names[0])] += len(text)
                named[id(names[0])] = names
        return min(named.items(), key=lambda kv: (len(kv[1]), -held[kv[0]]), default=(0, []))[1]

    # one pass down and one up the tree, so that deep nesting costs no more than wide
    in_article, shut, marks, headed = {0: False}, {0: False}, set(), set()
    for e in reversed(elements):  # children before parents
        if e.tag in ("h1", "h2") or id(e) in headed:
            headed.add(id(e.parent))
    for e in elements:  # parents before children
        up = id(e.parent) if e.parent else 0
        in_article[id(e)] = in_article[up] or e.article and not e.by_name
    for e in reversed(elements):
        if id(e) in marks or e.article and not e.by_name and not in_article[id(e.parent)]:
            marks.add(id(e.parent))  # a marked article, in no other article, is inside
    for e in elements:
        up = id(e.parent) if e.parent else 0
        if (e.tag == "header" or e.headline) and not e.unseen and id(e) in headed and (e.headline or in_article[up]):
            e.hidden = e.by_name = False
        shut[id(e)] = (shut[up] or e.comments or e.hidden and e.tag != "form"
                       or e.by_name and not ((e.doubted or e.article) and not e.unseen or id(e) in marks))
    longest = (0, None)
    for pieces in runs:
        lead = next(e for piece, e in pieces if not piece.isspace())
        text = "" if shut[id(lead)] else read(pieces)
        if len(text) > longest[0] and is_prose(text, lead):
            longest = len(text), lead
    e = longest[1]
    while e is not None:  # nothing round the main prose removes it
        e.hidden, e.by_name = e.hidden and e.tag != "form", False
        e = e.parent
    blocks = judge()
    marked = believed(blocks)
    if any(e.by_name for e in elements) and not any(
            not out and (inside or not marked) and is_prose(text, pieces[0][1])
            for (text, out, inside), pieces in zip(blocks, runs)):
        for e in misnamed():
            e.by_name = False
        seen.clear()
        blocks = judge()
    marked = believed(blocks)

    for e in reversed(elements):  # children before parents
        parts = []
        for p in e.parts:
            if isinstance(p, _Element):
                if p.subtree:
                    parts.append(str(p.subtree))
                    e.words += p.words
            elif blocks[p][0] and not blocks[p][1]:
                parts.append(blocks[p][0])
                e.words += blocks[p][0].count(" ") + 1
        if parts:
            h = xxhash.xxh64_intdigest("\0".join([e.tag, e.attrs, *parts])) - (1 << 63)
            short = e.words < SHORT_WORDS and (e.tag in PROSE or e.tag in PARTS or not e.attrs)
            e.subtree = h & ~1 if short else h | 1  # the last bit: may MANY_PAGES decide

    trees: dict[int, list[int]] = {}  # the subtrees around what stands in an element
    counted = set()
    for e in elements:  # parents before children
        up = trees[id(e.parent)] if e.parent else []
        prose = marked and e.parent is not None and around(e.parent)[1] and e.tag in PROSE
        if e.tag in BLOCK and e.subtree and not prose and not e.article and e.tag not in ("html", "body"):
            up = [*up, e.subtree]
            counted.add(e.subtree)
        trees[id(e)] = up

    kept = [(text, out or (marked and not inside), trees[id(pieces[-1][1])])
            for (text, out, inside), pieces in zip(blocks, runs) if text]
    prose = "\0".join(t for t, out, _ in kept if not out) or html
    return kept, sorted(counted), xxhash.xxh64_intdigest(prose) - (1 << 63)


_PARSED = ("page_id long, url string, name long, host string, prose long, subtrees array<long>, "
           "blocks array<struct<text string, out boolean, trees array<long>>>")
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("out", pa.bool_()), ("trees", pa.list_(pa.int64()))]))


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [parse(h or "") for h in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:4], pa.array([g[2] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64())),
             pa.array([[{"text": t, "out": o, "trees": s} for t, o, s in g[0]] for g in got], _BLOCKS)],
            names=["page_id", "url", "name", "host", "prose", "subtrees", "blocks"])


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
              many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, subtree): subtrees that recur on many different pages of their host."""
    sited = parsed.where("host IS NOT NULL")
    pages = sited.select("host", "prose").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (sited.select("host", "prose", F.explode("subtrees").alias("subtree")).distinct()
              .groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    many = (F.col("n") >= many_pages) & (F.col("subtree").bitwiseAND(F.lit(1)) == 1)
    return counts.join(pages, "host").where(many | (F.col("n") >= min_share * F.col("pages"))).select("host", "subtree")


def extract(pages: DataFrame, html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
            many_pages: int = MANY_PAGES) -> DataFrame:
    """(page_id, url, text, n_blocks, n_template_blocks) of every row of ``pages``;
    template blocks are those that only the site's other pages give away."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long"), "url", F.xxhash64("page_id", "url", html).alias("name"),
                        F.when(host != "", host).alias("host"), html)
    parsed = C.stage(rows.mapInArrow(_parse_pages, _PARSED), "html-blocks")
    site = C.stage(templates(parsed, min_pages, min_share, many_pages), "html-templates")
    # only pages with a template around a block that the page itself keeps are shuffled; a
    # Bloom filter of their names lets all others stay where they are
    open_trees = F.flatten(F.transform(F.filter("blocks", lambda b: ~b["out"]), lambda b: b["trees"]))
    hits = C.stage(parsed.select("name", "host", F.explode(F.array_distinct(open_trees)).alias("subtree"))
                   .join(site, ["host", "subtree"]).groupBy("name").agg(F.collect_set("subtree").alias("hits")), "html-hits")
    wanted = pages.sparkSession.sparkContext.broadcast(Bloom.of(hits, "name"))

    def maybe(names: pa.Array) -> pa.Array:
        return pa.array(wanted.value.has(names.to_numpy(zero_copy_only=False)))

    tested = parsed.withColumn("touched", F.arrow_udf(maybe, BooleanType())("name"))
    joined = tested.where("touched").join(hits, "name", "left")
    stay = tested.where("NOT touched").withColumn("hits", F.lit(None).cast("array<long>"))
    own = stay.unionByName(joined).withColumn("hits", F.coalesce("hits", F.array().cast("array<long>")))
    kept = F.filter("blocks", lambda b: ~b["out"] & ~F.arrays_overlap(b["trees"], F.col("hits")))
    cut = F.filter("blocks", lambda b: ~b["out"] & F.arrays_overlap(b["trees"], F.col("hits")))
    return own.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"),
                      F.size("blocks").alias("n_blocks"), F.size(cut).alias("n_template_blocks"))
