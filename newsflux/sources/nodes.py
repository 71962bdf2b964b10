"""Page tokeniser: pages -> their HTML elements (S5, S6, X1-X21 input).

The only per-row Python in the page jobs. It runs as an Arrow-batched
``mapInArrow`` over the ``pages`` table (each task tokenises the pages of its
own partition), using the standard library's tolerant ``html.parser`` plus
the few tree-builder repairs the landed pages need: a new block element
closes an open ``<p>``, ``<li>``/``<tr>``/``<td>`` close their open
siblings, void elements never open, an end tag closes up to its match and a
stray one is ignored. Script and style text is not page text.

``trees`` gives one row per page, (page_id, nodes), with the page's elements
as an array in document order; ``nodes`` the same as one row per element:
    page_id, ord, tag, id, classes, attrs, parent, anc, depth, text, text_br, own
where ``anc`` lists ancestor ords (root first), ``text`` is the element's
full visible text (``get_text()``), ``text_br`` the same with every ``<br>``
as a newline (NULL when the element holds no ``<br>``: use
``coalesce(text_br, text)``), and ``own`` its direct text only.
Site rules are column expressions over a page's array
(``operators/extract.py``): a page is tokenised, ruled and reported in one
pass, and only its html is shuffled before.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches

NODE_FIELDS = ("ord int, tag string, id string, classes array<string>, attrs map<string,string>, parent int, "
               "anc array<int>, depth int, text string, text_br string, own string")
TREE_SCHEMA = "page_id long, nodes array<struct<" + NODE_FIELDS.replace(" ", ":").replace(",:", ",") + ">>"
#: Text bytes of the pages handed over in one Arrow batch (a longer page goes alone).
OUT_BYTES = 4 << 20

# fixed values: HTML tree-builder rules used by the tokeniser
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form",
            "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p",
            "pre", "section", "table", "ul"}
SIBLING_CLOSE = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                 "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
RAW_TEXT = {"script", "style"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.chunks: list[str] = []
        self.brs: dict[int, int] = {}  # chunk index -> number of <br> just before it
        self.nodes: list[dict] = []
        self.stack: list[int] = []
        self.raw = 0

    def _close_to(self, i: int) -> None:
        while self.stack and self.stack[-1] != i:
            self._pop()
        if self.stack:
            self._pop()

    def _pop(self) -> None:
        n = self.nodes[self.stack.pop()]
        n["end"] = len(self.chunks)
        if n["tag"] in RAW_TEXT:
            self.raw -= 1

    def _open_tag(self, name: str):
        for i in reversed(self.stack):
            if self.nodes[i]["tag"] == name:
                return i
        return None

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            p = self._open_tag("p")
            if p is not None:
                self._close_to(p)
        if tag in SIBLING_CLOSE and self.stack and self.nodes[self.stack[-1]]["tag"] in SIBLING_CLOSE[tag]:
            self._pop()
        a = {k: (v if v is not None else "") for k, v in attrs}
        parent = self.stack[-1] if self.stack else -1
        node = {"ord": len(self.nodes), "tag": tag, "id": a.get("id"),
                "classes": a.get("class", "").split() if "class" in a else [],
                "attrs": a, "parent": parent, "anc": list(self.stack), "depth": len(self.stack),
                "start": len(self.chunks), "end": None, "own": []}
        self.nodes.append(node)
        if tag == "br":
            self.chunks.append("")
            self.brs[len(self.chunks) - 1] = 1
        if tag in VOID:
            node["end"] = len(self.chunks)
            return
        self.stack.append(node["ord"])
        if tag in RAW_TEXT:
            self.raw += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.nodes[self.stack[-1]]["tag"] == tag:
            self._pop()

    def handle_endtag(self, tag):
        i = self._open_tag(tag)
        if i is not None:
            self._close_to(i)

    def handle_data(self, data):
        if self.raw:
            return
        self.chunks.append(data)
        if self.stack:
            self.nodes[self.stack[-1]]["own"].append(data)

    def rows(self, page_id: int):
        self.close()
        while self.stack:
            self._pop()
        for n in self.nodes:
            span = range(n["start"], n["end"])
            text = "".join(self.chunks[i] for i in span)
            # the <br>-as-newline text only where a <br> falls inside the element
            has_br = self.brs and any(i in self.brs for i in span)
            text_br = "".join("\n" if i in self.brs else self.chunks[i] for i in span) if has_br else None
            yield (page_id, n["ord"], n["tag"], n["id"], n["classes"], n["attrs"], n["parent"],
                   n["anc"], n["depth"], text, text_br, "".join(n["own"]))


def parse_html(page_id: int, html: str) -> list[tuple]:
    t = _Tree()
    t.feed(html or "")
    return list(t.rows(page_id))


_NODE = pa.struct([("ord", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
                   ("attrs", pa.map_(pa.string(), pa.string())), ("parent", pa.int32()), ("anc", pa.list_(pa.int32())),
                   ("depth", pa.int32()), ("text", pa.string()), ("text_br", pa.string()), ("own", pa.string())])


def _batch(pages: list[tuple]) -> pa.RecordBatch:
    """Pages (page_id, parse_html rows) as one batch of (page_id, nodes)."""
    flat = [row for _, rows in pages for row in rows]
    cols = []
    for i, field in enumerate(_NODE, start=1):
        values = [row[i] for row in flat]
        cols.append(pa.array([list(v.items()) for v in values] if field.name == "attrs" else values, field.type))
    ends = [0]
    for _, rows in pages:
        ends.append(ends[-1] + len(rows))
    nodes_ = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(_NODE)))
    return pa.RecordBatch.from_arrays([pa.array([pid for pid, _ in pages], pa.int64()), nodes_], names=["page_id", "nodes"])


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages come sorted by id; those that share an id are one tree, its elements by ord."""
    done: list[tuple] = []
    size = 0
    held = None
    for batch in batches:
        for pid, html in zip(batch.column(0), batch.column(1), strict=True):
            pid, rows = pid.as_py(), parse_html(pid.as_py(), html.as_py())
            if held is not None and pid is not None and pid == held[0]:
                held = (pid, sorted(held[1] + rows, key=lambda r: r[1]))
                continue
            if held is not None and held[1]:
                done.append(held)
                size += sum(len(r[9]) + 100 for r in held[1])
                if size >= OUT_BYTES:
                    yield _batch(done)
                    done, size = [], 0
            held = (pid, rows)
    if held is not None and held[1]:
        done.append(held)
    if done:
        yield _batch(done)


def trees(pages: DataFrame) -> DataFrame:
    """pages(page_id, html, ...) -> (page_id, nodes), lazy: one row per page id. A
    page without an id keeps a row of its own; one without elements has none."""
    bound_batches(pages.sparkSession)
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
            .repartition(F.coalesce("page_id", F.xxhash64("html"))).sortWithinPartitions("page_id")
            .mapInArrow(_tokenise, TREE_SCHEMA))


def nodes(pages: DataFrame) -> DataFrame:
    """pages(page_id, html, ...) -> one row per element (lazy)."""
    return trees(pages).select("page_id", F.inline("nodes"))
