"""HTML pages to blocks and links, Arrow batch by Arrow batch.

Blocks are the text of h1-h6, p, div, li, span and the rows of table elements in document order. Nested elements
of that list are blocks of their own, so the text of an inner one appears in the outer one's block as well. A table
counts rows and cells that are its direct children only.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import absolute_link, blocks_text, is_page_link

HEADERS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADERS | {"p", "div", "li", "span", "table"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style"}
#: Elements that end when another of them, or a block around them, begins.
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_FENCES = {"td", "th", "table", "ul", "ol", "div", "body", "html"}


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Tree(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def _close(self, tags: set[str], fences: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in fences:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._close({"p"}, _FENCES)
        if tag in _CLOSES:
            self._close(_CLOSES[tag], {"table", "ul", "ol"} | ({"div", "td", "th"} if tag in ("p", "li") else set()))
        node = _Node(tag, dict(attrs))
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].kids.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def parse(html: str | None) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _walk(node: _Node) -> Iterator[_Node]:
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, _Node) and at.tag not in _HIDDEN:
            yield at
            stack.extend(reversed(at.kids))


def text_of(node: _Node) -> str:
    """Text nodes, stripped, blank ones dropped, joined by one space."""
    found, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            if at.strip():
                found.append(at.strip())
        elif at.tag not in _HIDDEN:
            stack.extend(reversed(at.kids))
    return " ".join(found)


def _body(root: _Node) -> _Node:
    return next((n for n in _walk(root) if n.tag == "body"), root)


def html_blocks(html: str | None) -> list[dict]:
    """Blocks of a page: ``{type, text, rows}``; blank ones are left out."""
    return blocks_of(parse(html))


def blocks_of(root: _Node) -> list[dict]:
    out = []
    body = _body(root)
    for node in _walk(body):
        if node is body or node.tag not in BLOCKS:
            continue
        if node.tag == "table":
            rows = []
            for tr in node.kids:
                if isinstance(tr, _Node) and tr.tag == "tr":
                    cells = [text_of(c) for c in tr.kids if isinstance(c, _Node) and c.tag in ("th", "td")]
                    if cells:
                        rows.append(cells)
            if rows:
                out.append({"type": "table", "text": None, "rows": rows})
        else:
            text = text_of(node)
            if text:
                out.append({"type": "header" if node.tag in HEADERS else "text", "text": text, "rows": None})
    return out


def html_links(html: str | None) -> list[str]:
    """Addresses of all anchors, in order."""
    return links_of(parse(html))


def links_of(root: _Node) -> list[str]:
    return [n.attrs["href"] or "" for n in _walk(root) if n.tag == "a" and "href" in n.attrs]


_BLOCK_TYPE = pa.struct([("type", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "content_html", base: str = "https://wiki.quillmere.example", keep: list[str] | None = None) -> DataFrame:
    """``key, blocks, text, links`` of every page; null or empty HTML gives no blocks, the empty text and no links.

    Each row is parsed once and stays a row, so versions of a page are never mixed up; columns of ``keep`` ride along.
    Repeated rows give equal rows; other columns are ignored. Links: internal page addresses, made absolute,
    distinct and sorted.
    """
    carried = [c for c in keep or [] if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [parse(h) for h in batch.column(1).to_pylist()]
            blocks = pa.array([blocks_of(t) for t in trees], pa.list_(_BLOCK_TYPE))
            hrefs = pa.array([links_of(t) for t in trees], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], blocks, hrefs], names=[key, *(f"_{c}" for c in carried), "blocks", "hrefs"])

    rows = pages.select(F.col(key).cast("string").alias(key), F.col(html).alias("_html"), *(F.col(c).alias(f"_{c}") for c in carried))
    types = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    parsed = rows.mapInArrow(run, f"`{key}` string{types}, blocks array<struct<type:string,text:string,rows:array<array<string>>>>, hrefs array<string>")
    links = F.transform("hrefs", lambda h: absolute_link(h, base))
    links = F.array_sort(F.array_distinct(F.filter(links, lambda u: is_page_link(u, base))))
    return parsed.select(key, *(F.col(f"_{c}").alias(c) for c in carried), "blocks", blocks_text(F.col("blocks")).alias("text"), links.alias("links"))
