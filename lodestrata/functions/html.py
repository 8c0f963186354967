"""Readable text of HTML pages, with the standard library's parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that are never content, by tag, role, class, and part of a class.
DROPPED_TAGS = set("script style noscript template svg canvas iframe nav header footer aside dialog form".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary".split())
DROPPED_CLASSES = set("table-of-contents theme-doc-toc-mobile theme-doc-breadcrumbs pagination-nav theme-doc-footer".split())
DROPPED_CLASS_PARTS = ("tocCollapsible", "breadcrumbs")
#: Where the content may be, with what speaks for it.
CANDIDATES = {"article.markdown-body": 1200, "main article": 850, "article": 700, "main": 500, "[role=main]": 450, "body": 0}
NOISE = re.compile(r"Navigation Menu|Sign in|Sign up|Pull requests|Cookie|Privacy Policy", re.I)
BLOCKS = set("p div section article main blockquote pre table tr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNTITLED = "未命名网页"
_CLOSED_BY = {"li": {"li"}, "p": BLOCKS | {"ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self):
        """All elements below, in document order, without recursion."""
        waiting = [c for c in reversed(self.children) if isinstance(c, Node)]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, waiting = [], list(reversed(self.children))
        while waiting:
            child = waiting.pop()
            if isinstance(child, str):
                parts.append(child)
            else:
                waiting.extend(reversed(child.children))
        return re.sub(r"\s+", " ", " ".join(parts)).strip()

    def inside(self, tag: str) -> bool:
        node = self.parent
        while node:
            if node.tag == tag:
                return True
            node = node.parent
        return False


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if self.at.tag in _CLOSED_BY and tag in _CLOSED_BY[self.at.tag]:
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, [], self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent or self.root

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _dropped(node: Node) -> bool:
    classes = node.attrs.get("class", "")
    return (
        node.tag in DROPPED_TAGS
        or "hidden" in node.attrs
        or node.attrs.get("aria-hidden") == "true"
        or node.attrs.get("role") in DROPPED_ROLES
        or not DROPPED_CLASSES.isdisjoint(classes.split())
        or any(part in classes for part in DROPPED_CLASS_PARTS)
    )


def prune(root: Node) -> Node:
    waiting = [root]
    while waiting:
        node = waiting.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _dropped(c)]
        waiting.extend(c for c in node.children if isinstance(c, Node))
    return root


def structured_text(root: Node) -> str:
    """Text by lines: headings marked with #, list items with -, block elements on lines of their own."""
    lines: list[list[str]] = [[]]
    waiting: list = list(reversed(root.children))
    while waiting:
        item = waiting.pop()
        if item is None:
            lines.append([])
        elif isinstance(item, str):
            words = re.sub(r"\s+", " ", item).strip()
            if words:
                lines[-1].append(words)
        elif re.fullmatch(r"h[1-6]", item.tag) or item.tag == "li":
            words = item.text()
            if words:
                mark = "-" if item.tag == "li" else "#" * int(item.tag[1])
                lines += [[f"{mark} {words}"], []]
        elif item.tag == "br":
            lines.append([])
        else:
            inner = list(reversed(item.children))
            waiting += [None, *inner, None] if item.tag in BLOCKS else inner
    return "\n".join(" ".join(line) for line in lines if line)


def _matches(node: Node, candidate: str) -> bool:
    if candidate == "article.markdown-body":
        return node.tag == "article" and "markdown-body" in node.attrs.get("class", "").split()
    if candidate == "main article":
        return node.tag == "article" and node.inside("main")
    if candidate == "[role=main]":
        return node.attrs.get("role") == "main"
    return node.tag == candidate


def extract(html: str | None) -> tuple[str, str]:
    """(title, content) of a page; the content always starts with a heading."""
    whole = parse(html or "")
    meta = [n.attrs.get("content", "").strip() for n in whole.walk() if n.tag == "meta" and n.attrs.get("property") == "og:title"]
    root = prune(whole)
    nodes = list(root.walk())
    # A page need not write its body element.
    if not any(n.tag == "body" for n in nodes):
        nodes.append(Node("body", {}, [c for c in root.children if isinstance(c, str) or c.tag not in ("head", "title", "meta")]))
    best: tuple[float, str, str] | None = None
    for candidate, bonus in CANDIDATES.items():
        node = next((n for n in nodes if _matches(n, candidate)), None)
        content = structured_text(node) if node else ""
        if not content:
            continue
        inner = list(node.walk())
        links = sum(len(n.text()) for n in inner if n.tag == "a")
        score = bonus + min(len(content), 12_000) - 2 * links - 250 * len(NOISE.findall(content))
        if best is None or score > best[0]:
            best = (score, content, next((n.text() for n in inner if n.tag == "h1"), ""))
    page_title = next((m for m in meta if m), "") or next((n.text() for n in nodes if n.tag == "title"), "")
    heading = (best[2] if best else "") or next((n.text() for n in nodes if n.tag == "h1"), "")
    of_site = bool(re.search(r"\s[-|·]\s|GitHub", page_title, re.I))
    title = (page_title if page_title and not of_site else heading) or page_title or UNTITLED
    content = best[1] if best else ""
    return title, content if content.startswith("# ") else f"# {title}\n\n{content}".strip()


#: Where a page states its times and author, the first non-empty one counts.
META = {
    "published_at": [("meta", "property", "article:published_time", "content"), ("meta", "name", "date", "content"), ("time", None, None, "datetime")],
    "modified_at": [("meta", "property", "article:modified_time", "content"), ("meta", "name", "last-modified", "content")],
    "author": [("meta", "name", "author", "content"), ("meta", "property", "article:author", "content")],
}


def metadata(root: Node) -> dict[str, str | None]:
    nodes = list(root.walk())
    found: dict[str, str | None] = {}
    for name, places in META.items():
        values = (n.attrs.get(value, "").strip() for tag, key, wanted, value in places for n in nodes if n.tag == tag and (key is None or n.attrs.get(key) == wanted))
        found[name] = next((v for v in values if v), None)
    return found


def links(root: Node) -> list[str]:
    return [n.attrs["href"].strip() for n in root.walk() if n.tag == "a" and n.attrs.get("href", "").strip()]


def feeds(root: Node) -> list[str]:
    return [n.attrs["href"] for n in root.walk() if n.tag == "link" and "alternate" in n.attrs.get("rel", "").lower().split() and re.search(r"rss|atom|xml", n.attrs.get("type", ""), re.I) and n.attrs.get("href")]


PAGE_SCHEMA = "page_id bigint, title string, content string, published_at string, modified_at string, author string, links array<string>"


def extract_pages(pages: DataFrame) -> DataFrame:
    """Readable text, metadata and links of (page_id, html); null HTML gives an untitled page."""

    def rows(batches):
        for batch in batches:
            out = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                meta = metadata(root := parse(html or ""))
                out.append((page_id, *extract(html), meta["published_at"], meta["modified_at"], meta["author"], links(root)))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), *[pa.string()] * 5, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["page_id", "title", "content", "published_at", "modified_at", "author", "links"])

    return pages.select("page_id", "html").mapInArrow(rows, PAGE_SCHEMA)
