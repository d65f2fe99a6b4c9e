"""HTML pages: links, metadata, JSON-LD and body text, with the standard library's parser.

A small tree is built from ``html.parser`` events; the functions over it are
called from Arrow-batched maps, one row per page in, any number out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates
from tidewatch.functions.url import normalize_url

# Elements without content, without text, around the content, and with text of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript svg form iframe".split())
FRAME = frozenset("nav header footer aside form".split())
BLOCKS = frozenset("h1 h2 h3 p li blockquote".split())
# Parts of class, id, role or aria-label that mark page furniture.
FURNITURE = (
    "nav",
    "menu",
    "footer",
    "header",
    "subscribe",
    "newsletter",
    "cookie",
    "share",
    "social",
    "advert",
    "related",
    "promo",
    "breadcrumb",
)
# What marks the element that holds the body, (attribute, whole value or part of it).
BODY_MARKS = (
    ("itemprop", "articleBody", True),
    ("class", "article-body", False),
    ("class", "article__body", False),
    ("class", "story-body", False),
    ("class", "post-content", False),
    ("class", "entry-content", False),
    ("class", "field--name-body", False),
    ("class", "content-body", False),
    ("class", "rich-text", False),
    ("data-testid", "article", False),
)
LEAST_BLOCK = 30


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def text(self) -> str:
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag not in SILENT:
                stack.extend(reversed(node.children))
                if node.tag in BLOCKS or node.tag in ("br", "div", "td"):
                    parts.append(" ")
        return " ".join("".join(parts).split())

    def inside(self, tags: frozenset[str]) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in tags or node.attrs.get("role") == "navigation":
                return True
            node = node.parent
        return False

    @property
    def furniture(self) -> bool:
        marks = " ".join(self.attrs.get(a, "") for a in ("class", "id", "role", "aria-label")).lower()
        if self.tag in ("html", "body", "main", "article") or not any(f in marks for f in FURNITURE):
            return False
        return all(n.tag != "article" for n in self.walk())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.at.tag == tag:  # these end where the next begins
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def links_of(html: str | None, base: str, limit: int | None = None) -> list[dict]:
    """Distinct links outside navigation with a title of eight characters or more, the first of equals."""
    found: dict[str, dict] = {}
    for node in parse(html).walk():
        if node.tag != "a" or not node.attrs.get("href") or node.inside(FRAME):
            continue
        title = node.text() or node.attrs.get("title", "")
        try:
            url = urljoin(base, node.attrs["href"].strip()).split("#")[0]
        except ValueError:
            continue
        if not url.lower().startswith(("http://", "https://")):
            continue
        if len(title) >= 8 and url not in found:
            found[url] = {"url": url, "title": title, "near_date": near_date(node)}
            if limit and len(found) >= limit:
                break
    return list(found.values())


def near_date(anchor: Node) -> str | None:
    """The one date within two elements around a link that hold no other link."""
    node = anchor
    for _ in range(3):
        links = {n.attrs.get("href") for n in [node, *node.walk()] if n.tag == "a"}
        if len(links) > 1:
            return None
        stamped = {n.attrs["datetime"] for n in node.walk() if n.tag == "time" and n.attrs.get("datetime")}
        texts = stamped or {node.text()}
        days = {r.local.date().isoformat() for t in texts if (r := dates.read(t[:200]))}
        if days:
            return days.pop() if len(days) == 1 else None
        if node.parent is None or node.parent.parent is None:
            return None
        node = node.parent
    return None


def metas_of(html: str | None) -> list[dict]:
    """(name, content) of all meta elements by name, property or itemprop, in order."""
    found = []
    for node in parse(html).walk():
        if node.tag == "meta" and node.attrs.get("content"):
            for a in ("name", "property", "itemprop"):
                if node.attrs.get(a):
                    found.append({"name": node.attrs[a].lower(), "content": node.attrs["content"].strip()})
    return found


def json_ld_of(html: str | None) -> list[dict]:
    """Nodes of all JSON-LD blocks: lists and graphs taken apart."""
    found = []

    def take(value) -> None:
        if isinstance(value, list):
            for v in value:
                take(v)
        elif isinstance(value, dict):
            found.append(value)
            take(value.get("@graph", []))

    for node in parse(html).walk():
        if node.tag == "script" and node.attrs.get("type", "").lower() == "application/ld+json":
            try:
                take(json.loads("".join(c for c in node.children if isinstance(c, str))))
            except ValueError:
                continue
    return found


def canonical_of(html: str | None) -> str:
    """The page's own statement of its URL: link, then og:url."""
    root = parse(html)
    for node in root.walk():
        if node.tag == "link" and "canonical" in node.attrs.get("rel", "").lower().split():
            return node.attrs.get("href", "").strip()
    return next((m["content"] for m in metas_of(html) if m["name"] in ("og:url", "url")), "")


def _address(url: object) -> str:
    return str(url or "").split("#")[0].rstrip("/").lower()


def stated_body(html: str | None, url: str = "") -> str:
    """The longest body that the page's JSON-LD states for this address."""
    best = ""
    for node in json_ld_of(html):
        about = node.get("url") or node.get("@id") or node.get("mainEntityOfPage")
        about = about.get("@id") if isinstance(about, dict) else about
        body = node.get("articleBody") or node.get("text")
        if isinstance(body, str) and (not about or not url or _address(about) == _address(url)):
            best = max(best, " ".join(body.split()), key=len)
    return best


def _body_roots(root: Node) -> list[Node]:
    """Elements that may hold the body: articles first, then by the order of the marks; the whole page if there is none."""
    nodes = list(root.walk())
    marked = [n for a, mark, whole in BODY_MARKS for n in nodes if (n.attrs.get(a) == mark if whole else mark in n.attrs.get(a, ""))]
    found = [n for n in nodes if n.tag == "article"] + marked + [n for n in nodes if n.tag == "main"]
    return list(dict.fromkeys(found)) or [n for n in nodes if n.tag == "body"] or [root]


def body_of(html: str | None, url: str = "", least: int = 300, limit: int = 60_000) -> str:
    """Main text: the first of the stated body and the roots' texts with ``least`` characters, else the longest."""
    texts = [stated_body(html, url), *map(_prose, _body_roots(parse(html)))]
    return next((t for t in texts if len(t) >= least), max(texts, key=len))[:limit]


def _prose(root: Node) -> str:
    """Blocks of ``LEAST_BLOCK`` characters outside furniture; one that an earlier block holds already is left out."""
    whole = "\n"
    pending: list[Node] = [root]
    while pending:
        node = pending.pop()
        text = node.text() if node.tag in BLOCKS and node is not root else ""
        if len(text) >= LEAST_BLOCK and text not in whole:
            whole += text + "\n\n"
        pending.extend(n for n in reversed(node.children) if isinstance(n, Node) and n.tag not in SILENT and not n.furniture)
    return whole.strip("\n")


def dates_of(html: str | None) -> str | None:
    """The one day that the time elements outside furniture name; null if there are several."""
    days = set()
    for node in parse(html).walk():
        if node.tag == "time" and not node.inside(FRAME) and "modified" not in " ".join(node.attrs.values()).lower():
            if r := dates.read(node.attrs.get("datetime") or node.text()[:100]):
                days.add(r.local.date().isoformat())
    return days.pop() if len(days) == 1 else None


def explode_pages(pages: DataFrame, key: str, html: str, schema: str, take: Callable[[str, str], list[dict]], url: str | None = None) -> DataFrame:
    """(key, no, ...): what ``take(html, url)`` finds in each page, numbered from 1."""
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key), F.col(html).alias("tw_html"), (F.col(url) if url else F.lit("")).alias("tw_url"))
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, h, u in zip(batch[key], batch["tw_html"], batch["tw_url"]):
                out += [(k, n, *[r.get(c) for c in names]) for n, r in enumerate(take(h, u or ""), 1)]
            yield pd.DataFrame(out, columns=[key, "no", *names])

    return rows.mapInPandas(over, f"`{key}` {kind}, no int, {schema}")


def links(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, no, url, title, near_date) of a page's links, URLs in normal form."""
    found = explode_pages(pages, key, html, "url string, title string, near_date string", lambda h, u: links_of(h, u), url)
    return found.withColumn("url", normalize_url(F.col("url"))).where("url <> ''")


def metas(pages: DataFrame, key: str, html: str) -> DataFrame:
    return explode_pages(pages, key, html, "name string, content string", lambda h, _: metas_of(h))


def extracts(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, no, text, canonical, day): what a page says of itself."""

    def take(h: str, u: str) -> list[dict]:
        return [{"text": body_of(h, u), "canonical": canonical_of(h), "day": dates_of(h)}]

    return explode_pages(pages, key, html, "text string, canonical string, day string", take, url)


def host_in(url: str, domain: str) -> bool:
    host = (urlsplit(url).hostname or "").lower()
    return host == domain or host.endswith("." + domain)


def clean_markup(text: str | None) -> str:
    """Text without tags, white space collapsed."""
    return parse(text).text() if text and "<" in text else re.sub(r"\s+", " ", text or "").strip()
