"""Main text of web pages, with removal of site templates.

First pass: each page is parsed and the block elements outside its article are hashed with all they
hold; Spark counts, for each host and hash, the pages of different content that carry that subtree.
Second pass: subtrees that recur across many pages of their host go, together with elements whose tag,
role, class or id says what they are (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments). Text inside an article (or main) element is never taken for a template, so a
paragraph that many articles of a site quote stays.

Template hashes are broadcast while they are few (counted first, at most ``BROADCAST_ROWS``); beyond that they
are joined to each page's own subtree list instead.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgraph.llm.runtime import cut, prepare, text_or_empty

BROADCAST_ROWS = 200_000
#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    """
    address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul
    caption option
    """.split()
)
GONE = frozenset(
    """
    head script style noscript template iframe object embed applet svg math canvas audio video form button select textarea input
    nav footer aside dialog menu search
    """.split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "body", "html", "legend"}
#: Words in class, id or role that mark what isn't the article.
MARKS = frozenset(
    """
    ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promos promotion
    sidebar sidebars aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar header footer
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
    login social share sharing related recommended recommendations comment comments commentlist disqus respond reply replies
    pagination pager toolbar copyright legal disclaimer skip search searchbox contentinfo complementary dialog
    """.split()
)
#: Words that may stand beside a mark in the name of a part of the page.
PARTS = frozenset(
    """
    area bar block body box button buttons container content form group inner item items link links list main outer page panel
    post posts row section site slot thread top unit wrap wrapper
    """.split()
)
#: Marks that inside an article name parts of it just as well.
OWN = frozenset("alert banner dialog disclaimer header legal notice notices search skip".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")


def marked(attrs: str, article: bool) -> bool:
    """An element that its attributes name as something beside the article, or as hidden."""
    if not attrs or attrs.isspace():
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif name in ("class", "id", "role") and any(named(one, article) for one in value.split()):
            return True
    return False


def named(one: str, article: bool) -> bool:
    """A whole class name, id or role that says nothing but a mark, perhaps with words for a part of the page and numbers."""
    parts = [x for x in SPLIT.split(CAMEL.sub(r"\1 \2", one).lower()) if x and not x.isdigit()]
    marks = MARKS - OWN if article else MARKS
    return not marks.isdisjoint(parts) and all(x in marks or x in PARTS for x in parts)


def role_main(attrs: str) -> bool:
    return "main" in attrs and any(n.lower() == "role" and (a or b or c) == "main" for n, a, b, c in ATTR.findall(attrs))


class Page:
    """One pass over a page: blocks of text with what encloses them, and hashes of block subtrees."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, frozenset | tuple, int, int]] = []  # text, hashes around it, in article, in main
        self.subtrees: list[int] = []
        self.pieces: list[str] = []
        self.stack: list[dict] = []
        self.done: list[tuple[list, list]] = []
        self.gone = self.article = self.main = 0
        self.trace: list[str] = []
        self.spans: list[tuple[int, int, int, bool]] = []  # first and end block, hash, in article
        self.parse(source)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text:
                self.blocks.append((text, (), self.article, self.main))

    def text(self, raw: str) -> None:
        if not raw:
            return
        raw = html.unescape(raw) if "&" in raw else raw
        if not self.gone:
            self.pieces.append(raw)
        if not self.article and not raw.isspace():
            self.trace.append(" ".join(raw.split()))

    def close(self) -> None:
        e = self.stack.pop()
        if e["block"]:
            self.flush()
        self.gone -= e["gone"]
        self.article -= e["article"]
        self.main -= e["main"]
        if e["block"] and not self.article and not e["holds"]:
            key = xxhash.xxh3_64_intdigest("\x00".join(self.trace[e["trace"] :]))
            self.spans.append((e["first"], len(self.blocks), key, bool(self.gone)))
        if self.stack and (e["holds"] or e["article"]):
            self.stack[-1]["holds"] = True

    def open(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self.implied("p", {"table", "td", "th", "button", "object", "caption", "article", "section", "div"})
        if tag == "li":
            self.implied("li", {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            self.implied("dd", {"dl"}) or self.implied("dt", {"dl"})
        elif tag in ("td", "th", "tr"):
            self.implied("td", {"tr", "table"}) or self.implied("th", {"tr", "table"})
            if tag == "tr":
                self.implied("tr", {"table"})
        elif tag == "option":
            self.implied("option", {"select"})
        block = tag in BLOCK
        if block:
            self.flush()
        elif tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        article = tag == "article"
        main = tag == "main" or (block and role_main(attrs))
        named = tag not in ("html", "body", "article", "main") and not main and marked(attrs, bool(self.article)) and not (self.article and tag in ("header", "h1", "h2", "h3"))
        gone = tag in GONE or named or (tag == "header" and not self.article)
        if not self.article:
            self.trace.append(f"<{tag}")
        self.stack.append(
            {
                "tag": tag,
                "block": block,
                "gone": int(gone),
                "article": int(article and not (gone or self.gone)),
                "main": int(main),
                "first": len(self.blocks),
                "trace": max(0, len(self.trace) - 1),
                "holds": False,
            }
        )
        self.gone += gone
        self.article += self.stack[-1]["article"]
        self.main += main

    def implied(self, tag: str, walls: set[str]) -> bool:
        """Ends an open element that a new one ends without a tag of its own."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k]["tag"]
            if name == tag:
                while len(self.stack) > k:
                    self.close()
                return True
            if name in walls:
                return False
        return False

    def end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k]["tag"] == tag:
                while len(self.stack) > k:
                    self.close()
                return
            if self.stack[k]["tag"] in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html", "table", "div", "section"):
                break
        if tag in ("p", "br"):
            self.flush() if tag == "p" else self.text(" ")

    def parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if not m:
                self.text(source[at:])
                break
            self.text(source[at : m.start()])
            at = m.end()
            slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self.end(tag)
                continue
            self.open(tag, attrs)
            if tag in RAW:
                m = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(source, at)
                at = m.end() if m else n
                if self.stack and self.stack[-1]["tag"] == tag:
                    self.close()
        while self.stack:
            self.close()
        self.flush()

    def chosen(self) -> list[bool]:
        """Blocks of the main region: articles, else main, else the whole body."""
        for k in (2, 3):
            if any(b[k] for b in self.blocks):
                return [bool(b[k]) for b in self.blocks]
        return [True] * len(self.blocks)

    def main_text(self, templates) -> str:
        keep = self.chosen()
        for first, end, key, gone in self.spans:
            if not gone and end > first and not any(self.blocks[i][2] for i in range(first, end)) and key in templates:
                keep[first:end] = [False] * (end - first)
        return "\n\n".join(b[0] for b, k in zip(self.blocks, keep, strict=True) if k)

    def signature(self) -> int:
        """Of all the page's blocks: exact copies count as one, and a block that pages share, however long, doesn't make them one."""
        return xxhash.xxh3_64_intdigest("\x00".join(b[0] for b in self.blocks)) >> 1

    def candidates(self) -> set[int]:
        return {key for first, end, key, gone in self.spans if end > first and not gone}


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def keyed(host: str, keys) -> set[int]:
    """Subtree hashes as this host's own."""
    seed = xxhash.xxh3_64_intdigest(host)
    return {(k * 0x9E3779B97F4A7C15 ^ seed) & 0x7FFFFFFFFFFFFFFF for k in keys}


def subtree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sigs = [], []
        for url, source in zip(batch.column(0), batch.column(1), strict=True):
            page = Page(source.as_py())
            own = keyed(host_of(url.as_py()), page.candidates())
            keys += own
            sigs += [page.signature()] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sigs, pa.int64())], ["key", "sig"])


class Own:
    """Whether a subtree hash, made the host's own, is a template."""

    def __init__(self, host: str, known):
        self.host, self.known = host, known

    def __contains__(self, key: int) -> bool:
        (k,) = keyed(self.host, (key,))
        if isinstance(self.known, set):
            return k in self.known
        i = np.searchsorted(self.known, k)
        return i < len(self.known) and self.known[i] == k


def texts(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """Columns page_id, url, html and, where known is None, the page's templates."""
    for batch in batches:
        out = []
        for i, (url, source) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            own = known if known is not None else set(batch.column(3)[i].as_py() or ())
            out.append(Page(source.as_py()).main_text(Own(host_of(url.as_py()), own)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(
    pages: DataFrame, min_pages: int = 10, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A subtree is a template when at least ``min_pages`` pages of its host with different blocks hold it; pages
    with the same blocks are copies and count as one.
    Null or empty html gives an empty text, a null url counts as the host "". Ids may be null or repeat; an empty
    table gives no rows; other columns don't matter.
    """
    spark = prepare(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    rows = own.select("url", "html").mapInArrow(subtree_rows, "key long, sig long")
    templates = cut(rows.groupBy("key").agg(F.count_distinct("sig").alias("n")).where(F.col("n") >= min_pages).select("key"))
    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long"
    if templates.count() <= broadcast_rows:
        known = spark.sparkContext.broadcast(np.array(sorted(r["key"] for r in templates.collect()), np.int64))
        return own.mapInArrow(lambda it: texts(it, known.value), schema)
    page = F.xxhash64("page_id", "url", "html")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, url, source in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                k = keyed(host_of(url.as_py()), Page(source.as_py()).candidates())
                ids += [i.as_py()] * len(k)
                keys += k
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["page", "key"])

    lists = own.select(page.alias("page"), "url", "html").mapInArrow(listed, "page long, key long").join(templates, "key", "left_semi").groupBy("page").agg(F.collect_set("key").alias("keys"))
    joined = own.withColumn("page", page).join(lists, "page", "left").select("page_id", "url", "html", "keys")
    return joined.mapInArrow(lambda it: texts(it, None), schema)
