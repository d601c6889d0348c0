"""Main text of web pages: structure rules plus removal of site templates.

A page is read as a tree of elements. Every subtree gets a hash of its tags and
text; Spark counts, per host, on how many different pages each hash occurs, and
subtrees that recur on ``least`` pages of a host, however many pages it has, are its
template (menus, notices, share bars, adverts) and are deleted. Inside an article, paragraphs, headings, lists and
other prose are never taken for template: an article may quote or be copied.
Elements whose name, role, class or id says what they are (nav, form, "sidebar",
"comments") go by that alone. If a page has an article or main element, only its
content counts.

A page gets only the template hashes that it holds, so what is joined to it does not
grow with its host.

Defined results: NULL or empty html gives the empty text; a NULL url has no host
and no template; pages with equal html count once towards a template; repeated
rows are extracted each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, semi_join, stored

# Element names of HTML by what they mean for a page's text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}  # no elements inside
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "audio", "video",
           "object", "head", "label", "fieldset", *RAW}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "ol", "ul", "dl", "figure"}
BLOCK = {"address", "article", "body", "caption", "center", "dd", "details", "div", "dt", "figcaption", "header", "hr",
         "html", "li", "main", "section", "summary", "tbody", "tfoot", "thead", "tr", *PROSE, *DROPPED}
INLINE_DROPPED = {"button", "select", "svg", "canvas", "label", "script", "style"}  # do not end a block
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
# Words in class, id or role that name boilerplate.
NAMED = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
         "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "masthead", "menu", "modal",
         "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
         "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
         "subscribe", "toolbar", "widget"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>",
                    re.S)
_NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")


def _drops(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    words = {w for m in _NAME.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
    if tag == "article":
        return "comment" in words
    return bool(words & NAMED) or bool(_HIDDEN.search(attributes))


class _Open:
    """An element that is not closed yet."""

    __slots__ = ("tag", "parts", "article", "dropped", "prose")

    def __init__(self, tag: str, article: bool, dropped: bool, prose: bool):
        self.tag, self.parts, self.article, self.dropped, self.prose = tag, [], article, dropped, prose


def read_page(source: str) -> tuple[list[tuple[str, bool, tuple[int, ...]]], list[int]]:
    """Blocks in page order (text, in an article, hashes of the deletable subtrees around it), and all such hashes.

    Dropped elements give no blocks, but their subtrees are hashed.
    """
    blocks: list[tuple[str, bool, list[list[int]]]] = []
    hashes: dict[int, None] = {}
    stack = [_Open("", False, False, False)]
    around: list[list[int]] = []  # one cell per open deletable element; filled with its hash when it closes
    cells: list[list[int] | None] = [None]
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append((joined, stack[-1].article, list(around)))

    def close() -> None:
        top = stack[-1]
        if top.tag in BLOCK and top.tag not in INLINE_DROPPED:
            flush()
        stack.pop()
        cell = cells.pop()
        digest = xxhash.xxh3_64_intdigest(f"{top.tag}({'|'.join(top.parts)})")
        stack[-1].parts.append(f"{digest:x}")
        if cell is not None:
            around.pop()
            cell.append(digest - (1 << 63))
            if any(top.parts):
                hashes[cell[0]] = None

    def put(piece: str) -> None:
        stack[-1].parts.append(" ".join(piece.split()))
        if not stack[-1].dropped:
            text.append(piece)

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            put(source[at:])
            break
        if m.start() > at:
            put(source[at:m.start()])
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        tag = m[2].lower()
        if m[1]:
            if any(o.tag == tag for o in reversed(stack)):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in BLOCK and tag not in INLINE_DROPPED:
            if any(o.tag == "p" for o in stack[-8:]):
                while any(o.tag == "p" for o in stack[-8:]):
                    close()
            flush()
        if tag in CLOSED_BY:
            while stack[-1].tag in CLOSED_BY[tag]:
                close()
        top = stack[-1]
        if tag in ("td", "th") and not top.dropped:
            text.append(" ")
        if tag in VOID:
            if tag in ("br", "wbr", "hr", "img") and not top.dropped:
                text.append(" " if tag != "wbr" else "")
            continue
        article = top.article or tag in ("article", "main")
        dropped = top.dropped or _drops(tag, m[3], top.article)
        prose = top.prose or (article and tag in PROSE)
        deletable = not prose and tag not in ("html", "body", "article", "main")
        stack.append(_Open(tag, article and not dropped, dropped, prose))
        cell: list[int] | None = [] if deletable else None
        cells.append(cell)
        if cell is not None:
            around.append(cell)
        if m[3].endswith("/") and tag in ("svg", "canvas"):
            close()
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if tag != "title" and tag != "textarea":
                stack[-1].parts.append(source[at:stop.start() if stop else end])
            at = stop.start() if stop else end
    while len(stack) > 1:
        close()
    flush()
    return [(t, a, tuple(c[0] for c in cells_ if c)) for t, a, cells_ in blocks], list(hashes)


def main_text(source: str, template: set[int]) -> str:
    blocks, _ = read_page(source)
    if any(in_article for _, in_article, _ in blocks):
        blocks = [b for b in blocks if b[1]]
    return "\n\n".join(t for t, _, around in blocks if not template.intersection(around))


def site_templates(pages: DataFrame, least: int) -> DataFrame:
    """host, page, template: of each different page, the hashes of its subtrees that are on ``least`` pages of the host."""
    def subtrees(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch["host"], batch["page"], pa.array([read_page(x or "")[1] for x in batch["html"].to_pylist()],
                                                    pa.list_(pa.int64()))], names=["host", "page", "subtrees"])

    found = map_batches(pages.filter("host IS NOT NULL").select("host", "page", "html"), subtrees,
                        "host string, page long, subtrees array<long>")
    found = stored(found.dropDuplicates(["host", "page"]), "subtrees")
    # a hash of a host as one number, so that the frequent ones can be sent to the pages
    parts = (found.select("host", "page", F.explode("subtrees").alias("hash"))
             .withColumn("part", F.xxhash64("host", "hash")))
    often = parts.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("part")
    return (semi_join(parts, stored(often, "template-parts"), "part")
            .groupBy("host", "page").agg(F.collect_list("hash").alias("template")))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 5,
            broadcast_limit: int = 50_000) -> DataFrame:
    """One row per input row: id, url, text. ``least``: on how many different pages of its host a subtree of a template occurs."""
    host = F.nullif(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    pages = df.select(F.col(id_col), F.col(url_col), host.alias("host"), F.col(html_col).alias("html"),
                      F.xxhash64(F.coalesce(F.col(html_col), F.lit(""))).alias("page"))
    templates = stored(site_templates(pages, least), "templates")
    few = templates.count() <= broadcast_limit  # one row per page; sent to every executor only up to that many
    pages = pages.join(F.broadcast(templates) if few else templates, ["host", "page"], "left")

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [main_text(x or "", set(t or ())) for x, t in zip(batch["html"].to_pylist(), batch["template"].to_pylist(),
                                                               strict=True)]
        return pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(out, pa.string())], names=[id_col, url_col, "text"])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string"
    return map_batches(pages.select(id_col, url_col, "html", "template"), texts, schema)
