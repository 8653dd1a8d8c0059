"""Main text of web pages by composite text density.

Each block element of the DOM gets its characters per tag, adjusted by the share of link characters and link tags (C, T, LC,
LT of its subtree, LCb and Cb of the body): ``C / T * log(C * T / (LC * LT))`` to the base ``ln(C * LC / (C - LC) + LCb * C /
Cb + e)``, where a zero divisor counts as one and the base is at least 2. A node's density sum adds up the densities of its
block children (a leaf's is its own). The node with the largest sum is the content; the threshold is the least density on
the path from the body to it. The result is the outermost ``article`` or ``main`` on that path, all of whose nodes reach the
threshold; without one, the content node and every other subtree that reaches the threshold.

Scripts, styles, controls and hidden elements are cut before. So are menus, headers, footers, sidebars, notices, adverts, forms
and reader comments, by element name or, for containers, by whole tokens of ``class``, ``id`` and ``role``; but never one that
holds an ``article`` or ``main`` or most of the page's text outside links, and none if no text would be left. Only reader
comments, and elements by name that hold no article, go whatever their length if there is an article besides them. The
threshold decides on the rest.

Null or empty html, or a page without text: an empty string. Broken markup is read as browsers do: unclosed elements end with
their parent, stray end tags are skipped. Repeated pages: a row each.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HINT = re.compile(r"class|id|role", re.IGNORECASE)

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CUT = {
    "head", "button", "select", "option", "label", "input", "object", "embed", "applet", "canvas", "audio", "video", "map",
}
#: elements that are cut unless they hold the article
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: elements that class, id and role can mark
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "center", *ASIDE}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
#: words of class, id or role that mark what is not the article
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "complementary", "contentinfo", "comment",
    "comments", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "search", "login", "signup",
    "pagination", "pager", "skip",
}
#: words that may stand beside those in a token
PLAIN = {"site", "main", "top", "bottom", "left", "right", "box", "bar", "container", "wrapper", "block", "area", "links", "list", "buttons", "posts"}
COMMENTS = {"comment", "comments", "disqus", "respond", "reply", "replies"}
#: an open element ends when one of these starts
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"},
}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "blockquote", "nav", "aside", "footer", "header", "form"}


def _marked(name: str, attrs: str) -> tuple[bool, int]:
    """(hidden, mark) of an element; the mark is 3 for an element of ASIDE, 2 for reader comments, 1 for other marks, 0 for the rest."""
    mark = 3 if name in ASIDE else 0
    if not HINT.search(attrs):
        return False, mark
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value.strip() == "true":
            return True, 0
        if name in CONTAINERS and key in ("class", "id", "role"):
            for token in value.split():
                words = {w for w in re.split(r"[^a-z0-9]+", token) if w}
                if words & MARKS and words <= MARKS | PLAIN:
                    mark = max(mark, 2 if words & COMMENTS else 1)
    return False, mark


class Page:
    """Block elements of a page with their counts; node 0 is the root."""

    def __init__(self, source: str):
        self.parent, self.name = [-1], ["html"]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.mark = [0]
        self.runs: list[tuple[int, str]] = []  # (block, text of one run between block borders)
        self._read(source)

    def _read(self, source: str) -> None:
        stack = [("html", 0, False, False)]  # (element, its block, inside a cut, inside a link)
        words: list[str] = []
        at, end = 0, len(source)

        def flush() -> None:
            if words:
                text = " ".join("".join(words).split())
                words.clear()
                if text:
                    block = stack[-1][1]
                    self.runs.append((block, text))
                    self.chars[block] += len(text)

        def add(text: str) -> None:
            if text and not stack[-1][2]:
                text = html.unescape(text)
                words.append(text)
                if stack[-1][3]:
                    self.link_chars[stack[-1][1]] += len(" ".join(text.split()))

        while at < end:
            m = TOKEN.search(source, at)
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    add(m[0][9:].removesuffix("]]>"))
                continue
            name, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
            if m["end"] or m["end2"]:
                if name == "br" or name == "p" and not any(e[0] == "p" for e in stack):
                    add(" ")
                elif name not in ("html", "body"):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            if any(e[0] not in INLINE for e in stack[k:]):
                                flush()
                            del stack[k:]
                            break
                        if name in INLINE and stack[k][0] not in INLINE:
                            break
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                at = close.end() if close else end
                continue
            if name == "html":
                continue
            inline = name in INLINE
            if not inline and name not in VOID or name == "hr":
                flush()
                shut = CLOSES.get(name)
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph; list items and cells end each other
                    open_name = stack[k][0]
                    if open_name == "p" or shut and open_name in shut:
                        del stack[k:]
                        if open_name != "p":
                            break
                    elif open_name not in INLINE and (not shut or open_name in SCOPES):
                        break
            block = stack[-1][1]
            if name == "br":
                add(" ")
            if not stack[-1][2]:
                self.tags[block] += 1
                if name == "a":
                    self.link_tags[block] += 1
            if name in VOID:
                continue
            hidden, mark = _marked(name, attrs) if name not in ("body", "article", "main") else (False, 0)
            cut = stack[-1][2] or name in CUT or hidden
            if not inline and not cut:
                self.parent.append(block)
                self.name.append(name)
                self.mark.append(mark)
                for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
                    counts.append(0)
                block = len(self.parent) - 1
            stack.append((name, block, cut, stack[-1][3] or name == "a"))
        flush()

    def _cut(self) -> None:
        """Take out marked blocks with what is in them."""
        n = len(self.parent)
        if not any(self.mark):
            return
        plain = [c - lc for c, lc in zip(self.chars, self.link_chars)]
        inside, holds = [False] * n, [x in ("article", "main") for x in self.name]
        for k in range(1, n):
            inside[k] = self.mark[k] > 0 or inside[self.parent[k]]
        free = [0 if i else x for i, x in zip(inside, plain)]
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            plain[up] += plain[k]
            free[up] += free[k]
            holds[up] = holds[up] or holds[k]
        story = [x in ("article", "main") and f > 0 for x, f in zip(self.name, free)]
        stories, around, cut = sum(story), [0] * n, [False] * n
        for k in range(1, n):
            up = self.parent[k]
            around[k] = around[up] + story[up]
            beside = stories if self.mark[k] == 2 else stories - around[k] if self.mark[k] == 3 and not holds[k] else 0
            cut[k] = cut[up] or self.mark[k] > 0 and (beside > 0 or not holds[k] and 2 * plain[k] <= plain[0])
        if not any(c for c, gone in zip(self.chars, cut) if not gone):
            return
        new, left = {}, [k for k in range(n) if not cut[k]]
        for k in left:
            new[k] = len(new)
        self.parent = [new.get(self.parent[k], -1) for k in left]
        self.name, self.chars, self.tags, self.link_chars, self.link_tags, self.mark = (
            [x[k] for k in left] for x in (self.name, self.chars, self.tags, self.link_chars, self.link_tags, self.mark)
        )
        self.runs = [(new[k], t) for k, t in self.runs if k in new]

    def content(self) -> set[int]:
        """Blocks whose text is the page's."""
        self._cut()
        n = len(self.parent)
        for k in range(n - 1, 0, -1):  # children come after their parent
            for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
                counts[self.parent[k]] += counts[k]
        if not self.chars[0]:
            return set()
        body = max((k for k in range(n) if self.name[k] == "body"), key=lambda k: self.chars[k], default=0)
        body = body if self.chars[body] else 0
        share = self.link_chars[body] / self.chars[body]

        def density(k: int) -> float:
            c, t, lc, lt = self.chars[k], self.tags[k] or 1, self.link_chars[k], self.link_tags[k]
            if not c:
                return 0.0
            base = math.log(c * lc / (max(c - lc, 0) or 1) + share * c + math.e)
            return c / t * max(0.0, math.log(max(1.0, c * t / ((lc or 1) * (lt or 1))), max(2.0, base)))

        dense = [density(k) for k in range(n)]
        total, leaf = [0.0] * n, [True] * n
        for k in range(1, n):
            total[self.parent[k]] += dense[k]
            leaf[self.parent[k]] = False
        total = [d if end else s for d, s, end in zip(dense, total, leaf)]
        inside = [k == body for k in range(n)]
        for k in range(n):
            inside[k] = inside[k] or k > 0 and inside[self.parent[k]]
        best = max((k for k in range(n) if inside[k]), key=lambda k: (total[k], -k))
        path = [best]
        while path[-1] not in (body, 0):
            path.append(self.parent[path[-1]])
        threshold = min(dense[k] for k in path)
        named = [k for k in path if self.name[k] in ("article", "main")]
        chosen = [False] * n
        for k in range(n):
            if named:
                chosen[k] = k == named[-1]
            else:
                chosen[k] = k == best or inside[k] and k not in path and dense[k] >= threshold
            chosen[k] = chosen[k] or k > 0 and chosen[self.parent[k]]
        # siblings of a chosen article are articles of the same page
        if named:
            for k in range(n):
                if self.name[k] == self.name[named[-1]] and self.parent[k] == self.parent[named[-1]] and dense[k] >= threshold:
                    chosen[k] = True
                chosen[k] = chosen[k] or k > 0 and chosen[self.parent[k]]
        return {k for k in range(n) if chosen[k]}

    def text(self) -> str:
        chosen = self.content()
        return " ".join(t for k, t in self.runs if k in chosen)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "html"):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
