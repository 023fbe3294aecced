"""Main text of web pages by line-block distribution.

Markup is stripped to lines: the texts of blocks (paragraphs, headings, list items ...). A line weighs its characters, less
those inside links; lines of menus, headers, footers, sidebars, notices, adverts, forms and comments weigh nothing, and those
that stand in no paragraph or the like a quarter, unless most of the page's text does. Sums of weights over windows of ``WINDOW`` lines rise sharply where the
article begins and fall to nothing where it ends: from each such surge to its dive, less what is weak at either end, the lines
with weight are the main text. The rise that counts goes by the page's largest sum, so short articles are found as well. Where
a page marks its article and that is not a small part of its text, lines outside weigh nothing and each line inside enough for
a surge.

What an element is goes by its name, and by whole words of its class, id or role; one so named that holds most of the page's
text is no aside. Parsing takes time in proportion to the page: where an element is open is looked up, not searched for.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 86

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<\Z""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
    "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button",
}
VOID = {"hr"}
#: Elements without content.
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Open blocks that a start tag ends, and the blocks around them at which that stops. A paragraph is ended by any block.
ENDS_OPEN = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "optgroup": ("option", "optgroup")}
AROUND = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",)}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "fieldset", "search", "head"}
ARTICLE = {"article", "main"}
#: Words of class, id or role that mark what is not the article.
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "consent",
    "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget", "widgets",
}
#: Parts that such a word may be joined to by - or _ and remain one ("comment-list", but not "notice-board"); headers and
#: footers only to the first row ("site-header", but not "entry-header").
OF_SITE = {"site", "main", "global", "primary", "top", "bottom"}
JOINED = OF_SITE | {"secondary", "left", "right", "list", "area", "section", "block", "box", "container", "wrapper", "wrap", "bar", "links", "slot", "unit", "policy", "posts"}
#: Such words name what an article is about as well as they name a control: inside an article its elements tell.
OF_CONTROLS = {"search", "form", "login", "toolbar"}
NEVER_ASIDE = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks whose text may begin an article, and those whose text may end one, however short.
BEGINS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre"}
ENDS = {"p", "blockquote", "pre", "li", "dd", "td"}
FULL = BEGINS | ENDS | {"th", "dt", "caption", "figcaption", "summary"}


def is_named_aside(token: str, in_article: bool = False) -> bool:
    parts = re.split("[-_]+", token)
    if {"header", "footer"} & {*parts}:
        return not in_article and all(p in OF_SITE or p in ("header", "footer") for p in parts)
    if in_article and OF_CONTROLS & {*parts}:
        return False
    return any(p in ASIDE_NAMES for p in parts) and all(p in ASIDE_NAMES or p in JOINED for p in parts)


def attributes_of(raw: str) -> dict[str, str]:
    """The attributes of a tag by name, the first of equals; one without a value is empty. What quotes hold is never a name."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        if name:
            out.setdefault(name.lower(), a or b or c)
    return out


def kind_of(name: str, attributes: str, in_article: bool) -> str:
    """"aside" by the element's name or as hidden, "named" by its names, or "" for neither."""
    if name in ASIDE or name == "header" and not in_article:
        return "aside"
    if not attributes or name in NEVER_ASIDE:
        return ""
    has = attributes_of(attributes)
    if "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true" or NOT_SHOWN.search(has.get("style", "")):
        return "aside"
    names = " ".join(has.get(a, "") for a in ("class", "id", "role")).lower().split()
    return "named" if any(is_named_aside(t, in_article) for t in names) else ""


@dataclass(frozen=True)
class Place:
    """An open element, or the page: what it and those around it say of the text inside."""

    name: str = ""
    aside: bool = False
    named: int = 0  # the innermost block that is an aside by its names
    article: bool = False
    mute: bool = False  # in an inline aside, whose text is no part of its line


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    block: str
    aside: bool
    named: int
    article: bool

    @property
    def own(self) -> int:
        """Characters outside links; none where half or more are inside."""
        return len(self.text) - self.linked if 2 * self.linked < len(self.text) else 0


def lines(page: str) -> list[Line]:
    """Each block with text, in page order. A block by whose names it is an aside is none if it holds most of the page's text."""
    out: list[Line] = []
    stack: list[Place] = [Place()]
    where: dict[str, list[int]] = {}  # the places of open elements in the stack, by name
    around = [0]  # for each named aside, the one around it
    parts: list[str] = []
    linked: list[str] = []
    in_link, at, block = False, 0, ""

    def end_line() -> None:
        text = " ".join("".join(parts).split())
        if text:
            now = stack[-1]
            out.append(Line(text, len(" ".join("".join(linked).split())), block, now.aside, now.named, now.article))
        parts.clear()
        linked.clear()

    def add(raw: str) -> None:
        if not stack[-1].mute:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text)

    def last(names: tuple[str, ...]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    def pop(k: int) -> None:
        for place in reversed(stack[k:]):
            where[place.name].pop()
        del stack[k:]

    while m := TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closes, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in RAW:
            if not closes and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            end_line()
            in_link = False
            if closes:
                if where.get(name):
                    pop(where[name][-1])
            else:
                while where.get("p") and where["p"][-1] == len(stack) - 1:
                    pop(len(stack) - 1)
                while (k := last(ENDS_OPEN.get(name, ()))) > last(AROUND.get(name, ())):
                    pop(k)
                if name not in VOID:
                    now = stack[-1]
                    article = now.article or name in ARTICLE
                    kind = kind_of(name, attributes, article)
                    if kind == "named":
                        around.append(now.named)
                    where.setdefault(name, []).append(len(stack))
                    stack.append(Place(name, now.aside or kind == "aside", len(around) - 1 if kind == "named" else now.named, article, now.mute))
            block = stack[-1].name
        else:
            if name == "a":
                in_link = not closes
            if closes:
                if where.get(name):
                    pop(where[name][-1])
            elif name not in EMPTY and not attributes.endswith("/") and (where.get(name) or attributes and kind_of(name, attributes, stack[-1].article)):
                now = stack[-1]
                where.setdefault(name, []).append(len(stack))
                stack.append(Place(name, now.aside, now.named, now.article, True))
    add(page[at:])
    end_line()
    held, gone = [0] * len(around), [False] * len(around)
    for line in out:
        held[line.named] += 0 if line.aside else line.own
    for k in range(len(around) - 1, 0, -1):
        held[around[k]] += held[k]
    for k in range(1, len(around)):
        gone[k] = gone[around[k]] or 2 * held[k] <= held[0]
    for line in out:
        line.aside = line.aside or gone[line.named]
    return out


def distribution(found: list[Line]) -> list[tuple[float, bool, bool]]:
    """For each line its weight, and whether it may begin and end an article.

    Text in no paragraph or the like counts a quarter, unless it is most of the page's text; then its long lines, or if there
    are none all of them, are as good as paragraphs.
    """
    shown = [x for x in found if not x.aside]
    inside = sum(x.own for x in shown if x.article)
    total = sum(x.own for x in shown)
    if inside and 5 * inside >= total:
        return [(0, False, False) if x.aside or not x.article else (max(SURGE + 1, len(x.text)), True, True) for x in found]
    bare = [x.own for x in shown if x.block not in FULL]
    divided = 2 * sum(bare) > total
    long = SURGE if max(bare, default=0) > SURGE else 0

    def of(x: Line) -> tuple[float, bool, bool]:
        if x.aside or not x.own:
            return 0, False, False
        if x.block in FULL:
            return x.own, x.block in BEGINS or x.own > SURGE, x.block in ENDS or x.own > SURGE
        return (x.own, x.own > long, x.own > long) if divided else (x.own / 4, False, False)

    return [of(x) for x in found]


def main_text(page: str) -> str:
    """Blocks of the main text in page order, joined by an empty line; empty if there is none."""
    found = lines(page)
    weighed = distribution(found)
    sums = [sum(w for w, _, _ in weighed[k : k + WINDOW]) for k in range(len(weighed))]
    rise = min(SURGE, max(sums, default=0) / 4)
    kept, surge = [], None
    for k, now in enumerate([*sums, 0]):
        if surge is None and now > rise:
            surge = k
        elif surge is not None and now == 0:
            first = next((i for i in range(surge, k) if weighed[i][1]), k)
            end = next((i for i in range(k - 1, first - 1, -1) if weighed[i][2]), first - 1)
            # A paragraph that is all link is part of the article it stands in.
            kept += [found[i].text for i in range(first, end + 1) if weighed[i][0] or found[i].block in BEGINS and not found[i].aside and found[i].article == found[first].article]
            surge = None
    return "\n\n".join(kept)


def extracted(pages: DataFrame, carry: list[str], column: str = "html") -> DataFrame:
    """carry's columns with text and n_chars (code points) of every page.

    A null page counts as empty and gives an empty text; so does one without main text. Pages cut off anywhere, unclosed
    elements and stray brackets are read as far as they go. A page is read whole, in time and memory in proportion to its length.
    Rows are independent: repeated ones get equal texts, an empty
    table an empty result. A carried column named like an output is replaced by it.
    """
    carry = [c for c in carry if c.lower() not in ("text", "n_chars")]
    wanted = pages.select(*(pages[f"`{c}`"] for c in carry), F.coalesce(pages[f"`{column}`"], F.lit("")).alias("q_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*carry, "text", "n_chars"])

    return wanted.mapInArrow(run, wanted.drop("q_html").schema.add("text", "string").add("n_chars", "long"))


def op4_html_extraction(spark, sf_dir):
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
