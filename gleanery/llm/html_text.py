"""Main text of web pages, without the subtrees that recur on many pages of one host.

A first pass over the pages hashes their element subtrees; Spark counts them per host. The second pass deletes the
subtrees counted on many pages, with the elements that are chrome by tag or label, and joins the blocks that are left.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.texts import blocks
from gleanery.llm.url_filters import host_of
from gleanery.sources.shared import materialize

ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"""=\s*(["'])|>""")
#: Words of a class or id that name chrome, and those that may stand beside them in one name: ``cookie-box`` is chrome,
#: ``related-work`` is not.
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "adsbygoogle", "banner", "promo", "promotion", "sponsor", "sponsored",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "sidebar", "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "comment",
    "comments", "disqus", "replies", "reply", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "toolbar", "widget", "widgets",
    "skip", "skiplink",
}
BESIDE = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "desktop", "form", "global", "google", "group", "icons",
    "inner", "item", "items", "left", "link", "links", "list", "main", "media", "mobile", "module", "outer", "page", "panel", "posts", "primary", "reader",
    "right", "row", "secondary", "section", "site", "slot", "stories", "sub", "thread", "top", "unit", "user", "wrap", "wrapper", "js", "text",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CHROME = {
    "head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "input",
    "iframe", "object", "embed", "svg", "canvas", "dialog", "menu", "title", "xmp", "noembed", "noframes", "audio", "video",
}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
} | CHROME
#: Elements of running text. Inside an article they stay even where they recur: syndicated text is no template.
PROSE = {"article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "ul", "ol", "dl", "dt", "dd", "figure", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag closes when it is open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: White space as HTML has it; a no-break space is a character like others.
SPACE = re.compile(r"[ \t\n\r\f\v]{2,}|[\t\n\r\f\v]")


class Node:
    """``chrome``: by tag, role or state; ``label``: by a word of its class or id alone. ``prose``: inside an article."""

    __slots__ = ("tag", "chrome", "label", "parts", "prose", "key")

    def __init__(self, tag: str, chrome: bool, label: bool, prose: bool) -> None:
        self.tag, self.chrome, self.label, self.prose, self.parts, self.key = tag, chrome, label, prose, [], 0


class Scanner:
    """Markup of a page from left to right, in time linear in the page."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        #: Quotes that open a value from which no end of a tag is reached.
        self.bad: set[int] = set()

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: at the first ``>`` outside quoted values or, if the quotes never close,
        at the first ``>`` of all; -1 if there is none."""
        opened, i = [], at
        while i <= self.last[">"]:
            m = STOP.search(self.page, i)
            if m is None:
                break
            if m[1] is None:
                return m.start()
            q = m.end() - 1
            if q in self.bad or q >= self.last[m[1]]:
                break
            opened.append(q)
            i = self.page.find(m[1], q + 1) + 1
        self.bad.update(opened)
        return self.page.find(">", at) if at <= self.last[">"] else -1

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """Start and end of the next piece of markup, with ``/`` if it ends an element, the tag's name and its attributes. A
        comment or declaration has no name; without further markup all is text."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if page.startswith("<!--", i):
                end = page.find("-->", i + 2)
                return i, len(page) if end < 0 else end + 3, "", "", ""
            slash = "/" if page.startswith("/", i + 1) else ""
            m = NAME.match(page, i + 1 + len(slash))
            if m:
                end = self.tag_end(m.end())
                return i, len(page) if end < 0 else end + 1, slash, m[0].lower(), page[m.end() : max(end, m.end())]
            if slash or page[i + 1 : i + 2] in ("!", "?"):
                end = page.find(">", i) if i <= self.last[">"] else -1
                return i, len(page) if end < 0 else end + 1, "", "", ""
            at = i + 1
        return len(page), len(page), "", "", ""


@lru_cache(8192)
def _labelled(names: str) -> bool:
    """Whether a class or id names chrome: every part of one of the names does, or may stand beside such a part."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_]+|\d+", name) if p]
        if any(p in CHROME_WORDS for p in parts) and all(p in CHROME_WORDS or p in BESIDE for p in parts):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of block elements; inline tags vanish, their text stays with the block around them. ``parts`` are texts and nodes."""
    root = Node("#", False, False, False)
    scan, stack, open_, at, plain = Scanner(page), [root], Counter(), 0, 0

    def leave(i: int) -> None:
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]

    while at < len(page):
        start, at, slash, tag, source = scan.next(at)
        if start > plain:
            stack[-1].parts.append(page[plain:start])
        plain = at
        if not tag:
            continue
        if slash:
            tag = tag if tag in BLOCKS else "#" + tag
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    leave(i)
                    break
                if tag[0] == "#" and stack[i].tag[0] != "#":  # an inline end tag ends no block
                    break
            continue
        if tag == "br":
            stack[-1].parts.append(" ")
            continue
        if tag in RAW:  # text that holds no markup
            m = RAW_ENDS[tag].search(page, at)
            at = page.find(">", m.end()) + 1 if m else 0
            at = plain = at or len(page)
            continue
        if tag in VOID and tag != "hr":
            continue
        known = _attributes(source) if source.strip(" /") else {}
        names = f"{known.get('class', '')} {known.get('id', '')}"
        chrome = tag in CHROME or "hidden" in known or known.get("role", "").lower() in ROLES
        label = tag not in HEADINGS and names != " " and _labelled(names)
        if tag in ("article", "main"):
            chrome, label = label and bool(re.search("comment|repl", names.lower())), False
        if tag in ("body", "html"):
            chrome = label = False
        if tag == "header" and stack[-1].prose and chrome and not known.keys() & {"hidden", "role"}:
            chrome, label = False, True  # an article's own header: chrome unless it holds the heading
        if tag not in BLOCKS:
            if not chrome and not label:
                continue
            tag = "#" + tag  # an inline advert or menu: its text goes with it
        closes = CLOSES.get(tag, {"p"}) if tag in BLOCKS else set()
        if stack[-1].tag in closes or stack[-1].tag == "p" and tag in BLOCKS:
            leave(len(stack) - 1)
        if len(stack) > 1 and stack[-1].tag in CLOSES.get(tag, ()):
            leave(len(stack) - 1)
        node = Node(tag, chrome, label, stack[-1].prose or tag == "article")
        stack[-1].parts.append(node)
        if tag not in VOID and not source.endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return _settle(root)


def _settle(root: Node) -> Node:
    """Labels make chrome, but not of what holds the first heading of an article, nor of what holds every article (or else
    every main) of the page. A header inside an article is kept for any heading in it."""
    nodes = _nodes(root)
    free, open_ = {"article": False, "main": False}, {id(root)}
    for node in nodes:
        if id(node) in open_ and not node.chrome and not node.label:
            open_.update(id(p) for p in node.parts if isinstance(p, Node))
            if node.tag in free:
                free[node.tag] = True
    some = {n.tag for n in nodes if n.tag in free and not n.chrome}
    lost = next((t for t in ("article", "main") if t in some), None)
    lost = None if lost and free[lost] else lost
    holds: set[int] = set()
    headed: set[int] = set()
    for node in reversed(nodes):  # children before parents
        if node.tag in HEADINGS or any(isinstance(p, Node) and not p.chrome and id(p) in headed for p in node.parts):
            headed.add(id(node))
        below = any(isinstance(p, Node) and not p.chrome and id(p) in holds for p in node.parts)
        if below or lost and node.tag == lost or node.tag == "h1" and node.prose:
            holds.add(id(node))
        node.chrome = node.chrome or node.label and not below and not (node.tag == "header" and id(node) in headed)
        if node.tag == "article":  # a heading speaks for what is inside its article
            holds.discard(id(node)) if lost != "article" else None
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    order, stack = [], [root]
    while stack:
        order.append(node := stack.pop())
        stack.extend(p for p in node.parts if isinstance(p, Node))
    return order


def _attributes(source: str) -> dict[str, str]:
    return {a.lower(): html.unescape(v.strip("\"'")) for a, v in ATTRIBUTE.findall(source)}


def clean(text: str) -> str:
    return SPACE.sub(" ", html.unescape(text)).strip(" ")


def hash_subtrees(root: Node, found: dict[int, None]) -> int:
    """Sets each node's key, from its tag, texts and children, and collects the keys of those that may be template."""
    order, stack = [], [root]  # chrome goes anyhow, with all below it: only its tag counts
    while stack:
        order.append(node := stack.pop())
        stack.extend(p for p in node.parts if isinstance(p, Node) and not node.chrome)
    for node in reversed(order):  # children before parents
        h = blake2b(node.tag.encode(), digest_size=8)
        for p in () if node.chrome else node.parts:
            h.update(b"\0" + (p.key.to_bytes(8, "big", signed=True) if isinstance(p, Node) else clean(p).encode()))
        node.key = int.from_bytes(h.digest(), "big", signed=True)
        if node.parts and node.tag not in ("#", "html", "body") and not node.chrome and not (node.prose and node.tag in PROSE):
            found[node.key] = None
    return root.key


def main_nodes(root: Node) -> list[Node]:
    """The outermost articles, or else the outermost mains, or else the whole tree."""

    def outermost(tag: str) -> list[Node]:
        out, stack = [], root.parts[::-1]
        while stack:
            p = stack.pop()
            if isinstance(p, Node) and not p.chrome:
                if p.tag == tag:
                    out.append(p)
                else:
                    stack.extend(reversed(p.parts))
        return out

    return outermost("article") or outermost("main") or [root]


def extract(page: str | None, templates: set[int] | frozenset = frozenset()) -> str:
    """Main text: blocks in page order, joined by two newlines; chrome and the given subtrees left out."""
    root = parse(page or "")
    if templates:
        hash_subtrees(root, {})
    out: list[str] = []

    def walk(node: Node) -> None:
        open_: list[tuple[Iterator, list[str]]] = [(iter([*node.parts, None]), [])]
        while open_:
            parts, held = open_[-1]
            for p in parts:
                if isinstance(p, str):
                    held.append(p)
                    continue
                if p is not None and p.tag[0] == "#":  # inline and removed: no end of a block
                    continue
                if block := clean("".join(held)):
                    out.append(block)
                held.clear()
                if p is not None and not p.chrome and p.key not in templates:
                    open_.append((iter([*p.parts, None]), []))
                    break
            else:
                open_.pop()

    for n in main_nodes(root):
        walk(n)
    return "\n\n".join(out)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, 8 << 20, "html"):
        counts: dict[tuple, int] = {}
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            found: dict[int, None] = {}
            hash_subtrees(parse(page or ""), found)
            for k in found:
                counts[host, k] = counts.get((host, k), 0) + 1
        rows = [(h, k, n) for (h, k), n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            ["host", "subtree", "pages"],
        )


#: Columns of the work in between.
HOST, PAGE, KEYS = "_gleanery_host", "_gleanery_page", "_gleanery_keys"
#: So many template rows at most are sent to the tasks whole; more are joined to the pages by host.
BROADCAST_TEMPLATES = 200_000


def site_templates(pages: DataFrame, least_pages: int = 10) -> DataFrame:
    """``(host, subtree)``: subtrees on at least ``least_pages`` pages of a host and on the square root of their number. The
    root grows slower than the host, but keeps a host's templates few beside its pages."""
    at = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    counts = at.mapInArrow(_subtrees, "host string, subtree long, pages long")
    counts = counts.groupBy("host", "subtree").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= least_pages)
    hosts = at.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    return counts.join(hosts, "host").where(F.col("pages") * F.col("pages") >= F.col("of")).select("host", "subtree")


def extract_main_text(pages: DataFrame, least_pages: int = 10) -> DataFrame:
    """``pages`` with ``text``, one row per row; null and empty pages have empty text; all other columns stay, but one named
    like ``text``, which the result replaces.

    Inside an article element running text stays even where it recurs; elsewhere any recurring subtree goes.
    Pages with a null url share the empty host. Repeated rows count as pages each.
    """
    pages = pages.drop(*(c for c in pages.columns if c.lower() == "text"))
    names = pages.columns
    found = materialize(site_templates(pages, least_pages), "templates")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    at = pages.withColumns({HOST: host_of(F.col("url")), PAGE: F.col("html").cast("string")})
    if found.count() <= BROADCAST_TEMPLATES:
        known: dict[str, set[int]] = {}
        for host, key in found.collect():
            known.setdefault(host, set()).add(key)
        shared = pages.sparkSession.sparkContext.broadcast(known)
        look = lambda b: [shared.value.get(h, frozenset()) for h in b.column(HOST).to_pylist()]
    else:
        lists = found.groupBy(F.col("host").alias(HOST)).agg(F.collect_list("subtree").alias(KEYS))
        at = at.join(lists, HOST, "left")
        look = lambda b: [frozenset(k or ()) for k in b.column(KEYS).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 8 << 20, PAGE):
            texts = [extract(p, t) for p, t in zip(b.column(PAGE).to_pylist(), look(b))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return at.mapInArrow(run, f"{kind}, text string")
