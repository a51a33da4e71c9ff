"""HTML functions on columns, by regular expressions in the JVM: the same keys for the same page, not a browser's tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>"
HIDDEN_PARTS = ("script", "style", "noscript", "template")
TAG = r"<[a-zA-Z/!?][^>]*>"
TAG_NAME = r"<\s*([a-zA-Z][a-zA-Z0-9]*)"
PROMINENT = ("title", "h1", "h2", "h3", "button", "form")
#: Attributes whose values a reader sees.
SEEN = ("alt", "placeholder")
#: Character references that text is decoded from, in this order.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
# Tags that a shortened page keeps inside its root.
KEPT_TAGS = (
    "head", "title", "meta", "body", "h1", "h2", "h3", "h4", "h5", "h6", "p", "strong", "a", "img",
    "hr", "table", "tbody", "tr", "th", "td", "ol", "ul", "li", "ruby", "label",
)


def short_hash(x: Column, digits: int = 20) -> Column:
    return F.substring(F.sha2(x, 256), 1, digits)


def without(html: Column, *tags: str) -> Column:
    for t in tags:
        html = F.regexp_replace(html, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ")
    return html


def visible_text(html: Column) -> Column:
    """HTM1: text outside script, style, noscript and template, tags as spaces, common character references decoded, spaces folded."""
    bare = F.regexp_replace(F.regexp_replace(without(html, *HIDDEN_PARTS), r"(?s)<!--.*?-->", " "), TAG, " ")
    for name, char in ENTITIES:
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def text_key(html: Column) -> Column:
    """HTM2: 20 hex digits of the lower-case text with runs of digits as 0; null under 200 characters."""
    t = F.regexp_replace(F.lower(visible_text(html)), "[0-9]+", "0")
    return F.when(F.length(t) >= 200, short_hash(t))


def skeleton_key(html: Column, most: int = 400, least: int = 30) -> Column:
    """HTM3: hash of the first tag names and of each form's sorted input types; null for fewer than ``least`` tags."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(TAG_NAME), F.lit(1)), F.lower)
    kinds = F.transform(forms(html), lambda f: F.array_join(F.array_sort(input_types(f)), ","))
    return F.when(F.size(tags) >= least, short_hash(F.concat(F.array_join(F.slice(tags, 1, most), " "), F.lit("|"), F.array_join(kinds, ";"))))


def forms(html: Column) -> Column:
    """The forms of a page, each from its start tag to its end tag or the page's end."""
    return F.regexp_extract_all(without(html, "script", "style"), F.lit(r"(?is)<form\b[^>]*>.*?(?:</form\s*>|\z)"), F.lit(0))


def input_types(form: Column) -> Column:
    """The types of the inputs of a form in order; text where none is given."""
    tags = F.regexp_extract_all(form, F.lit(r"(?is)<input\b([^>]*)>"), F.lit(1))
    return F.transform(tags, lambda a: F.coalesce(F.nullif(F.lower(attribute(a, "type")), F.lit("")), F.lit("text")))


def clean_html(html: Column) -> Column:
    """HTM5: without style, noscript, script and stylesheet links."""
    return F.regexp_replace(without(html, "style", "noscript", "script"), r"(?i)<link\b[^>]*stylesheet[^>]*>", "")


def truncate_html(html: Column, limit: int, notice: str = "[cut]") -> Column:
    """HTM6: at the last tag end within ``limit`` characters, with a notice."""
    head = F.substring(html, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), ">") + 1
    cut = F.when(F.instr(head, ">") > 0, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(html) > limit, F.concat(cut, F.lit(notice))).otherwise(html)


def title(html: Column) -> Column:
    """HTM13."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def chunk_text(text: Column, width: int) -> Column:
    """HTM12: pieces of fixed width."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / width)).cast("int"))
    return F.transform(starts, lambda i: F.substring(text, i * width + 1, F.lit(width)))


def chunk_html(html: Column, width: int) -> Column:
    """HTM12: pieces cut at tag ends, each as long as fits in ``width`` or, where no tag ends in time, up to the next tag end."""
    return F.regexp_extract_all(html, F.lit(rf"(?s).{{1,{width}}}(?<=>)|.+?(?:>|\z)"), F.lit(0))


def simplify_html(html: Column, tokens: int, short: int = 100) -> Column:
    """HTM11: a page within a budget of tokens (four characters each): without scripts, styles and comments and, if that is
    too long, with structural tags only, long links and sources clipped, empty elements gone, and the middle pieces left
    out: whole tags and texts from both ends while they fit."""
    bare = F.regexp_replace(without(html, "style", "script"), r"(?s)<!--.*?-->", "")
    lean = F.regexp_replace(bare, rf"(?is)</?(?!/?(?:html|{"|".join(KEPT_TAGS)})\b)[a-zA-Z][^>]*>", "")
    lean = F.regexp_replace(lean, rf"(?is)\b(href|src)\s*=\s*([\"'])([^\"']{{1,{short}}})[^\"']*\2", "$1=$2$3$2")
    lean = F.regexp_replace(lean, r"(?is)<(h[1-6]|p|strong|a|table|tbody|tr|th|td|ol|ul|li|ruby|label)\b[^>]*>\s*</\1\s*>", "")
    parts = F.regexp_extract_all(lean, F.lit(r"(?s)<[^>]*>|[^<]+|<"), F.lit(0))
    half = tokens * 2
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def fill(pieces: Column, back: bool) -> Column:
        def add(s: Column, p: Column) -> Column:
            fits = s["open"] & (F.length(s["text"]) + F.length(p) <= half)
            return F.struct(F.when(fits, F.concat(p, s["text"]) if back else F.concat(s["text"], p)).otherwise(s["text"]).alias("text"), fits.alias("open"))

        return F.aggregate(pieces, start, add)["text"]

    cut = F.concat(fill(parts, False), fill(F.reverse(parts), True))
    fits = lambda x: F.ceil(F.length(x) / 4) <= tokens
    return F.when(fits(bare), bare).when(fits(lean), lean).otherwise(cut)


def references(pages: DataFrame) -> DataFrame:
    """HTM10: ``(page_id, kind, target)``: actions of forms, sources of iframes outside noscript, and targets of refreshes."""
    bare = without(F.col("html"), "script", "style")
    parts = []
    for kind, tag, name in (("form", "form", "action"), ("iframe", "iframe", "src")):
        tags = F.regexp_extract_all(without(bare, "noscript") if tag == "iframe" else bare, F.lit(rf"(?is)<{tag}\b([^>]*)>"), F.lit(1))
        parts.append(F.transform(F.filter(F.transform(tags, _named(name)), lambda t: t != ""), _of_kind(kind)))
    metas = F.filter(F.regexp_extract_all(bare, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1)), lambda a: F.lower(attribute(a, "http-equiv")) == "refresh")
    urls = F.transform(metas, lambda a: F.trim(F.regexp_extract(a, r"(?i)url\s*=\s*['\"]?([^'\";>]+)", 1)))
    parts.append(F.transform(F.filter(urls, lambda t: t != ""), _of_kind("meta_refresh")))
    rows = pages.select("page_id", F.explode(F.flatten(F.array(*parts))).alias("x"))
    return rows.select("page_id", "x.kind", "x.target")


def _named(name: str):
    return lambda a: F.trim(attribute(a, name))


def _of_kind(kind: str):
    return lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target"))


def page_elements(pages: DataFrame) -> DataFrame:
    """HTM7: long table of tags in page order: ``(page_id, pos, tag, attributes)``."""
    tags = F.posexplode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*[^>]*)>"), F.lit(1)))
    rows = pages.select("page_id", tags.alias("pos", "tag_text"))
    tag = F.lower(F.regexp_extract("tag_text", r"^([a-zA-Z][a-zA-Z0-9]*)", 1))
    return rows.select("page_id", "pos", tag.alias("tag"), F.regexp_extract("tag_text", r"^[a-zA-Z0-9]+\s*(.*)$", 1).alias("attributes"))


def attribute(attributes: Column, name: str) -> Column:
    return F.regexp_extract(attributes, rf"(?i)\b{name}\s*=\s*[\"']?([^\"'>]*)", 1)


def prominent_text(pages: DataFrame) -> DataFrame:
    """HTM9: texts of title, headings, buttons and forms, and values of attributes that are read: ``(page_id, place, text)``."""
    parts = [
        F.transform(
            F.regexp_extract_all("html", F.lit(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>"), F.lit(1)),
            _placed(t),
        )
        for t in PROMINENT
    ]
    for name in SEEN:
        found = F.regexp_extract_all("html", F.lit(rf"(?is)<[a-z][^>]*?\b{name}\s*=\s*[\"']([^\"'>]*)[\"']"), F.lit(1))
        parts.append(F.transform(found, _placed(name)))
    rows = pages.select("page_id", F.explode(F.flatten(F.array(*parts))).alias("x"))
    text = F.trim(F.regexp_replace(F.regexp_replace("x.text", TAG, " "), r"\s+", " "))
    return rows.select("page_id", "x.place", text.alias("text")).where("text <> ''")


def _placed(tag: str):
    return lambda x: F.struct(F.lit(tag).alias("place"), x.alias("text"))


def offline(text: Column, sentences: Sequence[str]) -> Column:
    """FIL8: a browser's own page: an error code and one of its sentences."""
    said = F.lit(False)
    for s in sentences:
        said = said | text.contains(s)
    return text.rlike(r"\bERR_[A-Z_]{4,}\b") & said
