"""HTM7: a page's structure as lines, from its tags in page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.texts import MOST_CHARS, MOST_LINES, clipped
from gleanery.functions.urls import link_host

# Kinds of fields, link attributes and the schemes that lead nowhere.
FIELDS = ("input", "select", "textarea")
LINKS = ("href", "src", "action")
NOWHERE = ("#", "javascript:", "data:", "mailto:", "tel:")
HOSTS = 10

MARK = r"<(/?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
ATTRIBUTE = r"[^\s=>/\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
# Character references that attribute values are decoded from; the ampersand comes last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def marks(pages: DataFrame) -> DataFrame:
    """``(page_id, url, pos, tag, attributes)``: tags in page order, closing ones with a slash. Comments and what scripts and styles hold
    are not markup."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3"), r"(?s)<!--.*?-->", " ")
    found = F.posexplode(F.regexp_extract_all(bare, F.lit(MARK), F.lit(1)))
    rows = pages.select("page_id", "url", found.alias("pos", "mark"))
    tag = F.lower(F.regexp_extract("mark", r"^(/?[^\s/>]+)", 1))
    pairs = F.regexp_extract_all(F.regexp_replace("mark", r"^/?[^\s/>]+", ""), F.lit(f"({ATTRIBUTE})"), F.lit(1))
    named = F.transform(
        pairs,
        lambda p: F.struct(
            F.lower(F.regexp_extract(p, r"^([^\s=]+)", 1)).alias("name"),
            decoded(F.regexp_replace(F.regexp_extract(p, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1), r"(?s)^([\"'])(.*)\1$", "$2")).alias("value"),
        ),
    )
    return rows.select("page_id", "url", "pos", tag.alias("tag"), named.alias("attributes"))


def value(name: str) -> Column:
    """The last value of an attribute; empty without a value, null without the attribute."""
    return F.try_element_at(F.filter("attributes", lambda a: a["name"] == name), F.lit(-1))["value"]


def _quoted(text: Column) -> Column:
    """In quotes, as a literal shows a string: double ones where it has single ones only."""
    double = text.contains("'") & ~text.contains('"')
    slashed = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(double, F.concat(F.lit('"'), slashed, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(slashed, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _truth(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def structure_lines(pages: DataFrame, most: int = MOST_LINES, chars: int = MOST_CHARS) -> DataFrame:
    """``(page_id, no, line)``: title, forms with their fields, frames, refreshes and scripts in page order, then the number of password
    inputs and the ten foreign hosts most often referred to (first seen first among equals). A field belongs to the form that is
    open where it stands, which a window carries along the page's tags; a form's number counts the form lines before it.
    Null pages have the two last lines only; at most ``most`` lines, each of ``chars`` at most."""
    page = Window.partitionBy("page_id").orderBy("pos")
    m = marks(pages.where("html is not null"))
    edge = F.when(F.col("tag") == "form", True).when(F.col("tag") == "/form", False)
    inside = F.coalesce(F.last(edge, ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    m = m.withColumn("field", F.col("tag").isin(*FIELDS) & inside)
    lines_before = F.sum((F.col("field") | (F.col("tag") == "form")).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("before", F.coalesce(lines_before, F.lit(0)))
    form = F.last(F.when(F.col("tag") == "form", F.col("before")), ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("form", form)

    own = link_host(F.lit(""), F.col("url"))
    get = lambda name: F.coalesce(value(name), F.lit(""))
    action_host = F.when(get("action") == "", own).otherwise(link_host(get("action"), F.col("url")))
    style = F.lower(F.replace(get("style"), F.lit(" "), F.lit("")))
    hidden = style.contains("display:none") | get("width").isin("0", "1") | value("hidden").isNotNull()
    head = F.concat(F.lit("form "), F.col("form"))
    line = (
        F.when(
            F.col("tag") == "form",
            F.concat(head, F.lit(": method="), F.coalesce(value("method"), F.lit("get")), F.lit(" action="), _quoted(F.substring(get("action"), 1, 120)), F.lit(" action_host="), action_host, F.lit(" cross_origin="), _truth(action_host != own)),
        )
        .when(F.col("field"), F.concat(head, F.lit(" field: <"), F.col("tag"), F.lit(" type="), get("type"), F.lit(" name="), get("name"), F.lit(" placeholder="), get("placeholder"), F.lit(">")))
        .when(F.col("tag") == "iframe", F.concat(F.lit("iframe src="), _quoted(F.substring(get("src"), 1, 120)), F.lit(" hidden="), _truth(hidden)))
        .when((F.col("tag") == "meta") & (F.lower(get("http-equiv")) == "refresh"), F.concat(F.lit("meta refresh content="), _quoted(F.substring(get("content"), 1, 120))))
        .when((F.col("tag") == "script") & (get("src") != ""), F.concat(F.lit("script src="), F.substring(get("src"), 1, 150)))
    )
    body = m.select("page_id", F.col("pos").cast("long").alias("pos"), line.alias("line")).where("line is not null")

    targets = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.trim(get(n)).alias("to")) for i, n in enumerate(LINKS))), lambda t: (t["to"] != "") & ~_leads_nowhere(t["to"]))
    refers = m.select("page_id", "url", "pos", F.explode(targets).alias("t")).withColumn("host", link_host(F.col("t.to"), F.col("url")))
    refers = refers.where((F.col("host") != "") & (F.col("host") != own))
    counted = refers.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "t.i")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("n").desc(), "at"))
    top = counted.withColumn("r", rank).where(F.col("r") <= HOSTS).groupBy("page_id")
    top = top.agg(F.array_sort(F.collect_list(F.struct("r", "host", "n"))).alias("top"))
    named = F.array_join(F.transform("top", lambda x: F.concat(x["host"], F.lit("("), x["n"], F.lit(")"))), ", ")

    titles = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<title\b[^>]*>(.*?)</title\s*>"), F.lit(1)), "")
    title = F.trim(F.regexp_replace(decoded(titles), r"^\s+|\s+$", ""))
    passwords = F.coalesce(F.regexp_count("html", F.lit(r"(?i)type\s*=\s*[\"']?password")), F.lit(0))
    rest = pages.join(top, "page_id", "left").select(
        "page_id",
        F.explode(
            F.array(
                F.struct(F.lit(-1).cast("long").alias("pos"), F.when(title != "", F.concat(F.lit("title: "), title)).alias("line")),
                F.struct(F.lit(2**40).alias("pos"), F.concat(F.lit("password inputs: "), passwords).alias("line")),
                F.struct(F.lit(2**40 + 1).alias("pos"), F.concat(F.lit("external hosts referenced: "), F.coalesce(named, F.lit("none"))).alias("line")),
            )
        ).alias("x"),
    )
    rows = body.unionByName(rest.select("page_id", "x.pos", "x.line").where("line is not null"))
    no = F.row_number().over(page)
    return rows.withColumn("no", no).where(F.col("no") <= most).select("page_id", "no", clipped(F.col("line"), chars).alias("line"))


def _leads_nowhere(link: Column) -> Column:
    out = F.lit(False)
    for start in NOWHERE:
        out = out | link.startswith(start)
    return out
