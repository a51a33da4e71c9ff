"""URL filters: longest-rule verdicts, and block decisions that spread over redirect and canonical-link classes.

DataFrame functions only. Rules meet urls by equi-joins on host suffixes; aliases are the connected components over
redirect and canonical-link edges.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.graph import connected_components
from gleanery.sources.shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule table of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 100_000
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """``(rule, action)`` rows from pairs like ``("com/en/", "block")``."""
    items = [F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action")) for r, a in rules]
    if not items:
        return spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("action"))
    return spark.range(1).select(F.explode(F.array(*items)).alias("r")).select("r.*")


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """The identity of a url in the alias graph: host, path and query, without scheme and fragment. Null without host."""
    host = host_of(url)
    query = F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path_of(url) == "", "/").otherwise(path_of(url)), F.coalesce(query, F.lit(""))))


def _plain_path(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments, which take the one before them along; none lead above the root."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.array_append(kept, part))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    plain = F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), plain).otherwise(path)


def resolve(href: Column, base: Column) -> Column:
    """An absolute url for a link on page ``base``, without its fragment; null for schemes that name no host, as ``mailto:``. An empty link, or
    a fragment alone, is the page itself."""
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    path = path_of(base)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    bare = F.regexp_replace(href, "#.*$", "")
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    asked = F.regexp_replace(bare, r"\?.*$", "")
    return (
        F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), bare)
        .when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare))
        .when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(bare == "", F.regexp_replace(base, "#.*$", ""))
        .when(asked == "", F.concat(site, path, query))
        .when(asked.startswith("/"), F.concat(site, _plain_path(asked), query))
        .otherwise(F.concat(site, _plain_path(F.concat(F.when(folder == "", "/").otherwise(folder), asked)), query))
    )


def canonical_edges(pages: DataFrame) -> DataFrame:
    """``(source_url, target_url)`` from canonical links and meta refreshes of the pages' own html."""
    html = F.coalesce(F.col("html"), F.lit(""))
    link = F.regexp_extract(F.regexp_extract(html, LINK, 0), r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)", 1)
    jump = F.regexp_extract(F.regexp_extract(html, REFRESH, 0), r"(?i)url\s*=\s*[\"']?([^\"'\s>]*)", 1)
    to = F.explode(F.filter(F.array(link, jump), lambda x: x != "")).alias("href")
    with_link = html.contains("canonical") | F.lower(html).contains("refresh") | F.lower(html).contains("canonical")
    found = pages.where(with_link).select("url", to).distinct()
    return found.select(F.col("url").alias("source_url"), resolve(F.trim("href"), F.col("url")).alias("target_url"))


def rule_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, action)`` for each distinct host and path to which a rule applies; the longest rule wins, then the first
    by name. A rule ``host/path`` fits that host and its subdomains if the url's path starts with ``/path``."""
    slash = F.locate("/", F.col("rule"))
    r = rules.where("rule is not null and action is not null").select(
        "rule",
        "action",
        F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("suffix"),
        F.when(slash > 0, F.expr("substring(rule, locate('/', rule))")).otherwise("").alias("prefix"),
    ).distinct()
    if r.count() <= BROADCAST_RULES:
        r = F.broadcast(r)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    fits = keyed.join(r, "suffix").where(F.expr("startswith(path, prefix)"))
    best = F.min_by(F.struct("rule", "action"), F.struct(-F.length("rule"), F.col("rule"), F.col("action")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)``, one row per row of ``pages``.

    A rule of the page's own decides first. Else, if any url of the page's alias class is allowed by a rule, the page is
    allowed; else, if any is blocked, it is blocked; else allowed. Classes are components over ``redirects``
    (``source_url``, ``target_url``) and the pages' canonical links and refreshes; urls that are no page count too. A
    null url, or one without ``://``, has an empty host and path, no rule and no aliases, and is allowed. Repeated
    rows get repeated results; an empty table gives none; other columns are ignored.
    """
    edges = canonical_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source_url", "target_url"))
    edges = edges.select(F.col("source_url").alias("a"), F.col("target_url").alias("b"))
    edges = edges.select(url_key(F.col("a")).alias("a"), url_key(F.col("b")).alias("b")).where("a is not null and b is not null")
    edges = materialize(edges, "links")  # few and short; keeps the key expressions out of the graph's plans
    classes = connected_components(edges, "a", "b")
    at = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = rule_verdicts(at.where("host <> ''"), rules)
    members = classes.select("node", "component", F.concat(F.lit("://"), F.col("node")).alias("u"))
    members = members.select("node", "component", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    judged = members.join(rule_verdicts(members, rules), ["host", "path"])
    spread = judged.groupBy("component").agg(F.bool_or(F.col("action") == "allow").alias("allowed"))
    spread = spread.select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("spread"))
    alias = members.join(spread, "component").select("node", "spread")
    out = at.join(own, ["host", "path"], "left").withColumn("node", url_key(F.col("url"))).join(alias, "node", "left")
    verdict = F.coalesce("action", "spread", F.lit("allow"))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))
