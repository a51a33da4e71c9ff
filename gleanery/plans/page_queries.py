"""Queries on page structure: forms, references, prominent text, brands, triggers, shortening, certificates, nearest pages.

The shared pages have no forms, frames or foreign links; ``WEB`` derives pages that do, by the page's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import pages as P
from gleanery.functions import numbers, structure, texts, urls
from gleanery.operators import brands, similarity, triggers
from gleanery.operators import evidence as E
from gleanery.operators.certificates import counts as certificate_counts
from gleanery.plans.corpus_queries import HOST, _suffixes
from gleanery.plans.evidence_queries import SUPPORT
from gleanery.plans.registry import query, rounded
from gleanery.plans.rule_queries import CERTS_SQL, certificates, observed_hosts
from gleanery.plans.tables import FINDINGS_SQL, findings
from gleanery.sources.shared import materialize
from gleanery.sources.tables import read_table

#: What is put before the html of every n-th page: (n, rest, markup).
MARKUP = (
    (3, 0, '<form action="https://login.bets.com/a"><input type="Text"><input type=password><input value=go type="submit"></form>'),
    (3, 1, "<form action=\"/go\"><input name='q'></form>"),
    (4, 0, '<noscript><iframe src="https://noscript.example.io/x"></iframe></noscript>'),
    (4, 1, '<iframe src="//frames.example.net/f"></iframe><script>var f = \'<iframe src="https://script.example.io/">\';</script>'),
    (5, 0, "<META content=\"0; URL='https://refresh.example.com/p'\" http-equiv=\"Refresh\">"),
    (6, 0, '<a href="https://out.example.com/">Out &amp; away</a><a href="mailto:x@y.z">m</a><a href="#">t</a><A HREF="javascript:go()">j</A>'),
    (4, 2, '<a href="//zeta.example.org/1">z</a><a href="https://alpha.example.org/">a</a><img src="//zeta.example.org/i.png"><iframe hidden src="/f"></iframe>'),
    (8, 3, '<h2>Sign in to AT&amp;T</h2><button>ING <b>Bank</b></button><img alt="at&amp;t and the box, Your PIN"><form>Out &amp; away</form><a href="https://www.att.com/help">help</a><a href="https://sub.ing.com/">i</a>'),
    (7, 0, '<button>Casino &lt;login&gt;</button><img alt="Bets logo" src="/i.png"><input placeholder="Your PIN" type="password">'),
)


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    added = [F.when(F.col("page_id") % n == rest, F.lit(markup)).otherwise("") for n, rest, markup in MARKUP]
    return p.withColumn("html", F.concat(*added, "html"))


def _sql(text: str) -> str:
    return text.replace("'", "''")


WEB = "w AS (SELECT page_id, url, " + " || ".join(f"CASE WHEN page_id % {n} = {r} THEN '{_sql(m)}' ELSE '' END" for n, r, m in MARKUP) + " || html AS html FROM pages)"
BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g')"
SHOWN = rf"regexp_replace({BARE}, '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g')"
FORMS = rf"regexp_extract_all({BARE}, '(?is)<form\b[^>]*>.*?</form>')"


def site(host: str) -> str:
    """SQL: the last two labels, which is the registrable name under the suffixes here."""
    return f"array_to_string(list_slice(string_split({host}, '.'), -2, -1), '.')"


def text_of(html: str) -> str:
    """SQL: visible text."""
    out = html
    for t in ("script", "style", "noscript", "template"):
        out = rf"regexp_replace({out}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[a-zA-Z/!?][^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return rf"trim(regexp_replace({out}, '[ \t\n\r\f]+', ' ', 'g'))"


@query(
    rf"""WITH {WEB}, t AS (SELECT page_id, list_transform(regexp_extract_all(html, '<\s*([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)) AS tags,
 list_transform({FORMS}, lambda f: array_to_string(list_sort(list_transform(regexp_extract_all(f, '(?is)<input\b[^>]*>'),
 lambda i: CASE WHEN regexp_matches(i, '(?i)\btype\s*=') THEN lower(regexp_extract(i, '(?i)\btype\s*=\s*["'']?(\w+)', 1)) ELSE 'text' END)), ',')) AS forms FROM w)
 SELECT page_id, array_to_string(forms, ';') AS forms, CASE WHEN len(tags) >= 30 THEN substr(sha256(array_to_string(tags[:400], ' ') || '|' || array_to_string(forms, ';')), 1, 20) END AS key FROM t"""
)
def htm3_form_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their tags and forms: the sorted input types of each form are part of the key."""
    h = F.col("html")
    kinds = F.transform(P.forms(h), lambda f: F.array_join(F.array_sort(P.input_types(f)), ","))
    return web_pages(spark, sf_dir).select("page_id", F.array_join(kinds, ";").alias("forms"), P.skeleton_key(h).alias("key"))


@query(
    rf"""WITH {WEB}, r AS (SELECT page_id, 'form' AS kind, unnest(regexp_extract_all({BARE}, '(?is)<form\b[^>]*\baction\s*=\s*"([^"]*)"', 1)) AS target FROM w
 UNION ALL SELECT page_id, 'iframe', unnest(regexp_extract_all({SHOWN}, '(?is)<iframe\b[^>]*\bsrc\s*=\s*"([^"]*)"', 1)) FROM w
 UNION ALL SELECT page_id, 'meta_refresh', unnest(regexp_extract_all({BARE}, '(?is)<meta\b[^>]*url=''([^'']*)''[^>]*http-equiv="refresh"', 1)) FROM w)
 SELECT page_id, kind, target, len({text_of("html")}) AS text_chars FROM r JOIN w USING (page_id)"""
)
def htm10_cross_origin_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of forms, iframes and refreshes, with the length of the page's visible text."""
    w = web_pages(spark, sf_dir)
    size = w.select("page_id", F.length(P.visible_text(F.col("html"))).cast("long").alias("text_chars"))
    return P.references(w).join(size, "page_id")


def _value(name: str) -> str:
    """SQL: the last value of an attribute of a mark, decoded; null without it."""
    piece = rf"list_extract(list_filter(attrs, lambda p: lower(regexp_extract(p, '^([^\s=]+)', 1)) = '{name}'), -1)"
    out = rf"regexp_replace(regexp_replace(regexp_extract({piece}, '(?s)^[^\s=]+\s*=\s*(.*)$', 1), '(?s)^\"(.*)\"$', '\1'), '(?s)^''(.*)''$', '\1')"
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{ref}', '{char}')"
    return f"CASE WHEN {piece} IS NOT NULL THEN {out} END"


def _literal(text: str) -> str:
    """SQL: a string in quotes."""
    slashed = rf"replace({text}, '\', '\\')"
    return rf"""CASE WHEN contains({text}, '''') AND NOT contains({text}, '"') THEN '"' || {slashed} || '"' ELSE '''' || replace({slashed}, '''', '\''') || '''' END"""


def _link(link: str) -> str:
    """SQL: the host of a link on a page whose own is ``own``."""
    named = f"lower(regexp_extract({link}, '^[^/]*//(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    return f"CASE WHEN regexp_matches({link}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') OR starts_with({link}, '//') THEN {named} WHEN regexp_matches({link}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN '' ELSE own END"


READ = {"action": "action", "method": "method", "type": "type", "name": "name", "placeholder": "place", "src": "src", "href": "href", "style": "style", "width": "width", "hidden": "hid", "http-equiv": "equiv", "content": "content"}
HTM7_SQL = rf"""{WEB}, b AS (SELECT page_id, {HOST} AS own, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)(<script\b[^>]*>).*?(</script\s*>)', '\1\2', 'g'), '(?is)(<style\b[^>]*>).*?(</style\s*>)', '\1\2', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS bare FROM w),
 k AS (SELECT page_id, own, unnest(l) AS mark, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, own, regexp_extract_all(bare, '<(/?[a-zA-Z][^\s/>]*(?:"[^"]*"|''[^'']*''|[^''">])*)>', 1) AS l FROM b)),
 a AS (SELECT page_id, own, pos, lower(regexp_extract(mark, '^(/?[^\s/>]+)', 1)) AS tag, regexp_extract_all(regexp_replace(mark, '^/?[^\s/>]+', ''), '[^\s=>/"'']+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?') AS attrs FROM k),
 v AS (SELECT page_id, own, pos, tag, {", ".join(f"{_value(n)} AS {c}" for n, c in READ.items())} FROM a),
 o AS (SELECT *, coalesce((SELECT u.tag = 'form' FROM v u WHERE u.page_id = v.page_id AND u.pos <= v.pos AND u.tag IN ('form', '/form') ORDER BY u.pos DESC LIMIT 1), false) AND tag IN ('input', 'select', 'textarea') AS fld FROM v),
 n AS (SELECT *, count(*) FILTER (fld OR tag = 'form') OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
 f AS (SELECT *, (SELECT u.before FROM n u WHERE u.page_id = n.page_id AND u.pos <= n.pos AND u.tag = 'form' ORDER BY u.pos DESC LIMIT 1) AS form, CASE WHEN coalesce(action, '') = '' THEN own ELSE {_link("action")} END AS ah,
   left(coalesce(action, ''), 120) AS a120, left(coalesce(src, ''), 120) AS s120, left(coalesce(content, ''), 120) AS c120 FROM n),
 l AS (SELECT page_id, pos, CASE WHEN tag = 'form' THEN 'form ' || form || ': method=' || coalesce(method, 'get') || ' action=' || {_literal("a120")} || ' action_host=' || ah || ' cross_origin=' || CASE WHEN ah <> own THEN 'True' ELSE 'False' END
   WHEN fld THEN 'form ' || form || ' field: <' || tag || ' type=' || coalesce(type, '') || ' name=' || coalesce(name, '') || ' placeholder=' || coalesce(place, '') || '>'
   WHEN tag = 'iframe' THEN 'iframe src=' || {_literal("s120")} || ' hidden=' || CASE WHEN contains(lower(replace(coalesce(style, ''), ' ', '')), 'display:none') OR coalesce(width IN ('0', '1'), false) OR hid IS NOT NULL THEN 'True' ELSE 'False' END
   WHEN tag = 'meta' AND lower(equiv) = 'refresh' THEN 'meta refresh content=' || {_literal("c120")} WHEN tag = 'script' AND src <> '' THEN 'script src=' || left(src, 150) END AS line FROM f),
 r AS (SELECT page_id, own, pos, i, trim(x) AS x FROM (SELECT page_id, own, pos, 0 AS i, href AS x FROM v UNION ALL SELECT page_id, own, pos, 1, src FROM v UNION ALL SELECT page_id, own, pos, 2, action FROM v) WHERE trim(x) <> '' AND NOT regexp_matches(trim(x), '^(#|javascript:|data:|mailto:|tel:)')),
 h AS (SELECT page_id, host, count(*) AS n, min((pos, i)) AS seen FROM (SELECT *, {_link("x")} AS host FROM r) WHERE host <> '' AND host <> own GROUP BY page_id, host),
 t AS (SELECT page_id, string_agg(host || '(' || n || ')', ', ' ORDER BY n DESC, seen) AS top FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, seen) AS k FROM h) WHERE k <= 10 GROUP BY page_id),
 z AS (SELECT page_id, pos, line FROM l WHERE line IS NOT NULL UNION ALL SELECT page_id, -1, 'title: ' || trim(x) FROM (SELECT page_id, replace(regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), ''), '^\s+|\s+$', '', 'g'), '&amp;', '&') AS x FROM b) WHERE trim(x) <> ''
   UNION ALL SELECT page_id, 1000000000, 'password inputs: ' || len(regexp_extract_all(html, '(?i)type\s*=\s*["'']?password')) FROM b UNION ALL SELECT b.page_id, 1000000001, 'external hosts referenced: ' || coalesce(top, 'none') FROM b LEFT JOIN t ON t.page_id = b.page_id),
 y AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM z)"""


@query(f"WITH {HTM7_SQL} SELECT page_id, no, CASE WHEN len(line) <= 200 THEN line ELSE left(line, 199) || '…' END AS line FROM y WHERE no <= 40")
def htm7_structural_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's structure as lines: title, forms with their fields, frames, refreshes, scripts, password inputs, hosts by count."""
    return structure.structure_lines(web_pages(spark, sf_dir))


KINDS = ("a", "form", "iframe", "img")


@query(
    rf"""WITH {WEB}, e AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS x FROM w),
 l AS (SELECT page_id, lower(regexp_extract(x, '^<([a-zA-Z0-9]+)', 1)) AS tag, {site(HOST)} AS own, lower(regexp_extract(x, '(?i)\b(?:href|action|src)="([^"]*)"', 1)) AS link FROM e),
 k AS (SELECT *, {site("regexp_extract(link, '^(?:https?:)?//([^/]*)', 1)")} AS to_site FROM l WHERE tag IN ('a', 'form', 'iframe', 'img')),
 d AS (SELECT page_id, tag, CASE WHEN link = '' OR link LIKE '#%' OR link LIKE 'javascript:%' THEN 'null' WHEN link LIKE 'mailto:%' THEN 'mailto' WHEN link LIKE '//%' OR link LIKE 'http%' THEN CASE WHEN to_site = own THEN 'same' ELSE 'external' END ELSE 'same' END AS dest FROM k)
 SELECT page_id, tag AS kind, count(*) FILTER (dest = 'null') AS "null", count(*) FILTER (dest = 'mailto') AS mailto, count(*) FILTER (dest = 'same') AS same, count(*) FILTER (dest = 'external') AS external,
 round(count(*) FILTER (dest = 'external') / count(*), 6) AS external_share FROM d GROUP BY ALL"""
)
def htm8_url8_link_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a page's links, forms, frames and images lead, with the share that leaves its registrable name."""
    w = web_pages(spark, sf_dir).withColumn("host", urls.host_of(F.col("url")))
    a = F.col("attributes")
    link = F.coalesce(*(F.nullif(P.attribute(a, n), F.lit("")) for n in ("href", "action", "src")), F.lit(""))
    e = P.page_elements(w).where(F.col("tag").isin(*KINDS)).select("page_id", F.col("tag").alias("kind"), link.alias("link"))
    e = e.join(w.select("page_id", "url", "host"), "page_id").withColumn("to", urls.link_host(F.col("link"), F.col("url")))
    e = urls.registrable(urls.registrable(e, "host", _suffixes(spark), "own"), "to", _suffixes(spark), "to_site")
    e = e.withColumn("dest", urls.destination(F.col("link"), F.col("own"), F.col("to_site")))
    counts = [F.count_if(F.col("dest") == k).alias(k) for k in ("null", "mailto", "same", "external")]
    return rounded(e.groupBy("page_id", "kind").agg(*counts, F.avg((F.col("dest") == "external").cast("int")).alias("external_share")))


@query(
    rf"""WITH {WEB}, p AS (SELECT page_id, 'title' AS place, unnest(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS x FROM w UNION ALL SELECT page_id, 'h1', unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) FROM w
 UNION ALL SELECT page_id, 'h2', unnest(regexp_extract_all(html, '(?is)<h2[^>]*>(.*?)</h2>', 1)) FROM w UNION ALL SELECT page_id, 'h3', unnest(regexp_extract_all(html, '(?is)<h3[^>]*>(.*?)</h3>', 1)) FROM w
 UNION ALL SELECT page_id, 'button', unnest(regexp_extract_all(html, '(?is)<button[^>]*>(.*?)</button>', 1)) FROM w UNION ALL SELECT page_id, 'form', unnest(regexp_extract_all(html, '(?is)<form[^>]*>(.*?)</form>', 1)) FROM w
 UNION ALL SELECT page_id, 'alt', unnest(regexp_extract_all(html, '(?is)\salt="([^"]*)"', 1)) FROM w UNION ALL SELECT page_id, 'placeholder', unnest(regexp_extract_all(html, '(?is)\splaceholder="([^"]*)"', 1)) FROM w)
 SELECT page_id, place, trim(regexp_replace(regexp_replace(x, '<[a-zA-Z/!?][^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM p WHERE trim(regexp_replace(regexp_replace(x, '<[a-zA-Z/!?][^>]*>', ' ', 'g'), '\s+', ' ', 'g')) <> ''"""
)
def htm9_prominent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prominent_text(web_pages(spark, sf_dir))


@query()
def htm11_simplified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages shortened to 150 tokens: structure first, then both ends. Tested on literal pages; SQL has no fold with state."""
    w = web_pages(spark, sf_dir).select("page_id", P.simplify_html(F.col("html"), 150).alias("html"))
    return w.select("page_id", F.ceil(F.length("html") / 4).cast("long").alias("tokens"), F.sha2("html", 256).alias("sha"))


@query(
    rf"""WITH {WEB}, c AS (SELECT page_id, len(html) AS chars, list_transform(string_split(html, '>'), lambda x: len(x) + 1) AS sizes FROM w)
 SELECT page_id, chars, list_sum(sizes) - 1 AS joined, list_max(sizes) AS longest FROM c"""
)
def htm12_chunks_at_tag_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut at tag ends: with a width of one every piece ends with the next tag, and the pieces together are the page."""
    c = F.transform(P.chunk_html(F.col("html"), 1), F.length)
    w = web_pages(spark, sf_dir).select("page_id", F.length("html").cast("long").alias("chars"), c.alias("sizes"), F.col("html").endswith(">").alias("closed"))
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    # SQL counts a tag end for the last piece, whether it has one or not
    last = F.element_at("sizes", -1) + F.when(F.col("closed"), 0).otherwise(1)
    longest = F.greatest(F.array_max(F.slice("sizes", F.lit(1), F.greatest(F.size("sizes") - 1, F.lit(0)))), last, F.lit(1))
    return w.select("page_id", "chars", total.alias("joined"), longest.cast("long").alias("longest"))


# --- brands ----------------------------------------------------------------------------------------------------------

NAMES = (("bets", ("bets.com",)), ("casino", ("example.org",)), ("out", ("example.net", "example.org")), ("tiontion", ("pills.com",)))
BRANDS = "b(word, domains) AS (VALUES " + ", ".join(f"('{w}', [{', '.join(repr(x) for x in d)}])" for w, d in NAMES) + ")"
WORDS = r"string_split_regex(lower(text), '[^\p{L}\p{N}]+')"


def _names(spark: SparkSession) -> DataFrame:
    items = [F.struct(F.lit(w).alias("word"), F.array(*map(F.lit, d)).alias("domains")) for w, d in NAMES]
    return F.broadcast(spark.range(1).select(F.explode(F.array(*items)).alias("b")).select("b.*"))  # four names


PROMINENT = r"""p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS text FROM w UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[123][^>]*>(.*?)</h[123]>', 1)) FROM w
 UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '(?is)<button[^>]*>(.*?)</button>', 1)) FROM w UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '(?is)\s(?:alt|placeholder)="([^"]*)"', 1)) FROM w
 UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '(?is)<form[^>]*>(.*?)</form>', 1)) FROM w), q AS (SELECT page_id, regexp_replace(text, '<[a-zA-Z/!?][^>]*>', ' ', 'g') AS text FROM p)"""


@query(
    rf"""WITH {WEB}, {BRANDS}, {PROMINENT}, t AS (SELECT DISTINCT page_id, unnest({WORDS}) AS word FROM q), s AS (SELECT page_id, {site(HOST)} AS own FROM w)
 SELECT page_id, word, own, list_contains(domains, own) AS is_own FROM t JOIN b USING (word) JOIN s USING (page_id)"""
)
def join11_brand_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a page's prominent text, against the page's own registrable name."""
    w = web_pages(spark, sf_dir).withColumn("host", urls.host_of(F.col("url")))
    own = urls.registrable(w.select("page_id", "host"), "host", _suffixes(spark), "own").select("page_id", "own")
    said = brands.named_in_text(P.prominent_text(w), "text", _names(spark)).select("page_id", "word", "domains").distinct()
    return said.join(own, "page_id").select("page_id", "word", "own", F.array_contains("domains", F.col("own")).alias("is_own"))


REFERENCE = (("AT&T", ("att.com", "att.net")), ("Bets", ("bets.com",)), ("ING", ("ing.com",)), ("box", ("box.com",)), ("Your PIN", ("example.com", "pin.com")), ("Bank of Out & Away", ("away.com",)), ("Out & away", ("away.com",)), ("casino", ("casino.com",)))
REFERENCE_SQL = "rf(brand, domains) AS (VALUES " + ", ".join(f"('{b}', [{', '.join(repr(d) for d in ds)}])" for b, ds in REFERENCE) + ")"


def _reference(spark: SparkSession) -> DataFrame:
    """A small list of names with marks, capitals and several words."""
    return spark.createDataFrame([(b, list(ds)) for b, ds in REFERENCE], "brand string, domains array<string>")


@query(
    rf"""WITH {WEB}, {REFERENCE_SQL}, a AS (SELECT page_id, url, {HOST} AS host, {site(HOST)} AS own, html, regexp_matches(html, '(?is)<input\b[^>]*\btype\s*=\s*["'']?password') AS password FROM w),
 pl AS (SELECT page_id, place, replace(replace(replace(trim(regexp_replace(regexp_replace(x, '<[a-zA-Z/!?][^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM ({" UNION ALL ".join(
     rf"SELECT page_id, '{t}' AS place, unnest(regexp_extract_all(html, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1)) AS x FROM w" for t in ("title", "h1", "h2", "h3", "button", "form"))} UNION ALL {" UNION ALL ".join(
     rf"SELECT page_id, '{n}', unnest(regexp_extract_all(html, '(?is)<[a-z][^>]*?\b{n}\s*=\s*[\"'']([^\"''>]*)[\"'']', 1)) FROM w" for n in ("alt", "placeholder"))})),
 m AS (SELECT page_id, brand, domains, list_sort(list(DISTINCT place)) AS places FROM pl, rf WHERE (len(brand) >= 4 AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || regexp_escape(brand) || '($|[^A-Za-z0-9])')) OR (len(brand) < 4 AND upper(brand) = brand AND regexp_matches(text, '(^|[^A-Za-z0-9])' || regexp_escape(brand) || '($|[^A-Za-z0-9])')) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY len(places) DESC, brand) AS place_no FROM m), e AS (SELECT page_id, own, unnest(regexp_extract_all(html, '<[aA]\s[^>]*>')) AS x FROM a),
 l AS (SELECT page_id, own, lower(regexp_extract(x, '(?i)\bhref="([^"]*)"', 1)) AS link FROM e), k AS (SELECT page_id, CASE WHEN regexp_matches(link, '^(https?:)?//') THEN {site("regexp_extract(link, '^(?:https?:)?//([^/?#]*)', 1)")} END AS dest, own FROM l)
 SELECT r.page_id, place_no, brand, array_to_string(places, ', ') AS places, array_to_string(list_sort(domains)[:5], ', ') AS official, own, list_contains(domains, own) AS is_own, (SELECT count(*) FROM k WHERE k.page_id = r.page_id AND dest <> k.own AND list_contains(domains, dest)) AS to_brand,
 (SELECT count(*) FROM k WHERE k.page_id = r.page_id) AS anchors, password FROM r JOIN a ON a.page_id = r.page_id WHERE place_no <= 3"""
)
def join11_brand_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three names of a list that stand in most of a page's prominent places, against its own registrable name and its links."""
    w = web_pages(spark, sf_dir).withColumn("host", urls.host_of(F.col("url")))
    own = urls.registrable(w, "host", _suffixes(spark), "own")
    said = P.prominent_text(w).withColumn("text", structure.decoded(F.col("text")))
    a = P.page_elements(w).where("tag = 'a'").select("page_id", P.attribute(F.col("attributes"), "href").alias("link")).join(own.select("page_id", "url", "own"), "page_id")
    a = urls.registrable(a.withColumn("to_host", urls.link_host(F.col("link"), F.col("url"))), "to_host", _suffixes(spark), "to_site")
    leaves = urls.destination(F.col("link"), F.col("own"), F.col("to_site")) == "external"
    links = a.select("page_id", F.when(leaves, F.col("to_site")).alias("to"))
    password = F.col("html").rlike(r"(?is)<input\b[^>]*\btype\s*=\s*[\"']?password")
    found = brands.lookup(said, "page_id", _reference(spark), own.select("page_id", "own", password.alias("password")), links)
    return found.withColumns({"places": F.array_join("places", ", "), "official": F.array_join("official", ", ")})


@query(
    rf"""WITH {WEB}, {BRANDS}, {PROMINENT}, s AS (SELECT page_id, {HOST} AS host, {site(HOST)} AS own, regexp_matches(html, '(?is)<input\b[^>]*type\s*=\s*"?password') AS password FROM w),
 t AS (SELECT DISTINCT page_id, unnest({WORDS}) AS word FROM q), n AS (SELECT page_id, list_contains(domains, own) AS mine FROM t JOIN b USING (word) JOIN s USING (page_id)),
 u AS (SELECT page_id, own, unnest(list_distinct(string_split_regex(substr(host, 1, greatest(0, len(host) - len(own) - 1)), '[^a-z0-9]+'))) AS word FROM s),
 o AS (SELECT DISTINCT page_id FROM u JOIN b USING (word) WHERE NOT list_contains(domains, own)), k AS (SELECT DISTINCT page_id FROM u JOIN b ON u.word <> b.word AND damerau_levenshtein(u.word, b.word) = 1)
 SELECT s.page_id, coalesce((SELECT count(*) FROM n WHERE n.page_id = s.page_id), 0) > 0 AS named, coalesce((SELECT bool_or(NOT mine) FROM n WHERE n.page_id = s.page_id), false) AS mismatch,
 coalesce((SELECT bool_or(NOT mine) FROM n WHERE n.page_id = s.page_id), false) AND password AS mismatch_with_password, s.page_id IN (SELECT page_id FROM o) AS outside, s.page_id IN (SELECT page_id FROM k) AS look_alike FROM s"""
)
def url10_brand_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five flags a page: a name in its prominent text, one that is not its own, that with a password field, a name in its
    subdomain outside its own domains, and a look-alike of one."""
    w = web_pages(spark, sf_dir).withColumn("host", urls.host_of(F.col("url")))
    own = urls.registrable(w.select("page_id", "host"), "host", _suffixes(spark), "own")
    said = join11_brand_in_text(spark, sf_dir).groupBy("page_id").agg(F.lit(True).alias("named"), F.bool_or(~F.col("is_own")).alias("mismatch"))
    sub = F.substring("host", F.lit(1), F.greatest(F.lit(0), F.length("host") - F.length("own") - 1))
    tokens = own.select("page_id", "own", F.array_distinct(F.split(sub, "[^a-z0-9]+")).alias("tokens"))
    outside = brands.named_elsewhere(tokens, "tokens", "own", _names(spark)).select("page_id").distinct().withColumn("outside", F.lit(True))
    word = tokens.select("page_id", F.explode("tokens").alias("token"))
    alike = brands.look_alikes(word, _names(spark).select(F.col("word").alias("name")), "token", "name").select("token").distinct()
    alike = word.join(alike, "token", "left_semi").select("page_id").distinct().withColumn("look_alike", F.lit(True))
    password = F.col("html").rlike(r"(?is)<input\b[^>]*\btype\s*=\s*[\"']?password")
    out = w.select("page_id", password.alias("password"))
    for x in (said, outside, alike):
        out = out.join(x, "page_id", "left")
    out = out.fillna(False)
    return out.select("page_id", "named", "mismatch", (F.col("mismatch") & F.col("password")).alias("mismatch_with_password"), "outside", "look_alike")


# --- triggers --------------------------------------------------------------------------------------------------------


def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a case beside its page: rendered page, content, redirects, certificate, message, by the page's number."""
    n = F.col("page_id")
    host = urls.host_of(F.col("url"))
    return web_pages(spark, sf_dir).select(
        "page_id", "url", "html",
        F.when(n % 5 == 1, '<html><title>wait</title><div id="root"></div></html>').otherwise(F.col("html")).alias("dom"),
        F.when(n % 4 == 2, " ").when(n % 4 != 3, P.visible_text(F.col("html"))).alias("page_content"),
        F.when(n % 3 == 0, F.concat("url", F.lit(" -> https://landing.example.com/x"))).when(n % 3 == 1, F.concat("url", F.lit(" -> "), "url")).alias("redirect_chain"),
        F.when(n % 4 == 1, F.concat(F.lit("issuer=x; queried_name="), host, F.lit("; n=1"))).when(n % 4 == 3, "queried_name=CDN.example.org").alias("ct"),
        F.when(n % 6 == 0, "see https://a.example.com/x and http://b.example.net/y now").when(n % 6 == 1, F.concat(F.lit("see "), "url")).alias("message_body"),
        F.when(n % 7 == 3, "shot").alias("screenshot"),
    )


EV = f"""ev AS (SELECT page_id, url, html, {HOST} AS host, {site(HOST)} AS own, CASE WHEN page_id % 5 = 1 THEN '<html><title>wait</title><div id="root"></div></html>' ELSE html END AS dom,
 CASE WHEN page_id % 4 = 2 THEN ' ' WHEN page_id % 4 <> 3 THEN {text_of("html")} END AS page_content, CASE page_id % 3 WHEN 0 THEN url || ' -> https://landing.example.com/x' WHEN 1 THEN url || ' -> ' || url END AS redirect_chain,
 CASE page_id % 4 WHEN 1 THEN 'issuer=x; queried_name=' || {HOST} || '; n=1' WHEN 3 THEN 'queried_name=CDN.example.org' END AS ct,
 CASE page_id % 6 WHEN 0 THEN 'see https://a.example.com/x and http://b.example.net/y now' WHEN 1 THEN 'see ' || url END AS message_body, CASE WHEN page_id % 7 = 3 THEN 'shot' END AS screenshot FROM w)"""
GENERIC = ", ".join(f"'{x}'" for x in urls.GENERIC_WORDS)
TOKENS = f"""tk AS (SELECT page_id, list_sort(list_distinct(list_filter(string_split_regex(lower(substr(host, 1, greatest(0, len(host) - len(own) - 1)) || ' ' || regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+'),
 lambda x: len(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({GENERIC})))) AS tokens FROM ev)"""


@query(
    rf"""WITH {WEB}, {EV}, {TOKENS}, t AS (SELECT page_id, 'page_content' AS b, page_content AS text FROM ev UNION ALL SELECT page_id, 'message_body', message_body FROM ev
 UNION ALL SELECT page_id, 'html', regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) FROM ev UNION ALL SELECT page_id, 'dom', regexp_extract(dom, '(?is)<title[^>]*>(.*?)</title>', 1) FROM ev),
 h AS (SELECT page_id, b, list_filter(tokens, lambda x: regexp_matches(lower(text), '(^|[^a-z0-9])' || x || '($|[^a-z0-9])')) AS hits FROM t JOIN tk USING (page_id))
 SELECT page_id, 'shared_entity' AS type, 'url' AS a, b, array_to_string(hits[:5], ',') AS detail FROM h WHERE len(hits) > 0"""
)
def evd3_shared_entity_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = page_evidence(spark, sf_dir).withColumn("host", urls.host_of(F.col("url")))
    return triggers.shared_entity(urls.registrable(ev, "host", _suffixes(spark)), "registrable")


@query(
    rf"""WITH {WEB}, {EV}, l AS (SELECT page_id, own, CASE WHEN page_id % 3 = 0 THEN 'example.com' WHEN page_id % 3 = 1 THEN own END AS hop, CASE WHEN page_id % 4 = 3 THEN 'example.org' WHEN page_id % 4 = 1 THEN own END AS cert,
 list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(message_body, ''), 'https?://([^/ ]*)', 1), lambda h: {site("h")}))) AS regs FROM ev)
 SELECT page_id, 'host_mismatch' AS type, 'url' AS a, 'redirect_chain' AS b, own || '->' || hop AS detail FROM l WHERE hop <> own UNION ALL SELECT page_id, 'host_mismatch', 'url', 'ct', own || '!=' || cert FROM l WHERE cert <> own
 UNION ALL SELECT page_id, 'host_mismatch', 'message_body', 'message_body', array_to_string(regs, ',') FROM l WHERE len(regs) >= 2 UNION ALL SELECT page_id, 'host_mismatch', 'message_body', 'url', own FROM l WHERE len(regs) > 0 AND NOT list_contains(regs, own)"""
)
def evd4_host_mismatch_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.host_mismatch(page_evidence(spark, sf_dir), _suffixes(spark))


@query(
    f"""WITH {WEB}, {EV}, k AS (SELECT page_id, own, unnest(list_filter([CASE WHEN page_id % 3 = 0 THEN 'form:bets.com' END, CASE WHEN page_id % 4 = 1 THEN 'iframe:example.net' END, CASE WHEN page_id % 5 = 0 THEN 'meta_refresh:example.com' END], lambda x: x IS NOT NULL)) AS x FROM ev),
 g AS (SELECT page_id, string_agg(x, ',' ORDER BY x) AS detail FROM k WHERE string_split(x, ':')[2] <> own GROUP BY page_id)
 SELECT page_id, 'cross_origin' AS type, 'html' AS a, 'url' AS b, detail FROM g UNION ALL SELECT page_id, 'cross_origin', 'dom', 'url', detail FROM g WHERE page_id % 5 <> 1"""
)
def evd5_cross_origin_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.cross_origin(page_evidence(spark, sf_dir), _suffixes(spark))


@query(
    rf"""WITH {WEB}, {EV}, x AS (SELECT *, len({text_of("html")}) AS a, len({text_of("dom")}) AS b, len(trim(page_content)) AS p, CASE WHEN page_id % 3 < 2 THEN 1 ELSE 0 END AS forms FROM ev)
 SELECT page_id, 'populated_vs_empty' AS type, 'html' AS a, 'dom' AS b, 'text ' || x.a || ' vs ' || x.b AS detail FROM x WHERE (x.a >= 40) <> (x.b >= 40)
 UNION ALL SELECT page_id, 'populated_vs_empty', 'html', 'page_content', forms || ' form(s), page text ' || p FROM x WHERE p < 40 AND forms > 0 UNION ALL SELECT page_id, 'populated_vs_empty', 'screenshot', 'page_content', 'page text ' || p FROM x WHERE p < 40 AND screenshot IS NOT NULL"""
)
def evd6_populated_vs_empty_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.populated_vs_empty(page_evidence(spark, sf_dir))


# --- the sixty features ------------------------------------------------------------------------------------------------

SIDES = ("phishing", "benign")
CELLS = [(f"f{i}", side, k) for i in range(6) for side in SIDES for k in (1, 2, 3)]
PAGE_COLUMNS = (
    "anchors_own", "anchors_external", "anchors_null", "form_external", "resources_external", "has_certificates", "log_certificates", "log_certificate_days",
    "log_length", "digits", "host_dots", "is_address", "has_at", "punycode",
)
EVIDENCE_COLUMNS = [f"{side}_{x}" for side in SIDES for x in ("breadth", "top", "opposition")] + ["issues", "gaps"]


def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 columns of a page: shares of its links, whether a form leads elsewhere, its certificates, and its url."""
    w = web_pages(spark, sf_dir)
    d = htm8_url8_link_destinations(spark, sf_dir).withColumn("all", F.col("null") + F.col("mailto") + F.col("same") + F.col("external"))
    of = lambda kinds, c: F.sum(F.when(F.col("kind").isin(*kinds), F.col(c)))
    share = lambda kinds, c: F.coalesce(F.try_divide(of(kinds, c).cast("double"), of(kinds, "all").cast("double")), F.lit(0.0))
    a, r = ("a",), ("iframe", "img")
    links = d.groupBy("page_id").agg(
        share(a, "same").alias("anchors_own"), share(a, "external").alias("anchors_external"), share(a, "null").alias("anchors_null"),
        (F.coalesce(of(("form",), "external"), F.lit(0)) > 0).cast("long").alias("form_external"), share(r, "external").alias("resources_external"),
    )
    hosts = observed_hosts(spark, sf_dir)
    s = hosts.join(certificate_counts(hosts, certificates(spark, sf_dir))[0], ["host", "day"], "left").fillna(0, ["n_before"])
    days = F.datediff("day", F.col("first_not_before").cast("date"))
    ct = s.select("page_id", (F.col("n_before") > 0).cast("long").alias("has_certificates"), F.log1p("n_before").alias("log_certificates"), F.log1p(F.coalesce(days, F.lit(0))).alias("log_certificate_days"))
    url = {n: x.cast("double" if n == "log_length" else "long").alias(n) for n, x in urls.lexical_features(F.col("url")).items()}
    shares = ["anchors_own", "anchors_external", "anchors_null", "form_external", "resources_external"]
    return w.select("page_id", *url.values()).join(links, "page_id", "left").fillna(0, shares).join(ct, "page_id")


@query(
    rf"""WITH {WEB}, {FINDINGS_SQL}, {SUPPORT}, {CERTS_SQL}, c AS (SELECT case_id, 9 - count(DISTINCT field) AS gaps, (count(DISTINCT direction) FILTER (direction <> 'neutral') = 2)::INT AS issues, CASE WHEN count(*) FILTER (direction <> 'neutral') > 0 THEN avg(strength) / 3 END AS p, """
    + ", ".join(f"count(*) FILTER (field = '{f}' AND direction = '{d}' AND strength = {k}) AS {f}_{d}_{k}" for f, d, k in CELLS)
    + rf""" FROM f GROUP BY case_id), e AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS x FROM w),
 l AS (SELECT page_id, lower(regexp_extract(x, '^<([a-zA-Z0-9]+)', 1)) AS tag, {site(HOST)} AS own, lower(regexp_extract(x, '(?i)\b(?:href|action|src)="([^"]*)"', 1)) AS link FROM e),
 k AS (SELECT *, {site("regexp_extract(link, '^(?:https?:)?//([^/]*)', 1)")} AS to_site FROM l WHERE tag IN ('a', 'form', 'iframe', 'img')),
 ds AS (SELECT page_id, tag, CASE WHEN link = '' OR link LIKE '#%' OR link LIKE 'javascript:%' THEN 'null' WHEN link LIKE 'mailto:%' THEN 'mailto' WHEN link LIKE '//%' OR link LIKE 'http%' THEN CASE WHEN to_site = own THEN 'same' ELSE 'external' END ELSE 'same' END AS dest FROM k),
 g AS (SELECT page_id, coalesce(count(*) FILTER (tag = 'a' AND dest = 'same') / nullif(count(*) FILTER (tag = 'a'), 0), 0) AS anchors_own, coalesce(count(*) FILTER (tag = 'a' AND dest = 'external') / nullif(count(*) FILTER (tag = 'a'), 0), 0) AS anchors_external,
   coalesce(count(*) FILTER (tag = 'a' AND dest = 'null') / nullif(count(*) FILTER (tag = 'a'), 0), 0) AS anchors_null, (count(*) FILTER (tag = 'form' AND dest = 'external') > 0)::INT AS form_external,
   coalesce(count(*) FILTER (tag IN ('iframe', 'img') AND dest = 'external') / nullif(count(*) FILTER (tag IN ('iframe', 'img')), 0), 0) AS resources_external FROM ds GROUP BY page_id),
 p AS (SELECT w.page_id, round(coalesce(anchors_own, 0), 6) AS anchors_own, round(coalesce(anchors_external, 0), 6) AS anchors_external, round(coalesce(anchors_null, 0), 6) AS anchors_null, coalesce(form_external, 0) AS form_external, round(coalesce(resources_external, 0), 6) AS resources_external,
   (n_before IS NOT NULL)::INT AS has_certificates, round(ln(1 + coalesce(n_before, 0)), 6) AS log_certificates, round(ln(1 + coalesce(date_diff('day', first_not_before::DATE, day), 0)), 6) AS log_certificate_days,
   round(ln(1 + len(url)), 6) AS log_length, len(regexp_extract_all(url, '[0-9]')) AS digits, len(regexp_extract_all({HOST}, '\.')) AS host_dots, regexp_matches({HOST}, '^[0-9.]+$')::INT AS is_address, contains(url, '@')::INT AS has_at, contains({HOST}, 'xn--')::INT AS punycode
   FROM w LEFT JOIN g ON w.page_id = g.page_id JOIN oh ON oh.page_id = w.page_id LEFT JOIN cs ON cs.page_id = w.page_id)
 SELECT c.case_id, coalesce(b.breadth, 0) AS phishing_breadth, coalesce(b.top, 0) AS phishing_top, coalesce(b.opposition, 0) AS phishing_opposition, coalesce(n.breadth, 0) AS benign_breadth, coalesce(n.top, 0) AS benign_top, coalesce(n.opposition, 0) AS benign_opposition,
 issues, gaps, {", ".join(f"{f}_{d}_{k}" for f, d, k in CELLS)}, round(coalesce(ln(least(0.99, greatest(0.01, c.p)) / (1 - least(0.99, greatest(0.01, c.p)))), 0), 6) AS judge_logit, (c.p IS NULL)::INT AS judge_missing, {", ".join(PAGE_COLUMNS)}
 FROM c LEFT JOIN s b ON b.case_id = c.case_id AND b.side = 'phishing' LEFT JOIN s n ON n.case_id = c.case_id AND n.side = 'benign' JOIN p ON p.page_id = c.case_id % (SELECT max(page_id) + 1 FROM w)"""
)
def mld1_sixty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision step's columns: 8 of evidence, 36 of field, direction and strength, the judge's logit (0 without a score) and whether it
    is missing, 14 of the case's page; cases go round all pages."""
    f = findings(spark, sf_dir)
    support = E.support(f)
    cells = [F.count_if((F.col("field") == x) & (F.col("direction") == d) & (F.col("strength") == k)).alias(f"{x}_{d}_{k}") for x, d, k in CELLS]
    said = F.when(F.col("direction") != "neutral", F.col("direction"))
    score = F.when(F.count(said) > 0, F.avg("strength") / 3)
    c = f.groupBy("case_id").agg((F.count_distinct(said) == 2).cast("long").alias("issues"), (9 - F.count_distinct("field")).alias("gaps"), *cells, score.alias("p"))
    for side in SIDES:
        c = c.join(support.where(F.col("side") == side).select("case_id", *(F.col(x).alias(f"{side}_{x}") for x in ("breadth", "top", "opposition"))), "case_id", "left")
    c = c.fillna(0, [x for x in EVIDENCE_COLUMNS if x not in ("issues", "gaps")])
    judge = [F.coalesce(numbers.clipped_logit(F.col("p")), F.lit(0.0)).alias("judge_logit"), F.col("p").isNull().cast("long").alias("judge_missing")]
    c = c.withColumn("page_id", F.col("case_id") % ((web_pages(spark, sf_dir).agg(F.max("page_id")).first()[0] or 0) + 1))
    c = c.join(page_columns(spark, sf_dir), "page_id")
    return rounded(c.select("case_id", *EVIDENCE_COLUMNS, *(f"{x}_{d}_{k}" for x, d, k in CELLS), *judge, *PAGE_COLUMNS))


# --- nearest labelled pages --------------------------------------------------------------------------------------------

NEAREST = 10


@query(
    r"""WITH t AS (SELECT doc_id, source, quality AS y, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents JOIN labels USING (doc_id)),
 c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), k AS (SELECT count(DISTINCT doc_id) AS total FROM c),
 x AS (SELECT doc_id, term, n * (ln((total + 1) / (df + 1)) + 1) AS w FROM c JOIN f USING (term), k), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id), v AS (SELECT doc_id, term, w / norm AS w FROM x JOIN m USING (doc_id)),
 d AS (SELECT DISTINCT doc_id, source, quality AS y FROM documents JOIN labels USING (doc_id)),
 p AS (SELECT a.doc_id AS q, b.doc_id AS o, round(sum(a.w * b.w), 9) AS s FROM v a JOIN v b USING (term) GROUP BY ALL), r AS (SELECT q, s, e.y, row_number() OVER (PARTITION BY q ORDER BY s DESC, o DESC) AS i FROM p JOIN d ON p.q = d.doc_id JOIN d e ON p.o = e.doc_id WHERE d.source <> e.source),
 g AS (SELECT q, sum(s * y) / sum(s) AS share, max(s) FILTER (y = 1) AS good, max(s) FILTER (y = 0) AS bad FROM r WHERE i <= 10 GROUP BY q)
 SELECT d.doc_id, round(coalesce(share, 0.5), 5) AS share, round(coalesce(good, 0), 5) AS good, round(coalesce(bad, 0), 5) AS bad, d.doc_id NOT IN (SELECT doc_id FROM c) AS no_vector FROM d LEFT JOIN g ON d.doc_id = g.q"""
)
def mld14_nearest_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the ten nearest labelled texts outside a text's own source: weighted label share, greatest similarity by
    class, and whether it has a vector at all. Pairs come from an inverted index of whole texts."""
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    counts = materialize(texts.terms(d, "doc_id"), "counts")
    own = d.select("doc_id", "source", "y").distinct()
    near = similarity.nearest(texts.tf_idf(counts, "doc_id"), "doc_id", own.select("doc_id", F.col("source").alias("grp")), NEAREST)
    return rounded(similarity.nearest_label_features(near, own, "doc_id", counts), 5)


PAGE_MEMORY = rf"""s AS (SELECT page_id, url, {text_of("html")} AS text, html FROM w), t AS (SELECT page_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}') || regexp_extract_all(lower(url), '[a-z0-9]{{3,}}')) AS term FROM s),
 g AS (SELECT page_id, list_transform(regexp_extract_all(html, '<\s*([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)) AS g FROM w), u AS (SELECT page_id, unnest(list_transform(range(1, len(g) - 1), lambda i: g[i] || ' ' || g[i + 1] || ' ' || g[i + 2])) AS term FROM g),
 tc AS (SELECT page_id, term, count(*) AS n FROM t GROUP BY ALL), uc AS (SELECT page_id, term, count(*) AS n FROM u GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM tc GROUP BY term), k AS (SELECT count(DISTINCT page_id) AS total FROM tc),
 tw AS (SELECT page_id, term, n * (ln((total + 1) / (df + 1)) + 1) AS w FROM tc JOIN f USING (term), k), d AS (SELECT page_id, {HOST} AS grp, (page_id * 7 % 5 < 2)::INT AS y FROM w)"""


def _memory(name: str, rows: str) -> str:
    """SQL: features of the ten nearest pages of other hosts by one kind of terms."""
    return f"""{name}m AS (SELECT page_id, sqrt(sum(w * w)) AS norm FROM {rows} GROUP BY page_id), {name}v AS (SELECT page_id, term, w / norm AS w FROM {rows} JOIN {name}m USING (page_id)),
 {name}p AS (SELECT a.page_id AS q, b.page_id AS o, round(sum(a.w * b.w), 9) AS s FROM {name}v a JOIN {name}v b USING (term) WHERE a.page_id <> b.page_id GROUP BY ALL),
 {name}r AS (SELECT q, s, e.y, row_number() OVER (PARTITION BY q ORDER BY s DESC, o DESC) AS i FROM {name}p JOIN d ON q = d.page_id JOIN d e ON o = e.page_id WHERE d.grp <> e.grp AND s > 0),
 {name}g AS (SELECT q, sum(s * y) / sum(s) AS share, max(s) FILTER (y = 1) AS good, max(s) FILTER (y = 0) AS bad FROM {name}r WHERE i <= 10 GROUP BY q),
 {name}f AS (SELECT d.page_id, round(coalesce(share, 0.5), 5) AS {name}_share, round(coalesce(good, 0), 5) AS {name}_good, round(coalesce(bad, 0), 5) AS {name}_bad, d.page_id NOT IN (SELECT page_id FROM {rows}) AS {name}_no_vector FROM d LEFT JOIN {name}g ON d.page_id = q)"""


@query(f"WITH {WEB}, {PAGE_MEMORY}, uw AS (SELECT page_id, term, n AS w FROM uc), {_memory('text', 'tw')}, {_memory('tags', 'uw')} SELECT * FROM textf JOIN tagsf USING (page_id)")
def mld14_two_page_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the ten nearest labelled pages of other hosts, by the words of text and url (weighed by rarity) and by runs of
    three tags (plain counts); a page's label follows its number here."""
    w = web_pages(spark, sf_dir).withColumn("grp", urls.host_of(F.col("url"))).withColumn("y", (F.col("page_id") * 7 % 5 < 2).cast("int"))
    said = F.concat(*(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]{3,}"), F.lit(0)) for x in (P.visible_text(F.col("html")), F.col("url"))))
    out = w.select("page_id")
    for name, found in (("text", said), ("tags", texts.tag_trigrams(F.col("html")))):
        counts = materialize(w.select("page_id", F.explode(found).alias("term")).groupBy("page_id", "term").agg(F.count(F.lit(1)).alias("n")), "counts")
        rows = texts.tf_idf(counts, "page_id") if name == "text" else similarity.unit_rows(counts, "page_id")
        near = similarity.nearest(rows, "page_id", w.select("page_id", "grp"), NEAREST)
        f = rounded(similarity.nearest_label_features(near, w.select("page_id", "y"), "page_id", counts), 5)
        out = out.join(f.select("page_id", *(F.col(c).alias(f"{name}_{c}") for c in f.columns if c != "page_id")), "page_id")
    return out
