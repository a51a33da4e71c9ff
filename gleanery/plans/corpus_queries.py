"""Corpus queries: page and text functions, filters, de-duplication, groups, splits, samples, validators and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import pages as P
from gleanery.functions import replies, texts, urls
from gleanery.operators import corpus, similarity
from gleanery.operators.asof import as_of
from gleanery.plans.registry import query, rounded
from gleanery.plans.tables import CASES_SQL, DECISIONS_SQL, cases
from gleanery.sources.tables import read_table

DM = f"WITH {DECISIONS_SQL}, {CASES_SQL} "
HOST = r"lower(regexp_extract(url, '^[^/]*//([^/?#:]*)', 1))"
TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g'), '(?is)<template\b[^>]*>.*?</template\s*>', ' ', 'g'),
 '(?s)<!--.*?-->', ' ', 'g'), '<[a-zA-Z/!?][^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'))"""
GENERIC = ", ".join(f"'{x}'" for x in urls.GENERIC_WORDS)
SKEL = r"list_transform(regexp_extract_all(html, '<\s*([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x))"


def _suffixes(spark: SparkSession) -> DataFrame:
    """A small public-suffix table; results depend on the one given."""
    return spark.sql("SELECT col1 AS suffix FROM VALUES ('com'), ('net'), ('org'), ('io'), ('co.uk'), ('uk'), ('github.io')")


def _sited(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").withColumn("host", urls.host_of(F.col("url")))
    return urls.registrable(p, "host", _suffixes(spark))


@query(f"SELECT page_id, {HOST} AS host, array_to_string(list_slice(string_split({HOST}, '.'), -2, -1), '.') AS registrable, regexp_replace(regexp_replace(url, '#.*$', ''), '/+($|\\?)', '\\1') AS url_norm FROM pages")
def url1_url2_url3_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sited(spark, sf_dir).select("page_id", "host", "registrable", urls.normalize_url(F.col("url")).alias("url_norm"))


@query(
    f"""WITH h AS (SELECT page_id, {HOST} AS host, regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS path FROM pages),
 r AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS reg FROM h),
 t AS (SELECT page_id, string_split_regex(lower(substr(host, 1, greatest(0, len(host) - len(reg) - 1)) || ' ' || path), '[^a-z0-9]+') AS w FROM r)
 SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: len(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({GENERIC})))), ' ') AS tokens FROM t"""
)
def url6_url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _sited(spark, sf_dir)
    return p.select("page_id", F.array_join(urls.url_tokens(F.col("url"), F.col("registrable")), " ").alias("tokens"))


@query(
    f"""SELECT page_id, round(ln(1 + len(url)), 6) AS log_length, len(regexp_extract_all(url, '[0-9]')) AS digits, len(regexp_extract_all({HOST}, '\\.')) AS host_dots,
 regexp_matches({HOST}, '^[0-9.]+$') AS is_address, contains(url, '@') AS has_at, contains({HOST}, 'xn--') AS punycode FROM pages"""
)
def url7_lexical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(read_table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in urls.lexical_features(F.col("url")).items()]))


@query(f"SELECT page_id, len({TEXT}) AS n_chars, sha256({TEXT}) AS text_sha FROM pages")
def htm1_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "pages").select("page_id", P.visible_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha"))


@query(
    f"""SELECT page_id, CASE WHEN len({TEXT}) >= 200 THEN substr(sha256(regexp_replace(lower({TEXT}), '[0-9]+', '0', 'g')), 1, 20) END AS text_key,
 CASE WHEN len({SKEL}) >= 30 THEN substr(sha256(array_to_string(list_slice({SKEL}, 1, 400), ' ') || '|'), 1, 20) END AS skeleton_key, substr(sha256(html), 1, 20) AS html_sha FROM pages"""
)
def htm2_htm4_page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return read_table(spark, sf_dir, "pages").select("page_id", P.text_key(h).alias("text_key"), P.skeleton_key(h).alias("skeleton_key"), P.short_hash(h).alias("html_sha"))


@query(
    r"""SELECT page_id, len(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g')) AS clean_chars,
 trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages"""
)
def htm5_htm13_clean_and_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return read_table(spark, sf_dir, "pages").select("page_id", F.length(P.clean_html(h)).cast("long").alias("clean_chars"), P.title(h).alias("title"))


@query(
    """WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*[^>]*)>', 1)) AS x FROM pages)
 SELECT lower(regexp_extract(x, '^([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM e GROUP BY 1"""
)
def htm7_page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.page_elements(read_table(spark, sf_dir, "pages"))
    return e.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("SELECT doc_id, CAST(ceil(len(text) / 4) AS BIGINT) AS tokens, greatest(1, CAST(ceil(len(text) / 500) AS INTEGER)) AS chunks FROM documents")
def txt11_tokens_and_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").select("doc_id", texts.token_estimate(t).alias("tokens"), F.size(P.chunk_text(t, 500)).alias("chunks"))


@query(
    r"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), u AS (SELECT doc_id, regexp_replace(t, '(https?://\S+|www\.\S+|\b[\w-]+\.(?:com|net|org|ly|co|info|xyz|me|io)/\S*)', ' <url> ', 'gi') AS t FROM t),
 e AS (SELECT doc_id, regexp_replace(t, '[\w.+-]+\s*@\s*[\w-]+(\s*\.\s*[\w-]+)+', ' <email> ', 'g') AS t FROM u)
 SELECT doc_id, substr(sha256(trim(regexp_replace(regexp_replace(t, '[0-9]+', '0', 'g'), '[^\p{L}\p{N}_<>]+', ' ', 'g'))), 1, 12) AS key FROM e"""
)
def txt4_template_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", texts.template_key(F.col("text")).alias("key"))


@query(
    r"""WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
 c AS (SELECT item_id, term, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), t AS (SELECT count(DISTINCT item_id) AS total FROM c),
 x AS (SELECT item_id, term, n * (ln((total + 1) / (df + 1)) + 1) AS w FROM c JOIN f USING (term), t), m AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY item_id),
 v AS (SELECT item_id, term, w / norm AS w FROM x JOIN m USING (item_id))
 SELECT a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.term = b.term AND a.item_id < b.item_id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.1"""
)
def join10_txt6_txt7_txt8_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = texts.tf_idf(texts.terms(read_table(spark, sf_dir, "benchmark"), "item_id"), "item_id")
    return rounded(similarity.similar_pairs(v, "item_id", 0.1))


@query("SELECT doc_id, 'text@' || (instr(text, 'the') - 1) || ':' || (instr(text, 'the') + 2) AS locator, 'the' AS quote FROM documents WHERE contains(text, 'the')")
def txt10_grounded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", texts.span_locator(F.lit("text"), F.col("text"), F.lit("the")).alias("locator"))
    d = d.withColumn("quote", texts.resolve_span(F.col("locator"), F.col("text")))
    return d.where("locator is not null").where(texts.grounded(F.col("quote"), F.col("text"))).select("doc_id", "locator", "quote")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jsn1_tolerant_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return read_table(spark, sf_dir, "events").select("event_id", F.try_variant_get(replies.json_object(reply), "$.k", "bigint").alias("k"))


REPLIES = (
    ("click", "PHISHING: the page mimics a legitimate login"), ("signup", "<thought>LEGITIMATE</thought>Surely PHISHING. " + "x" * 90 + " LEGITIMATE"), ("error", "PHISHING or LEGITIMATE, hard to say"),
    ("view", "legitimate - no sign of fraud"), ("purchase", "Some words. Verdict: **[ legitimate ] not PHISHING"),
)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'phishing' WHEN 'signup' THEN 'phishing' WHEN 'view' THEN 'benign' WHEN 'purchase' THEN 'phishing' ELSE 'inconclusive' END AS label,
 CASE event_type WHEN 'click' THEN 'phishing' WHEN 'signup' THEN 'phishing' WHEN 'view' THEN 'benign' WHEN 'purchase' THEN 'benign' ELSE 'inconclusive' END AS marked, CASE WHEN event_type IN ('click', 'signup') OR value > 100 THEN 'phishing' ELSE 'benign' END AS flags FROM events""")
def jsn2_jsn3_reply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in free text, with and without a marker, and from two flags. A reply belongs to each kind of event."""
    e = read_table(spark, sf_dir, "events")
    reply = F.lit(None)
    for kind, said in REPLIES:
        reply = F.when(F.col("event_type") == kind, said).otherwise(reply)
    e = e.withColumn("reply", reply)
    flags = replies.two_flags(F.col("event_type").isin("click", "signup"), F.col("value") > 100)
    return e.select("event_id", replies.free_text_label(F.col("reply")).alias("label"), replies.free_text_label(F.col("reply"), "Verdict").alias("marked"), flags.alias("flags"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days, strftime(ts, '%Y-%m') > '2023-12' AS after_a, strftime(ts, '%Y-%m') > '2024-01' AS after_b, event_id FROM events")
def dat2_cutoff_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    flags = corpus.after_cutoff(day, [("a", "2023-12"), ("b", "2024-01")])
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", day.alias("day"), F.datediff(day, F.lit("2024-01-01").cast("date")).cast("long").alias("days"), flags["a"].alias("after_a"), flags["b"].alias("after_b"))


# --- filters, de-duplication, groups, splits --------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT source, CASE WHEN len(text) < 200 THEN 'short' WHEN contains(text, '###') THEN 'symbols' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END AS reason FROM documents)
 SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY ALL"""
)
def fil1_agg16_filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = corpus.first_reason(
        ("short", F.length("text") < 200), ("symbols", F.col("text").contains("###")), ("language", ~F.col("lang").isin("en", "de", "fr"))
    )
    return corpus.funnel(read_table(spark, sf_dir, "documents").withColumn("why", why), "why", ["source"])


def _with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and after them copies: of the url with other html, of the html under another url, and of that url with other html."""
    p, k = read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), F.col("page_id")
    again = F.concat(F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), F.lit("?copy="), k)
    one = p.where(k % 3 == 0).select((k + 10_000_000).alias("page_id"), F.concat("url", F.lit("#x")).alias("url"), F.concat("html", F.lit("<!-- 1 -->")).alias("html"))
    two = p.where(k % 4 == 0).select((k + 20_000_000).alias("page_id"), again.alias("url"), "html")
    three = p.where(k % 4 == 0).select((k + 30_000_000).alias("page_id"), again.alias("url"), F.concat("html", F.lit("<!-- 3 -->")).alias("html"))
    return p.unionByName(one).unionByName(two).unionByName(three)


@query(
    r"""WITH o AS (SELECT page_id, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(url, '#.*$', ''), '/+($|\?)', '\1') ORDER BY page_id) AS i FROM pages)
 SELECT page_id FROM o WHERE i = 1 UNION ALL SELECT page_id + CASE WHEN i = 1 THEN 30000000 ELSE 20000000 END FROM o WHERE page_id % 4 = 0"""
)
def win1_greedy_two_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by number under the hash of their html and their normal url. A copy of a kept page's url or html goes; the copy of a
    url that only a dropped page had stays, as that one blocks nothing."""
    d = _with_copies(spark, sf_dir).select("page_id", P.short_hash(F.col("html")).alias("html_sha"), P.short_hash(urls.normalize_url(F.col("url"))).alias("url_sha"))
    return corpus.greedy_dedup(d, ("html_sha", "url_sha"), ["page_id"]).select("page_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS i FROM documents) WHERE i = 1")
def win2_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("x")).select("x.*")


@query(
    f"""WITH k AS (SELECT page_id, {HOST} AS host FROM pages), g AS (SELECT host, min('row:' || page_id) AS grp FROM k GROUP BY host)
 SELECT page_id, grp FROM k JOIN g USING (host)"""
)
def gra1_campaign_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over pages and their hosts. Several keys link rows in more than one step; tests cover those on graphs."""
    p = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page"), urls.host_of(F.col("url")).alias("host"))
    return corpus.campaign_groups(p, "page", ["host"]).select(F.col("page").cast("long").alias("page_id"), "grp")


@query(f"WITH k AS (SELECT page_id, {HOST} AS host, split_part(regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1), '/', 2) AS lang FROM pages) SELECT host, lang, min(page_id) AS page_id, count(*) AS members FROM k GROUP BY ALL")
def win3_earliest_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), F.split_part(F.regexp_extract("url", r"^[^/]*//[^/?#]*([^?#]*)", 1), F.lit("/"), F.lit(2)).alias("lang"))
    return p.groupBy("host", "lang").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("members"))


@query(f"{DM} SELECT case_id, label, rank FROM (SELECT case_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('s1|' || label || '|' || case_id)) AS rank FROM m) WHERE rank <= 50")
def win4_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.balanced_sample(cases(spark, sf_dir), ["label"], "case_id", 50, "s1").select("case_id", "label", "rank")


@query(f"{DM} SELECT case_id, label, split, rank FROM (SELECT case_id, label, split, row_number() OVER (PARTITION BY split, label ORDER BY sha256('s2|' || split || '|' || label || '|' || case_id)) AS rank FROM m) WHERE rank BETWEEN 21 AND 40")
def win5_second_disjoint_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.balanced_sample(cases(spark, sf_dir), ["split", "label"], "case_id", 20, "s2", skip=20).select("case_id", "label", "split", "rank")


@query(
    f"""{DM}, k AS (SELECT case_id FROM m WHERE grp IN ('g1', 'g2', 'g3')) SELECT case_id, label, rank, kept FROM (SELECT m.case_id, label, k.case_id IS NOT NULL AS kept,
 row_number() OVER (PARTITION BY label ORDER BY k.case_id IS NULL, sha256('s3|' || label || '|' || m.case_id)) AS rank FROM m LEFT JOIN k ON m.case_id = k.case_id) WHERE rank <= 60"""
)
def join19_refill_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cases(spark, sf_dir)
    return corpus.refill_sample(m, m.where("grp in ('g1', 'g2', 'g3')"), ["label"], "case_id", 60, "s3").select("case_id", "label", "rank", "kept")


@query(f"{DM} SELECT case_id, grp FROM m WHERE split = 'train' AND grp NOT IN (SELECT grp FROM m WHERE split = 'test' AND stratum = 's1')")
def join5_join6_block_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cases(spark, sf_dir)
    return corpus.block_groups(m.where("split = 'train'"), m.where("split = 'test' and stratum = 's1'"), "grp").select("case_id", "grp")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src1' AND text IS NOT NULL) AND n_chars NOT IN (SELECT n_chars FROM documents WHERE source = 'src1')")
def join20_exclude_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", F.sha2("text", 256).alias("sha"))
    return corpus.exclude_any(d, d.where("source = 'src1'"), ["sha", "n_chars"]).select("doc_id")


@query(f"{DM} SELECT grp, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM m GROUP BY grp HAVING count(DISTINCT split) > 1")
def agg8_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.leaks(cases(spark, sf_dir), "grp")


@query(f"{DM} SELECT stratum, split, count(*) AS n, count(DISTINCT grp) AS groups, min(observed) AS first, max(observed) AS last FROM m GROUP BY ROLLUP (stratum, split)")
def agg7_manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.summary(cases(spark, sf_dir))


@query(f"{DM} SELECT 'vocabulary' AS problem, count(*) FILTER (split NOT IN ('train', 'dev') OR label NOT IN ('phishing', 'benign')) AS n FROM m UNION ALL SELECT 'repeated id', count(*) - count(DISTINCT case_id) FROM m UNION ALL SELECT 'single class', count(*) FROM (SELECT split FROM m GROUP BY split HAVING count(DISTINCT label) < 2)")
def agg9_manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.manifest_problems(cases(spark, sf_dir), ["train", "dev"], ["phishing", "benign"])


@query(f"{DM}, e AS (SELECT split, max(observed) AS last FROM m GROUP BY split) SELECT e.split AS earlier, m.split AS later, count(*) FILTER (observed <= last) AS offending FROM m JOIN e ON (e.split = 'train' AND m.split = 'dev') OR (e.split = 'dev' AND m.split = 'test') GROUP BY ALL")
def agg10_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chronology(cases(spark, sf_dir), [("train", "dev"), ("dev", "test")])


@query(
    f"""{DM}, dl AS (SELECT d.observed, l.label, count(m.case_id) AS k FROM (SELECT DISTINCT observed FROM m) d CROSS JOIN (SELECT DISTINCT label FROM m) l LEFT JOIN m ON m.observed = d.observed AND m.label = l.label GROUP BY ALL),
 u AS (SELECT observed, label, sum(k) OVER (PARTITION BY label ORDER BY observed) AS upto, sum(k) OVER (PARTITION BY label) AS total FROM dl), s AS (SELECT observed, min(least(upto / 600, (total - upto) / 200)) AS slack FROM u GROUP BY observed)
 SELECT observed AS cutoff, round(slack, 6) AS slack FROM s ORDER BY slack DESC, observed LIMIT 1"""
)
def win6_cutoff_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus.cutoff_search(cases(spark, sf_dir), 600, 200))


@query(f"{DM}, g AS (SELECT grp, (row_number() OVER (ORDER BY sha256('s4|' || grp)) - 1) % 5 AS fold FROM (SELECT DISTINCT grp FROM m)) SELECT case_id, CAST(fold AS INTEGER) AS fold FROM m JOIN g USING (grp)")
def win14_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.folds(cases(spark, sf_dir), "grp", 5, "s4").select("case_id", "fold")


@query("WITH x AS (SELECT source, lang, quality FROM documents JOIN labels USING (doc_id)) SELECT source, lang, quality, count(*) AS n FROM x GROUP BY CUBE (source, lang, quality)")
def agg12_cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read_table(spark, sf_dir, "labels"), "doc_id")
    return d.cube("source", "lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH x AS (SELECT quality, contains(text, '@') AS mail, regexp_matches(text, '[0-9]{4}') AS digits, contains(text, '***') AS stars FROM documents JOIN labels USING (doc_id)),
 r AS (SELECT indicator, round(avg(v::INT) FILTER (quality = 1), 6) AS good, round(avg(v::INT) FILTER (quality = 0), 6) AS bad FROM (UNPIVOT x ON mail, digits, stars INTO NAME indicator VALUE v) GROUP BY indicator)
 SELECT *, abs(good - bad) >= 0.1 AS flagged FROM r"""
)
def agg30_indicator_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("quality", t.contains("@").alias("mail"), t.rlike("[0-9]{4}").alias("digits"), t.contains("***").alias("stars"))
    u = d.unpivot(["quality"], ["mail", "digits", "stars"], "indicator", "v")
    rates = [F.round(F.avg(F.when(F.col("quality") == q, F.col("v").cast("int"))), 6).alias(n) for q, n in ((1, "good"), (0, "bad"))]
    return u.groupBy("indicator").agg(*rates).withColumn("flagged", F.abs(F.col("good") - F.col("bad")) >= 0.1)


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def win18_top_k_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query(
    """WITH l AS (SELECT *, row_number() OVER () AS r FROM lineitem), x AS (SELECT r, l_orderkey, l_linenumber, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM l JOIN orders o ON l_suppkey = o_custkey AND o_orderdate <= l_shipdate + INTERVAL 1 DAY GROUP BY ALL)
 SELECT l_orderkey, l_linenumber, latest FROM x"""
)
def join14_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of by key and time: the latest order of the key on or before the day after shipping."""
    left = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.expr("cast(l_shipdate + INTERVAL 1 DAY as date)").alias("t"), "l_orderkey", "l_linenumber")
    right = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("t"), F.col("o_orderkey").alias("latest"))
    return as_of(left, right, "key", "t", "latest").where("latest is not null").select("l_orderkey", "l_linenumber", "latest")


@query("SELECT count(*) FILTER (d.doc_id IS NULL) AS labels_only, count(*) FILTER (l.doc_id IS NULL) AS documents_only, count(*) FILTER (d.doc_id = l.doc_id) AS both FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def src9_unmatched_on_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"))
    j = d.join(read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l")), F.col("d") == F.col("l"), "full_outer")
    return j.agg(F.count_if(F.col("d").isNull()).alias("labels_only"), F.count_if(F.col("l").isNull()).alias("documents_only"), F.count_if(F.col("d") == F.col("l")).alias("both"))


@query("WITH f AS (SELECT source, doc_id // 1000 AS r, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id || ':' || sha256(text))) AS v, count(*) AS n FROM documents GROUP BY ALL) SELECT source, substr(sha256(string_agg(r || ':' || v, chr(10) ORDER BY r)), 1, 16) AS version, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY source")
def snk5_content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version per source: its lines are hashed by ranges of a thousand ids, then the ranges' hashes in order."""
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    part = read_table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 1000").alias("r"))
    part = part.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("v"), F.count(F.lit(1)).alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: F.concat_ws(":", x["r"].cast("string"), x["v"]))
    return part.groupBy("source").agg(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16).alias("version"), F.sum("n").alias("n"))
