"""Queries on text pieces, samples and swaps, sinks and sources, roll-ups and audits in their full detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import pages as P
from gleanery.functions import replies, texts, urls
from gleanery.operators import corpus, guards, metrics, paired
from gleanery.operators import evidence as E
from gleanery.operators import records as R
from gleanery.plans.corpus_queries import HOST
from gleanery.plans.evidence_queries import FS, LINKS, SUPPORT
from gleanery.plans.page_queries import site
from gleanery.plans.registry import query, rounded
from gleanery.plans.rule_queries import RECORDS, all_records
from gleanery.plans.score_queries import COUNTS, D, DM
from gleanery.plans.tables import cases, decisions, findings
from gleanery.sources.shared import new_path
from gleanery.sources.tables import read_table

# --- texts ---------------------------------------------------------------------------------------------------------------


CLIPPED = "CASE WHEN len(x) <= 200 THEN x ELSE left(x, 199) || '…' END"


@query(
    rf"""WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS p FROM documents), e AS (SELECT doc_id, trim(regexp_replace(unnest(p), '\s+', ' ', 'g')) AS x, unnest(range(len(p))) AS pos FROM s),
 c AS (SELECT doc_id, pos, {CLIPPED} AS line FROM e WHERE len(x) >= 3), f AS (SELECT doc_id, lower(line) AS low, min(pos) AS pos, arg_min(line, pos) AS line FROM c GROUP BY doc_id, low), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM f)
 SELECT doc_id, no, sha256(line) AS line FROM r WHERE no <= 40"""
)
def txt1_win17_distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty distinct lines or sentences of each text, whatever their case; the cap is the operator's."""
    out = texts.evidence_lines(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "no", F.sha2("line", 256).alias("line"))


@query(
    rf"""WITH t AS (SELECT page_id, 'a=1; b = two ;;c=' || page_id || chr(10) || '; d' || chr(10) || chr(10) || 'a=1;' AS rec FROM pages), e AS (SELECT page_id, trim(regexp_replace(unnest(p), '\s+', ' ', 'g')) AS x, unnest(range(len(p))) AS pos FROM (SELECT page_id, string_split_regex(rec, ';\s*|\n+') AS p FROM t))
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS no, x AS line FROM e WHERE x <> ''"""
)
def txt1_record_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``key=value`` pieces as lines, one a piece; they also break at line ends, and repeats stay."""
    rec = F.concat(F.lit("a=1; b = two ;;c="), F.col("page_id"), F.lit("\n; d\n\na=1;"))
    return texts.record_lines(read_table(spark, sf_dir, "pages").select("page_id", rec.alias("rec")), "page_id", "rec")


OBFUSCATED = "CASE doc_id % 5 WHEN 0 THEN text || ' pаypal lоgin' WHEN 1 THEN text || ' pássword ùser ' WHEN 2 THEN text || ' a' || chr(8203) || 'b' || chr(65279) ELSE text END"


@query(
    rf"""WITH t AS (SELECT doc_id, {OBFUSCATED} AS text FROM documents), w AS (SELECT doc_id, text, string_split_regex(text, '\s+') AS w FROM t)
 SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '\p{{Latin}}') AND regexp_matches(x, '[\p{{Cyrillic}}\p{{Greek}}]'))) AS mixed_words,
 len(list_filter(list_transform(w, lambda x: regexp_replace(lower(strip_accents(x)), '[^a-z]', '', 'g')), lambda x: x IN ('password', 'login', 'user', 'account')))
 - len(list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: x IN ('password', 'login', 'user', 'account'))) AS disguised, len(regexp_extract_all(text, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]')) AS zero_width FROM w"""
)
def txt2_obfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that mix scripts, credential words under diacritics, zero-width characters; some texts get such words appended."""
    k, t = F.col("doc_id") % 5, F.col("text")
    t = F.when(k == 0, F.concat(t, F.lit(" pаypal lоgin"))).when(k == 1, F.concat(t, F.lit(" pássword ùser "))).when(k == 2, F.concat(t, F.lit(" a​b﻿"))).otherwise(t)
    d = read_table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))
    o = texts.obfuscation(F.col("text"))
    return d.select("doc_id", o["mixed_words"].alias("mixed_words"), texts.disguised(F.col("text"), ("password", "login", "user", "account")).alias("disguised"), o["zero_width"].alias("zero_width"))


@query(
    r"""WITH t AS (SELECT item_id, lower(text) AS t FROM benchmark), w AS (SELECT item_id, t, list_filter(string_split_regex(t, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t),
 k AS (SELECT item_id, 'word' AS kind, unnest(w) AS term FROM w UNION ALL SELECT item_id, 'bigram', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
 UNION ALL SELECT item_id, 'char', unnest(list_transform(range(1, greatest(1, len(t) - 2)), lambda i: substr(t, i, 4))) FROM w) SELECT kind, count(*) AS n, count(DISTINCT term) AS types, count(DISTINCT item_id) AS items FROM k GROUP BY kind"""
)
def txt6_term_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, pairs of words and runs of four characters, counted."""
    b = read_table(spark, sf_dir, "benchmark")
    c = texts.terms(b, "item_id", kinds=("word", "bigram", "char"))
    return c.groupBy("kind").agg(F.sum("n").alias("n"), F.count_distinct("term").alias("types"), F.count_distinct("item_id").alias("items"))


@query(
    r"""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '<\s*([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)) AS t FROM pages),
 g AS (SELECT page_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS term FROM t) SELECT term, count(*) AS n, count(DISTINCT page_id) AS pages FROM g GROUP BY term"""
)
def txt6_tag_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read_table(spark, sf_dir, "pages").select("page_id", F.explode(texts.tag_trigrams(F.col("html"))).alias("term"))
    return g.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query(
    r"""WITH d AS (SELECT doc_id, text, 'the' AS q, doc_id % 3 + 1 AS n FROM documents), p AS (SELECT doc_id, text, q, n, string_split(text, q) AS s FROM d),
 a AS (SELECT doc_id, text, n, len(s) - 1 AS times, CASE WHEN n <= len(s) - 1 THEN list_sum(list_transform(s[1:n], lambda x: len(x))) + 3 * (n - 1) END AS pl FROM p) SELECT doc_id, times, 'text@' || pl || ':' || (pl + 3) || '#' || n AS locator FROM a WHERE pl IS NOT NULL"""
)
def txt10_numbered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th place of a quote as ``field@start:end#n``, checked by resolving it again."""
    n = (F.col("doc_id") % 3 + 1).cast("int")
    loc = texts.span_locator_at(F.lit("text"), F.col("text"), F.lit("the"), n)
    times = (F.size(F.split("text", "the")) - 1).cast("long")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", times.alias("times"), loc.alias("locator")).where("locator is not null")
    return d.where(texts.resolve_span(F.regexp_replace("locator", "#[0-9]+$", ""), F.col("text")) == "the").select("doc_id", "times", "locator")


@query(
    f"""{FS}, l AS (SELECT case_id, pos + 1 AS i, field || ' says ' || entity AS line FROM f), q AS (SELECT case_id, ref, CASE WHEN ref % 4 = 0 THEN 'SAYS  ' || entity WHEN ref % 4 = 1 THEN entity || ' never' ELSE 'says ' || entity END AS quote, CASE WHEN ref % 3 > 0 THEN pos + 1 END AS cited FROM f),
 m AS (SELECT q.ref, cited, list(l.i) FILTER (contains(lower(line), lower(regexp_replace(quote, ' +', ' ', 'g')))) AS pl FROM q JOIN l ON q.case_id = l.case_id GROUP BY ALL),
 k AS (SELECT CASE WHEN cited IS NOT NULL AND list_contains(coalesce(pl, []), cited) THEN 'kept' WHEN cited IS NOT NULL THEN 'bad quote' WHEN len(coalesce(pl, [])) = 1 THEN 'repaired' ELSE 'bad line' END AS outcome FROM m) SELECT outcome, count(*) AS n FROM k GROUP BY outcome"""
)
def txt9_grounding_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes against the lines they cite: kept, repaired where one line alone has them and none is cited, or dropped by reason."""
    f = findings(spark, sf_dir)
    lines = f.select("case_id", (F.col("pos") + 1).alias("i"), F.concat_ws(" says ", "field", "entity").alias("line"))
    k = F.col("ref") % 4
    quote = F.when(k == 0, F.concat(F.lit("SAYS  "), "entity")).when(k == 1, F.concat("entity", F.lit(" never"))).otherwise(F.concat(F.lit("says "), "entity"))
    q = f.select("case_id", "ref", quote.alias("quote"), F.when(F.col("ref") % 3 != 0, F.col("pos") + 1).alias("cited"))
    return E.grounding(q, lines).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT event_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days, CAST(ts AS DATE) AS from_folder, CAST(ts AS DATE) AS from_mail, CAST(NULL AS DATE) AS from_nothing FROM events"
)
def dat1_dates_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day differences, dates in folder names, and dates of mail headers; what is none is null."""
    e, day = read_table(spark, sf_dir, "events"), F.to_date("ts")
    folder = F.concat(F.lit("crawl_"), F.date_format("ts", "yyyyMMdd"), F.lit("_x/page"))
    mail = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss '+0000'")
    return e.select(
        "event_id", F.datediff(day, F.lit("2024-01-01").cast("date")).cast("long").alias("days"), texts.folder_date(folder).alias("from_folder"), texts.mail_date(mail).alias("from_mail"),
        texts.mail_date(F.lit("yesterday")).alias("from_nothing"),
    )


# --- hosts and groups ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'k' || page_id % 5 || '.github.io' WHEN 1 THEN 'a.k' || page_id % 3 || '.blogspot.com' ELSE {HOST} END AS host FROM pages)
 SELECT page_id, host, CASE page_id % 4 WHEN 0 THEN 'github.io' WHEN 1 THEN 'blogspot.com' END AS platform, CASE WHEN page_id % 4 < 2 THEN host ELSE {site("host")} END AS site FROM h"""
)
def url4_url5_sites_on_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts on shared platforms stand for themselves; others for their registrable name. The platforms are a table of suffixes."""
    k = F.col("page_id")
    host = F.when(k % 4 == 0, F.concat(F.lit("k"), k % 5, F.lit(".github.io"))).when(k % 4 == 1, F.concat(F.lit("a.k"), k % 3, F.lit(".blogspot.com"))).otherwise(urls.host_of(F.col("url")))
    p = read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    public = spark.sql("SELECT col1 AS suffix FROM VALUES ('com'), ('net'), ('org'), ('io')")
    private = spark.sql("SELECT col1 AS suffix FROM VALUES ('github.io'), ('blogspot.com'), ('web.app')")
    p = urls.platform_suffix(urls.registrable(p, "host", public), "host", private)
    return p.select("page_id", "host", "platform", urls.site_key(F.col("host"), F.col("registrable")).alias("site"))


@query(
    f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), p AS (SELECT page_id, host, CASE page_id % 9 WHEN 0 THEN 'x.github.io' WHEN 1 THEN 'y.web.app' ELSE host END AS h FROM h) SELECT page_id, h AS host FROM p WHERE NOT ends_with(h, '.github.io') AND NOT ends_with(h, '.web.app')"""
)
def fil7_platform_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host is under none of the private suffixes, by an anti join on the hosts' parents."""
    k = F.col("page_id") % 9
    host = F.when(k == 0, "x.github.io").when(k == 1, "y.web.app").otherwise(urls.host_of(F.col("url")))
    p = read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    private = spark.sql("SELECT col1 AS suffix FROM VALUES ('github.io'), ('web.app'), ('blogspot.com')")
    return urls.platform_suffix(p, "host", private).where("platform is null").select("page_id", "host")


@query(
    f"""WITH RECURSIVE k AS (SELECT page_id, {HOST} AS host, CASE WHEN page_id % 3 > 0 THEN page_id // 6 END AS skel FROM pages WHERE page_id >= 0), e AS (SELECT 'r' || page_id AS a, 'h' || split_part(host, '.', 1) AS b FROM k WHERE page_id % 4 = 0 UNION ALL SELECT 'r' || page_id, 's' || skel FROM k WHERE skel IS NOT NULL),
 g AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), n AS (SELECT 'r' || page_id AS x, page_id FROM k), r(page_id, reach) AS (SELECT page_id, x FROM n UNION SELECT r.page_id, y FROM r JOIN g ON reach = x),
 c AS (SELECT r.page_id, min('row:' || n.page_id) AS grp FROM r JOIN n ON n.x = reach GROUP BY r.page_id) SELECT page_id, grp FROM c"""
)
def gra1_groups_of_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over rows and two nullable keys: subdomains of every fourth page, and runs of six pages."""
    k = F.col("page_id")
    p = read_table(spark, sf_dir, "pages").where("page_id >= 0")
    host = F.when(k % 4 == 0, F.substring_index(urls.host_of(F.col("url")), ".", 1))
    p = p.select(k.cast("string").alias("page"), host.alias("sub"), F.when(k % 3 > 0, F.expr("page_id div 6").cast("string")).alias("skel"))
    return corpus.campaign_groups(p, "page", ["sub", "skel"]).select(F.col("page").cast("long").alias("page_id"), "grp")


@query(f"WITH g AS (SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1) SELECT 'top' AS kind, host AS name, n FROM (SELECT * FROM g ORDER BY n DESC, host LIMIT 10) UNION ALL SELECT 'size', CAST(n AS VARCHAR), count(*) FROM g GROUP BY n")
def agg17_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest groups and how many groups have each size."""
    g = read_table(spark, sf_dir, "pages").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    top = g.orderBy(F.col("n").desc(), "host").limit(10).select(F.lit("top").alias("kind"), F.col("host").alias("name"), "n")
    return top.unionByName(g.groupBy(F.col("n").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("size")))


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, any_value(n) AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (i <= 50) AS oldest_kept, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, count(*) FILTER (i <= 50) AS kept FROM r GROUP BY o_custkey")
def win19_first_last_and_last_fifty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty records of each key, with the first and the last of those."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    kept = o.withColumn("i", F.row_number().over(w)).where("i <= 50").groupBy("o_custkey")
    when = F.struct("o_orderdate", "o_orderkey")
    kept = kept.agg(F.min_by("o_orderkey", when).alias("oldest_kept"), F.max_by("o_orderkey", when).alias("last"), F.count(F.lit(1)).alias("kept"))
    return kept.join(o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "o_custkey")


@query(f"{DM}, ch AS (SELECT case_id FROM m WHERE case_id % 7 < 3), c AS (SELECT case_id + 1000000 AS case_id, case_id AS base, label, grp, row_number() OVER (PARTITION BY label, grp ORDER BY case_id) AS i FROM m WHERE split = 'train' AND case_id IN (SELECT case_id FROM ch)) SELECT case_id, base, label, grp FROM c WHERE i <= 2")
def win24_stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two derived cases of each label and group whose base case is in the chosen set."""
    m = cases(spark, sf_dir)
    chosen = m.where("case_id % 7 < 3").select(F.col("case_id").alias("base"))
    d = m.where("split = 'train'").select((F.col("case_id") + 1000000).alias("case_id"), F.col("case_id").alias("base"), "label", "grp").join(chosen, "base", "left_semi")
    return d.withColumn("i", F.row_number().over(Window.partitionBy("label", "grp").orderBy("base"))).where("i <= 2").select("case_id", "base", "label", "grp")


SWAP = """s AS (SELECT case_id, label, stratum, grp, CASE WHEN case_id % 5 > 0 THEN 'v' || case_id % 7 END AS f1, CASE WHEN case_id % 9 > 0 THEN 'w' || case_id % 11 END AS f2, 'u' || case_id AS url FROM m)"""


@query(
    f"""{DM}, {SWAP}, e AS (SELECT * FROM s WHERE f1 IS NOT NULL AND f2 IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY stratum, grp, label ORDER BY md5('5|' || case_id), case_id) - 1 AS no, count(*) OVER (PARTITION BY stratum, grp, label) AS k FROM e)
 SELECT b.case_id, d.case_id AS donor, b.label, b.url, d.f1, d.f2 FROM e b JOIN n d ON b.stratum = d.stratum AND b.grp = d.grp AND b.label <> d.label AND d.no = ('0x' || substr(md5('b|5|' || b.case_id), 1, 8))::BIGINT % d.k"""
)
def join7_opposite_label_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group of fields replaced by those of a seeded donor of the other label; cases and donors hold every field of the group."""
    k = F.col("case_id")
    s = cases(spark, sf_dir).select(
        "case_id", "label", "stratum", "grp", F.when(k % 5 > 0, F.concat(F.lit("v"), k % 7)).alias("f1"), F.when(k % 9 > 0, F.concat(F.lit("w"), k % 11)).alias("f2"), F.concat(F.lit("u"), k).alias("url"),
    )
    return corpus.swap_fields(s, ["f1", "f2"], ["stratum", "grp"], "5").select("case_id", "donor", "label", "url", "f1", "f2")


@query(
    """WITH x AS (SELECT d.doc_id, source, d.doc_id % 3 = 0 AS screened, d.doc_id % 11 AS day, sha256(text) AS sha FROM documents d), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY screened DESC, day, sha, doc_id) AS i FROM x) SELECT source, doc_id, screened FROM r WHERE i = 1"""
)
def join21_prefer_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One member of each group: those already screened first, then by date and hash."""
    d = read_table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    screened = d.where("doc_id % 3 = 0").select("doc_id", F.lit(True).alias("screened"))
    d = d.join(screened, "doc_id", "left").withColumn("screened", F.coalesce("screened", F.lit(False)))
    order = F.struct((~F.col("screened")).alias("late"), (F.col("doc_id") % 11).alias("day"), "sha", "doc_id")
    return d.groupBy("source").agg(F.min_by(F.struct("doc_id", "screened"), order).alias("x")).select("source", "x.*")


# --- sinks, sources, guards -----------------------------------------------------------------------------------------------


@query("SELECT page_id, html FROM (SELECT page_id, html, row_number() OVER (PARTITION BY page_id % 10 ORDER BY sha256(url), page_id) AS i FROM pages) WHERE i <= 3")
def src2_late_materialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows picked from narrow columns first; the wide column is then read again for the picked keys alone."""
    narrow = read_table(spark, sf_dir, "pages").select("page_id", "url")
    i = F.row_number().over(Window.partitionBy(F.col("page_id") % 10).orderBy(F.sha2("url", 256), "page_id"))
    picked = narrow.withColumn("i", i).where("i <= 3").select("page_id")
    return read_table(spark, sf_dir, "pages").select("page_id", "html").join(picked, "page_id", "left_semi")


@query(f"{D}, l AS (SELECT arm, case_id % 2 AS repeat, case_id // 2 AS case_id, verdict FROM d WHERE model % 5 > 0) SELECT arm, repeat, count(*) AS n, count(*) FILTER (verdict = 'phishing') AS phishing FROM l GROUP BY ALL")
def src4_ledgers_by_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many ledgers read by a pattern and an explicit schema: parent decisions by arm and repeat."""
    path = new_path(spark, "ledgers")
    d = decisions(spark, sf_dir).select(
        F.lit("decision").alias("kind"), "arm", (F.col("case_id") % 2).alias("repeat"), F.expr("case_id div 2").alias("case_id"), "verdict", F.when(F.col("model") % 5 == 0, "o1").alias("parent_object_id"),
    )
    for arm in ("a0", "a1", "a2"):
        d.where(F.col("arm") == arm).write.json(f"{path}/run-{arm}", compression="gzip")
    back = spark.read.schema("kind string, arm string, repeat long, case_id long, verdict string, parent_object_id string").json(f"{path}/run-*/*.json.gz")
    g = guards.parent_decisions(back).groupBy("arm", "repeat")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "phishing").alias("phishing"))


@query(f"{D}, c AS (SELECT arm, {COUNTS} FROM d GROUP BY ALL) SELECT arm, n, tp, fp, tn, fn FROM c")
def snk2_metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as one CSV with a stable order of columns, read back by it."""
    path, columns = new_path(spark, "metrics"), ["arm", "n", "tp", "fp", "tn", "fn"]
    m = metrics.confusion(decisions(spark, sf_dir), ["arm"]).select(*columns)
    m.coalesce(1).write.csv(path, header=True)  # a row an arm
    return spark.read.schema("arm string, n long, tp long, fp long, tn long, fn long").csv(path, header=True)


@query(f"{D} SELECT arm, count(*) AS n, count(*) FILTER (verdict = 'inconclusive') AS failed FROM d GROUP BY arm")
def snk3_resumable_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions appended by arm in two runs that overlap; each case and arm is written once, failures to a sink of their own."""
    path = new_path(spark, "sink")
    d = decisions(spark, sf_dir).select("arm", "case_id", "verdict")
    for part in (d.where("case_id % 3 < 2"), d):
        corpus.append_new(part, path, ["arm", "case_id"], "arm", failed=F.col("verdict") == "inconclusive")
    done, failed = (spark.read.schema("case_id long, verdict string, arm string").parquet(f"{path}/{x}") for x in ("done", "failed"))
    both = done.withColumn("f", F.lit(0)).unionByName(failed.withColumn("f", F.lit(1)))
    return both.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("failed"))


@query("SELECT doc_id, contains(text, 'hunter2') OR contains(text, 'the') AS known, regexp_matches(text, '(sk|key|token)[-_][A-Za-z0-9]{16,}') OR contains(text, 'AKIA') AS shaped FROM documents WHERE contains(text, 'the') OR contains(text, 'hunter2') OR regexp_matches(text, '(sk|key|token)[-_][A-Za-z0-9]{16,}') OR contains(text, 'AKIA')")
def snk7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold one of the known values (a list) or something shaped like a key."""
    t, known = F.col("text"), F.lit(False)
    for value in ("hunter2", "the"):
        known = known | t.contains(value)
    shaped = t.rlike(r"(sk|key|token)[-_][A-Za-z0-9]{16,}") | t.contains("AKIA")
    return read_table(spark, sf_dir, "documents").where(known | shaped).select("doc_id", known.alias("known"), shaped.alias("shaped"))


@query(f"{D}, n AS (SELECT arm, CASE model % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' Fake-Model ' WHEN 3 THEN 'STUB' ELSE 'model-' || model END AS model_id FROM d) SELECT arm, count(*) AS n, count(*) FILTER (model_id IS NULL OR trim(model_id) = '' OR lower(trim(model_id)) IN ('fake-model', 'stub')) AS refused FROM n GROUP BY arm")
def fil5_unnamed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by models without a name or by stand-ins, per arm."""
    k = F.col("model") % 6
    name = F.when(k == 1, "  ").when(k == 2, " Fake-Model ").when(k == 3, "STUB").when(k > 3, F.concat(F.lit("model-"), "model"))
    d = decisions(spark, sf_dir).select("arm", name.alias("model_id"))
    return d.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(guards.unnamed_models(d, ("fake-model", "stub"))).alias("refused"))


OFFLINE = "CASE page_id % 5 WHEN 0 THEN 'This site can''t be reached ERR_NAME_NOT_RESOLVED' WHEN 1 THEN 'No internet. Check the proxy. ERR_INTERNET_DISCONNECTED' WHEN 2 THEN 'Our codes: ERR_PAYMENT_REFUSED' WHEN 3 THEN 'This site can''t be reached' ELSE url END"


@query(f"WITH t AS (SELECT page_id, {OFFLINE} AS t FROM pages) SELECT page_id, regexp_matches(t, '\\bERR_[A-Z_]{{4,}}\\b') AND (contains(t, 'can''t be reached') OR contains(t, 'No internet')) AS offline FROM t")
def fil8_offline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interstitials of a browser: an error code and one of its sentences; either alone is the page's own."""
    k = F.col("page_id") % 5
    t = F.when(k == 0, "This site can't be reached ERR_NAME_NOT_RESOLVED").when(k == 1, "No internet. Check the proxy. ERR_INTERNET_DISCONNECTED").when(k == 2, "Our codes: ERR_PAYMENT_REFUSED")
    t = t.when(k == 3, "This site can't be reached").otherwise(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", P.offline(t, ("can't be reached", "No internet")).alias("offline"))


@query(f"{DM}, e AS (SELECT case_id FROM m WHERE split = 'test') SELECT split, count(*) AS n FROM (SELECT case_id, split FROM m UNION ALL SELECT case_id + 1000000000, 'extra' FROM e) GROUP BY split")
def set2_extend_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of a split that the manifest does not have yet; one that it has is refused."""
    m = cases(spark, sf_dir).select("case_id", "split")
    new = m.where("split = 'test'").select((F.col("case_id") + 1000000000).alias("case_id"), F.lit("extra").alias("split"))
    return corpus.extend_manifest(m, new).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- roll-ups and readings -----------------------------------------------------------------------------------------------


@query(
    f"""{D}, c AS (SELECT arm, {COUNTS}, CAST(sum(tokens) AS BIGINT) AS tokens, sum(latency_s) AS seconds FROM d GROUP BY ALL) SELECT arm, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, tokens, round(seconds, 6) AS seconds FROM c"""
)
def agg4_zero_default_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older convention: undefined rates are 0; with the sums of cost."""
    d = decisions(spark, sf_dir)
    r = metrics.zero_default(metrics.rates(metrics.confusion(d, ["arm"])), ["precision", "recall"]).select("arm", "precision", "recall")
    cost = d.groupBy("arm").agg(F.sum("tokens").alias("tokens"), F.sum("latency_s").alias("seconds"))
    return rounded(r.join(cost, "arm"))


PRICES = (("m0", 0.15, 0.6), ("m1", 2.5, 10.0), ("m2", 0.8, 4.0))


@query(
    f"""{D}, x AS (SELECT 'm' || model % 4 AS model, 'run-' || arm || '.jsonl' AS file, tokens, tokens // 2 AS made, case_id FROM d WHERE case_id % 7 > 0), pr(model, i, o) AS (VALUES {", ".join(f"('{m}', {i}, {o})" for m, i, o in PRICES)})
 SELECT model, file, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens_in, CAST(sum(made) AS BIGINT) AS tokens_out, round(sum(tokens * i + made * o) / 1e6, 6) AS usd FROM x JOIN pr USING (model) GROUP BY ROLLUP (model, file)"""
)
def agg15_cost_by_model_and_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per priced model and ledger file, as the scan names it, with totals of each model and of all. The ledgers are a folder of lines
    for each run; some lines are of parts of a case, some broken, and a ledger of failures lies beside them."""
    d, path = decisions(spark, sf_dir), new_path(spark, "ledgers")
    part = F.when(F.col("case_id") % 7 == 0, "o1:page:1")
    line = F.to_json(F.struct(F.lit("decision").alias("kind"), part.alias("parent_object_id"), F.concat(F.lit("m"), F.col("model") % 4).alias("model_id"), F.col("tokens").alias("input_tokens"), F.expr("tokens div 2").alias("output_tokens")))
    lines = d.select("arm", line.alias("line"), (F.col("case_id") % 50).alias("k"))
    for arm in ("a0", "a1", "a2"):
        own = lines.where(F.col("arm") == arm)
        own.select("line").unionByName(own.where("k = 1").select(F.substring("line", 1, 20).alias("line"))).write.text(f"{path}/run-{arm}.jsonl")
    lines.where("k < 5").select("line").write.text(f"{path}/run-a0.failures.jsonl")
    return rounded(metrics.cost_by_file(spark, f"{path}/*.jsonl", PRICES))


@query(
    f"""{D}, s AS (SELECT case_id, any_value(label) AS label, coalesce(string_agg(arm, '+' ORDER BY arm) FILTER (verdict <> 'inconclusive'), '(none)') AS vector, count(*) FILTER (verdict <> 'inconclusive') AS k, sum(tokens) AS tokens FROM d GROUP BY case_id)
 SELECT vector, coalesce(label, 'all') AS label, count(*) AS n, round(avg(k), 6) AS mean_chosen, round(avg(tokens), 6) AS mean_tokens FROM s GROUP BY GROUPING SETS ((vector), (vector, label))"""
)
def agg22_selection_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each set of systems was chosen, with means, for all cases and by label."""
    got = F.when(F.col("verdict") != "inconclusive", F.col("arm"))
    s = decisions(spark, sf_dir).groupBy("case_id").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(got)).alias("v"), F.sum("tokens").alias("tokens"))
    vector = F.when(F.size("v") == 0, "(none)").otherwise(F.array_join("v", "+"))
    s = s.select(vector.alias("vector"), F.explode(F.array(F.lit("all"), "label")).alias("label"), F.size("v").alias("k"), "tokens")
    return rounded(s.groupBy("vector", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("mean_chosen"), F.avg("tokens").alias("mean_tokens")))


@query(
    f"""{FS}, g AS (SELECT case_id, agent, list(field || '.' || pos ORDER BY pos) AS locs FROM f WHERE direction <> 'neutral' GROUP BY ALL), s AS (SELECT case_id, agent, len(locs) AS n, (len(locs) - len(list_distinct(list_transform(locs, lambda x: split_part(x, '.', 1))))) / len(locs) AS share FROM g),
 p AS (SELECT case_id, count(*) AS groups FROM (SELECT case_id, artifact FROM f GROUP BY ALL HAVING count(*) >= 2) GROUP BY case_id) SELECT s.case_id, agent, n, round(share, 6) AS share, coalesce(groups, 0) AS groups FROM s LEFT JOIN p ON s.case_id = p.case_id"""
)
def agg27_duplicate_support_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the locators an agent cites, the share that repeats a field, and the case's groups of observations with one artifact."""
    f = findings(spark, sf_dir)
    g = f.where("direction <> 'neutral'").groupBy("case_id", "agent").agg(F.collect_list(F.concat_ws(".", "field", "pos")).alias("locs"))
    base = F.array_distinct(F.transform("locs", lambda x: F.substring_index(x, ".", 1)))
    g = g.select("case_id", "agent", F.size("locs").cast("long").alias("n"), ((F.size("locs") - F.size(base)) / F.size("locs")).alias("share"))
    pages = f.groupBy("case_id", "artifact").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").groupBy("case_id").agg(F.count(F.lit(1)).alias("groups"))
    return rounded(g.join(pages, "case_id", "left").fillna(0, ["groups"]))


@query(
    f"""{FS}, h AS (SELECT a.case_id, a.pos, b.field, arg_max(b.direction, b.pos) AS latest, bool_or(b.direction <> 'neutral') AS said FROM f a JOIN f b ON b.case_id = a.case_id AND b.pos <= a.pos GROUP BY ALL),
 s AS (SELECT case_id, pos, coalesce(list(field) FILTER (said), []) AS found, coalesce(list(field) FILTER (latest = 'neutral'), []) AS opened FROM h GROUP BY ALL), n AS (SELECT *, lead(found) OVER w AS found_next, lead(opened) OVER w AS open_next FROM s WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
 d AS (SELECT len(list_filter(found_next, lambda x: NOT list_contains(found, x))) AS added, len(list_filter(opened, lambda x: NOT list_contains(open_next, x))) AS resolved FROM n WHERE found_next IS NOT NULL)
 SELECT count(*) AS rounds, count(*) FILTER (resolved > 0) AS resolving, count(*) FILTER (added > 0) AS adding, round(avg((resolved > 0 OR added > 0)::INT), 6) AS yield FROM d"""
)
def agg34_escalation_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rounds that resolved an issue or added a finding. Each finding is a round here: fields with a directional finding are what
    was found, fields whose latest finding is neutral are open."""
    upto = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    h = findings(spark, sf_dir).select("case_id", "pos", F.collect_list(F.struct("pos", "field", "direction")).over(upto).alias("h"))  # eight at most
    found = F.array_distinct(F.transform(F.filter("h", lambda x: x["direction"] != "neutral"), lambda x: x["field"]))
    fields = F.array_distinct(F.transform("h", lambda x: x["field"]))
    is_open = lambda f: F.element_at(F.filter("h", lambda x: x["field"] == f), -1)["direction"] == "neutral"
    states = h.select("case_id", "pos", found.alias("found"), F.filter(fields, is_open).alias("opened"))
    return rounded(E.escalation_yield(states, "case_id", "pos"))


@query(
    f"""{D}, x AS (SELECT arm, label, verdict, score, coalesce(CASE WHEN tokens % 4 > 0 THEN tokens * 2 END, tokens) AS cost FROM d) SELECT arm, count(*) AS n, round(avg((verdict = 'inconclusive')::INT), 6) AS finalization_error_rate, round(avg((verdict = 'inconclusive' OR verdict <> label)::INT), 6) AS forced_error, count(score) AS n_scored, round(avg(cost), 6) AS mean_cost,
 (SELECT round(avg(tp / i), 6) FROM (SELECT y.label, count(*) OVER w AS i, count(*) FILTER (y.label = 'phishing') OVER w AS tp FROM d y WHERE y.arm = x.arm AND y.score IS NOT NULL WINDOW w AS (ORDER BY y.score DESC, y.case_id ROWS UNBOUNDED PRECEDING)) WHERE label = 'phishing') AS ap FROM x GROUP BY arm"""
)
def agg36_fourth_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that could not be finalised: their rate, errors in the forced view, whole-case cost where there is one, and average
    precision over scored rows."""
    from gleanery.operators import ranking

    d = decisions(spark, sf_dir).withColumn("case_cost", F.when(F.col("tokens") % 4 > 0, F.col("tokens") * 2))
    own = metrics.fourth_outcome(d, ["arm"]).join(d.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("case_cost", "tokens")).alias("mean_cost")), "arm")
    return rounded(own.join(ranking.average_precision(d.where("score is not null"), ["arm"]), "arm"))


@query(
    f"""{FS}, s AS (SELECT case_id, list(DISTINCT field || ':' || direction || ':' || strength) AS keys, avg(strength) FILTER (direction <> 'neutral') AS score, CASE WHEN case_id * 7 % 5 < 2 THEN 'phishing' ELSE 'benign' END AS label FROM f GROUP BY case_id)
 SELECT label, count(*) AS cases, round(avg(list_contains(keys, 'f1:phishing:2')::INT), 6) AS share, round(avg(score), 6) AS mean_score, count(*) FILTER (score IS NULL) AS unscored FROM s GROUP BY label"""
)
def agg38_signal_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By class: the share of cases with a given finding key, the mean score, and the cases without one."""
    f = findings(spark, sf_dir)
    h = E.feature_histogram(f).join(f.groupBy("case_id").agg(F.avg(F.when(F.col("direction") != "neutral", F.col("strength"))).alias("score")), "case_id")
    has = F.map_contains_key("histogram", F.lit("f1:phishing:2")).cast("int")
    h = h.withColumn("label", F.when(F.col("case_id") * 7 % 5 < 2, "phishing").otherwise("benign"))
    return rounded(h.groupBy("label").agg(F.count(F.lit(1)).alias("cases"), F.avg(has).alias("share"), F.avg("score").alias("mean_score"), F.count_if(F.col("score").isNull()).alias("unscored")))


@query(
    f"""{D}, c AS (SELECT arm, {COUNTS} FROM d GROUP BY arm), r AS (SELECT arm, n, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp) AS precision, (tp + fp + tn + fn) / n AS coverage FROM c), z AS (SELECT * FROM r WHERE arm = 'a0')
 SELECT r.arm, round(r.f1 - z.f1, 6) AS delta, r.f1 >= z.f1 AS f1_holds, r.precision >= z.precision - 0.01 AS precision_holds, r.coverage >= z.coverage - 0.05 AS coverage_holds, r.n = z.n AS complete, r.f1 >= z.f1 AND r.precision >= z.precision - 0.01 AND r.coverage >= z.coverage - 0.05 AND r.n = z.n AS go FROM r, z WHERE r.arm <> 'a0'"""
)
def sta12_go_no_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate against the reference run: every criterion as a column, and whether all hold."""
    r = metrics.rates(metrics.confusion(decisions(spark, sf_dir), ["arm"])).select("arm", "n", "f1", "precision", "coverage")
    return rounded(paired.go_no_go(r, "a0"))


@query(
    f"""{D}, lo AS (SELECT * FROM (VALUES ('drop url', -0.05, -0.08, -0.01), ('drop text', -0.04, -0.09, 0.01), ('drop both', -0.02, -0.03, -0.01), ('add', 0.01, -0.01, 0.02)) t(name, delta, low, high)), k AS (SELECT count(*) AS n FROM d) SELECT name, delta <= -0.03 AND high < 0 AS helps, n FROM lo, k"""
)
def sta10_component_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component helps where leaving it out costs 0.03 or more and the whole interval is below zero."""
    rows = [("drop url", -0.05, -0.08, -0.01), ("drop text", -0.04, -0.09, 0.01), ("drop both", -0.02, -0.03, -0.01), ("add", 0.01, -0.01, 0.02)]
    items = [F.struct(F.lit(n).alias("name"), F.lit(d).alias("delta"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for n, d, lo, hi in rows]
    k = decisions(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return k.select("n", F.explode(F.array(*items)).alias("x")).select("x.name", paired.component_helps(F.col("x.delta"), F.col("x.high")).alias("helps"), "n")


# --- evidence rules in detail --------------------------------------------------------------------------------------------


@query(f"{FS}, g AS (SELECT case_id, capture_id, 'artifact' AS edge, artifact AS source, list(ref ORDER BY ref) AS refs FROM f GROUP BY ALL HAVING count(*) >= 2 UNION ALL SELECT case_id, capture_id, 'acquisition', instrument, list(ref ORDER BY ref) FROM f GROUP BY ALL HAVING count(*) >= 2) SELECT case_id, capture_id, edge, source, array_to_string(refs, ',') AS refs FROM g")
def evd14_shared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of one artifact, and those of one acquisition, in each capture."""
    f, out = findings(spark, sf_dir), None
    for edge, column in (("artifact", "artifact"), ("acquisition", "instrument")):
        g = E.shared_groups(f, column).select("case_id", "capture_id", F.lit(edge).alias("edge"), F.col(column).alias("source"), F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))
        out = g if out is None else out.unionByName(g)
    return out


@query(
    f"""{FS}, a AS (SELECT case_id, list(DISTINCT agent) AS ran FROM f GROUP BY case_id), p AS (SELECT case_id, list_filter(['agent0', 'agent1', 'agent2', 'agent3', 'agent4'], lambda x: (case_id + CAST(substr(x, 6, 1) AS INT)) % 4 > 0) AS applicable, ran FROM a)
 SELECT case_id, len(applicable) AS applicable, len(list_intersect(applicable, ran)) AS ready, round(len(list_intersect(applicable, ran)) / nullif(len(applicable), 0), 6) AS availability FROM p"""
)
def evd7_ready_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicable agents, those of them that have evidence, and their share."""
    every = F.array(*[F.lit(f"agent{i}") for i in range(5)])
    g = findings(spark, sf_dir).groupBy("case_id").agg(F.collect_set("agent").alias("ran"))
    applicable = F.filter(every, lambda x: (F.col("case_id") + F.substring(x, 6, 1).cast("int")) % 4 > 0)
    g = g.withColumn("a", applicable).withColumn("r", F.array_intersect("a", "ran"))
    return rounded(g.select("case_id", F.size("a").cast("long").alias("applicable"), F.size("r").cast("long").alias("ready"), F.try_divide(F.size("r"), F.size("a")).alias("availability")))


@query(
    f"""{FS}, i AS (SELECT case_id, pos AS round, agent, ref FROM f WHERE strength >= 2), g AS (SELECT case_id, agent, min(ref) AS first FROM i GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY first) AS k FROM g) SELECT case_id, string_agg(agent, ',' ORDER BY first) AS targets FROM t WHERE k <= 2 GROUP BY case_id"""
)
def evd23_round_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two distinct agents that a case's actionable issues name, in the order of the issues."""
    issues = findings(spark, sf_dir).where("strength >= 2").groupBy("case_id", "agent").agg(F.min("ref").alias("first"))
    k = F.row_number().over(Window.partitionBy("case_id").orderBy("first"))
    t = issues.withColumn("k", k).where("k <= 2").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("first", "agent"))).alias("t"))
    return t.select("case_id", F.array_join(F.col("t.agent"), ",").alias("targets"))


@query(
    f"""{FS}, c AS (SELECT case_id, list(DISTINCT field) AS readable FROM f GROUP BY case_id), a(agent, needs) AS (VALUES ('url', ['f0', 'f1']), ('content', ['f2', 'f3', 'f4']), ('network', ['f5', 'f6'])),
 k AS (SELECT case_id, any_value(readable) AS readable, count(*) FILTER (list_has_any(needs, readable)) AS analysable, count(*) FILTER (list_has_all(readable, needs)) AS complete, string_agg(agent, ',' ORDER BY agent) FILTER (NOT list_has_any(needs, readable)) AS gaps FROM c, a GROUP BY case_id)
 SELECT case_id, analysable, complete, len(readable) AS fields, analysable >= 2 AS verdict_possible, coalesce(gaps, '') AS gaps FROM k"""
)
def evd32_coverage_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a case's readable fields allow at most: agents with some or all they need, whether a verdict is possible, and the
    agents whose gap must be disclosed."""
    g = findings(spark, sf_dir).groupBy("case_id").agg(F.collect_set("field").alias("readable"))
    return E.coverage_ceiling(g, {"url": ["f0", "f1"], "content": ["f2", "f3", "f4"], "network": ["f5", "f6"]}, least=2)


REPLY = """rp AS (SELECT case_id, CASE WHEN count(DISTINCT field) FILTER (direction = 'phishing') > count(DISTINCT field) FILTER (direction = 'benign') THEN 'phishing' WHEN count(DISTINCT field) FILTER (direction = 'benign') > count(DISTINCT field) FILTER (direction = 'phishing') THEN 'benign' ELSE 'neutral' END AS verdict,
   coalesce(list(ref) FILTER (strength = 3 AND case_id % 4 > 0), []) AS cited, coalesce(list(ref) FILTER (direction <> 'neutral'), []) AS eligible, list_filter(['f0', 'f1', 'f2'], lambda x: NOT list_contains(list(field), x)) AS gaps, count(DISTINCT direction) FILTER (direction <> 'neutral') = 2 AS conflict FROM f GROUP BY case_id),
 er AS (SELECT case_id, list_filter([CASE WHEN NOT list_has_all(eligible, cited) THEN 'cites outside' END, CASE WHEN verdict <> 'neutral' AND len(cited) = 0 THEN 'cites nothing' END, CASE WHEN case_id % 6 = 0 AND len(gaps) > 0 THEN 'gap not disclosed' END,
   CASE WHEN conflict AND case_id % 7 = 0 THEN 'issue not disclosed' END], lambda x: x IS NOT NULL) AS errors FROM rp)"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' replies from the findings: every sixth case hides a gap, every seventh a conflict, every fourth cites nothing."""
    f, k = findings(spark, sf_dir), F.col("case_id")
    none = F.array().cast("array<string>")
    r = f.groupBy("case_id").agg(
        F.collect_list(F.when((F.col("strength") == 3) & (k % 4 > 0), F.col("ref"))).alias("cited"), F.collect_list(F.when(F.col("direction") != "neutral", F.col("ref"))).alias("eligible"),
        F.array_except(F.array(*(F.lit(x) for x in ("f0", "f1", "f2"))), F.collect_set("field")).alias("gaps"), F.count_distinct(F.when(F.col("direction") != "neutral", F.col("direction"))).alias("sides"),
    )
    issues = F.when(F.col("sides") == 2, F.array(F.lit("conflict"))).otherwise(none)
    r = r.join(E.preliminary(f).select("case_id", "verdict"), "case_id").withColumn("issues", issues)
    return r.withColumns({"said_gaps": F.when(k % 6 == 0, none).otherwise(F.col("gaps")), "said_issues": F.when(k % 7 == 0, none).otherwise(F.col("issues"))})


@query(f"{FS}, {REPLY} SELECT case_id, array_to_string(errors, '; ') AS errors FROM er")
def fil18_reply_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reply_errors(_replies(spark, sf_dir)).select("case_id", F.array_join("errors", "; ").alias("errors"))


@query(f"{FS}, {REPLY}, n AS (SELECT count(*) AS replies FROM er) SELECT error, count(*) AS n, any_value(replies) AS replies FROM (SELECT unnest(errors) AS error FROM er), n GROUP BY error")
def agg24_disclosure_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.reply_errors(_replies(spark, sf_dir))
    n = F.broadcast(e.agg(F.count(F.lit(1)).alias("replies")))  # one row
    return e.select(F.explode("errors").alias("error")).crossJoin(n).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.first("replies").alias("replies"))


@query(f"{FS}, {RECORDS} SELECT agent, count(*) FILTER (st IN ('ran', 'error', 'no_data')) AS executed, count(*) FILTER (st = 'error') AS rejected, count(*) FILTER (st = 'no_data') AS failures, count(*) FILTER (st = 'skipped') AS blocked, count(*) FILTER (list_contains(failed, 'locators_resolve')) AS invalid_citations, count(*) FILTER (said = 'phishing') AS phishing, count(*) FILTER (said = 'benign') AS benign FROM rc GROUP BY agent")
def agg37_ledger_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records executed, rejected, failed and blocked by agent, invalid citations, and verdicts."""
    r, s = R.validated(all_records(spark, sf_dir)), F.col("status")
    counts = {
        "executed": s.isin("ran", "error", "no_data"), "rejected": s == "error", "failures": s == "no_data", "blocked": s == "skipped", "invalid_citations": F.array_contains("failed", "locators_resolve"),
        "phishing": F.col("verdict") == "phishing", "benign": F.col("verdict") == "benign",
    }
    return r.groupBy("agent").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


@query(
    f"""{FS}, p AS (SELECT case_id, pos % 3 AS stage, field, pos AS attempt0, strength AS cost FROM f), a AS (SELECT case_id, stage, field, cost, row_number() OVER (PARTITION BY case_id, stage, field ORDER BY attempt0) AS attempt FROM p), s AS (SELECT *, sum(cost) OVER (PARTITION BY case_id ORDER BY stage, field, attempt) AS spent FROM a)
 SELECT case_id, stage, field, attempt, CAST(spent AS BIGINT) AS spent, CASE WHEN spent > 9 THEN 'refused' WHEN attempt > 1 THEN 'retried' ELSE 'attempted' END AS status FROM s"""
)
def win20_budgeted_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts in the order of their stages, retries charged, until the pool is spent."""
    p = findings(spark, sf_dir).select("case_id", (F.col("pos") % 3).alias("stage"), "field", F.col("strength").alias("cost"), "pos")
    n = F.row_number().over(Window.partitionBy("case_id", "stage", "field").orderBy("pos")).cast("long")
    return E.acquire(p.withColumn("attempt", n), 9).select("case_id", "stage", "field", "attempt", "spent", "status")


@query(
    f"""{FS}, x AS (SELECT case_id, agent, ref FROM f WHERE strength = 3), n AS (SELECT DISTINCT case_id, agent FROM f WHERE (case_id + CAST(substr(agent, 6, 1) AS INT)) % 4 = 0), ag AS (SELECT DISTINCT case_id, agent FROM f),
 s AS (SELECT f.case_id, f.agent, f.ref FROM f ANTI JOIN n ON f.case_id = n.case_id AND f.agent = n.agent UNION ALL SELECT ag.case_id, ag.agent, x.ref FROM ag JOIN x ON ag.case_id = x.case_id AND ag.agent <> x.agent) SELECT case_id, agent, count(*) AS shown, min(ref) AS first FROM s GROUP BY ALL"""
)
def evd31_evidence_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent's own items, unless it is new or was rejected, and those of others that are cited."""
    f = findings(spark, sf_dir)
    fresh = f.where((F.col("case_id") + F.substring("agent", 6, 1).cast("int")) % 4 == 0).select("case_id", "agent").distinct()
    s = E.shown_again(f, f.where("strength = 3"), fresh)
    return s.groupBy("case_id", "agent").agg(F.count(F.lit(1)).alias("shown"), F.min("ref").alias("first"))


@query(
    f"""{FS} SELECT case_id, 'url' AS submission_type, count(*) FILTER (direction <> 'neutral') AS artifacts, count(DISTINCT field) FILTER (direction = 'neutral') AS failures, count(DISTINCT agent) FILTER (strength = 1) AS inapplicable,
 count(DISTINCT agent) AS agents_with_findings, count(*) FILTER (pos >= 5) AS revised FROM f GROUP BY case_id"""
)
def src6_nested_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document per case with its artifacts, failures, inapplicable agents, findings and revisions, written and read by an
    explicit schema, then flattened."""
    path = new_path(spark, "captures")
    f = findings(spark, sf_dir)
    item = F.struct(F.col("entity").alias("observation"), "field", "direction", "strength")
    per = f.groupBy("case_id", "agent").agg(F.collect_list(item).alias("found"), F.collect_list(F.when(F.col("pos") >= 5, item)).alias("revised"))
    maps = per.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("agent", "found"))).alias("findings"), F.map_from_entries(F.collect_list(F.struct("agent", "revised"))).alias("revisions"))
    quiet = F.array_distinct(F.collect_list(F.when(F.col("direction") == "neutral", F.col("field"))))
    doc = f.groupBy("case_id").agg(
        F.lit("url").alias("submission_type"), F.collect_list(F.when(F.col("direction") != "neutral", F.struct("field", F.col("entity").alias("content"), "instrument"))).alias("artifacts"),
        F.map_from_entries(F.transform(quiet, lambda x: F.struct(x, F.lit("timeout")))).alias("failures"), F.array_sort(F.collect_set(F.when(F.col("strength") == 1, F.col("agent")))).alias("inapplicable"),
    )
    doc.join(maps, "case_id").write.json(path)
    found = "map<string, array<struct<observation: string, field: string, direction: string, strength: int>>>"
    schema = f"case_id long, submission_type string, artifacts array<struct<field: string, content: string, instrument: string>>, failures map<string, string>, inapplicable array<string>, findings {found}, revisions {found}"
    d = spark.read.schema(schema).json(path)
    revised = F.aggregate(F.map_values("revisions"), F.lit(0).cast("long"), lambda n, x: n + F.size(x))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return d.select("case_id", "submission_type", size("artifacts").alias("artifacts"), size("failures").alias("failures"), size("inapplicable").alias("inapplicable"), size("findings").alias("agents_with_findings"), revised.alias("revised"))


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'signup') THEN 'phishing' WHEN event_type = 'error' THEN 'inconclusive' ELSE 'benign' END AS verdict, CASE WHEN event_type <> 'error' THEN round(user_id % 11 / 10, 6) END AS score,
 CASE WHEN user_id % 4 = 0 THEN 0 ELSE user_id % 9 END AS agent_score, user_id % 4 = 0 AS missing FROM events"""
)
def jsn3_jsn7_flags_and_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flags and a score out of ten from a JSON reply, and an agent's score with a flag where it is missing."""
    k, t = F.col("user_id"), F.col("event_type")
    flag = F.when(t == "error", "null").when(t.isin("click", "signup"), "true").otherwise("false")
    ten = F.when(t == "error", F.lit("")).otherwise(F.concat(F.lit(', "score": '), k % 11))
    agent = F.when(k % 4 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"url": '), k % 9, F.lit("}")))
    reply = F.concat(F.lit('Sure: {"phishing": '), flag, F.lit(', "suspicious": '), F.when(t == "error", "null").otherwise("false"), ten, F.lit(', "agents": '), agent, F.lit("} done"))
    e = read_table(spark, sf_dir, "events").select("event_id", replies.json_object(reply).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    own = get("$.agents.url", "long")
    return rounded(e.select(
        "event_id", replies.two_flags(get("$.phishing", "boolean"), get("$.suspicious", "boolean")).alias("verdict"), (get("$.score", "double") / 10).alias("score"), F.coalesce(own, F.lit(0)).cast("long").alias("agent_score"), own.isNull().alias("missing"),
    ))


@query(f"{FS}, l AS (SELECT case_id, agent, field || ': ' || entity AS line FROM f) SELECT case_id, agent, CAST(120 + sum(ceil((len(line) + 1) / 4)) AS BIGINT) AS tokens FROM l GROUP BY ALL")
def txt11_prompt_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of an agent's prompt on a case: a fixed head and its evidence lines."""
    line = F.concat_ws(": ", "field", "entity")
    f = findings(spark, sf_dir).select("case_id", "agent", texts.token_estimate(F.concat(line, F.lit("\n"))).alias("t"))
    return f.groupBy("case_id", "agent").agg((F.sum("t") + 120).alias("tokens"))


@query(
    f"""{FS}, {SUPPORT}, h AS (SELECT case_id, count(*) AS findings, count(DISTINCT field) AS fields, (count(DISTINCT direction) FILTER (direction <> 'neutral') = 2)::BIGINT AS issues FROM f GROUP BY case_id), p AS (SELECT * FROM s WHERE side = 'phishing'), b AS (SELECT * FROM s WHERE side = 'benign')
 SELECT h.case_id, findings, 9 - fields AS gaps, issues, coalesce(p.breadth, 0) AS bad_breadth, coalesce(p.top, 0) AS bad_top, coalesce(p.opposition, 0) AS bad_opposition, coalesce(b.breadth, 0) AS good_breadth, coalesce(b.top, 0) AS good_top, coalesce(b.opposition, 0) AS good_opposition FROM h LEFT JOIN p ON h.case_id = p.case_id LEFT JOIN b ON h.case_id = b.case_id"""
)
def agg20_evidence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence features of a case, for both directions, with its open issues and gaps."""
    f = findings(spark, sf_dir)
    s = E.support(f)
    h = f.groupBy("case_id").agg(F.count(F.lit(1)).alias("findings"), (9 - F.count_distinct("field")).alias("gaps"))
    h = h.join(E.conflict_issues(f).select("case_id", F.lit(1).cast("long").alias("issues")), "case_id", "left")
    for side, n in (("phishing", "bad"), ("benign", "good")):
        h = h.join(s.where(F.col("side") == side).select("case_id", *(F.col(c).alias(f"{n}_{c}") for c in ("breadth", "top", "opposition"))), "case_id", "left")
    return h.fillna(0)


@query(
    f"""{FS}, {LINKS}, pr AS (SELECT a.case_id, a.ref AS a, b.ref AS b, CASE WHEN a.agent = b.agent THEN 'one agent' ELSE 'two agents' END AS kind, a.capture_id = b.capture_id AND a.artifact = b.artifact AS truth FROM f a JOIN f b ON a.case_id = b.case_id AND a.ref < b.ref)
 SELECT 'common cause' AS policy, kind, count(*) AS pairs, round(avg((lk.a IS NOT NULL)::INT), 6) AS merged, count(*) FILTER (lk.a IS NOT NULL AND NOT truth) AS over, count(*) FILTER (truth AND lk.a IS NULL) AS under FROM pr LEFT JOIN lk ON lk.a = pr.a AND lk.b = pr.b GROUP BY kind"""
)
def agg28_merge_rates_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of observations of a case by kind: how many were merged, wrongly or not. A case has eight observations."""
    f = findings(spark, sf_dir).select("case_id", "ref", "agent", "capture_id", "artifact")
    a, b = f.alias("a"), f.alias("b")
    kind = F.when(F.col("a.agent") == F.col("b.agent"), "one agent").otherwise("two agents")
    truth = (F.col("a.capture_id") == F.col("b.capture_id")) & (F.col("a.artifact") == F.col("b.artifact"))
    pairs = a.join(b, [F.col("a.case_id") == F.col("b.case_id"), F.col("a.ref") < F.col("b.ref")]).select(F.col("a.ref").alias("a"), F.col("b.ref").alias("b"), kind.alias("kind"), truth.alias("truth"))
    said = E.common_cause_links(findings(spark, sf_dir), [f"f{i}" for i in range(9)]).select("a", "b", F.lit(True).alias("s"))
    j = pairs.join(said, ["a", "b"], "left").select(F.lit("common cause").alias("policy"), "kind", "truth", F.coalesce("s", F.lit(False)).alias("said"))
    return rounded(E.merge_rates(j))


@query(
    f"""{FS}, c AS (SELECT DISTINCT case_id, CASE WHEN case_id * 7 % 5 < 2 THEN 'phishing' ELSE 'benign' END AS label FROM f), x AS (SELECT c.case_id, label, k.field, k.field IN (SELECT g.field FROM f g WHERE g.case_id = c.case_id) AS available FROM c, (SELECT unnest(['f0', 'f1', 'f2', 'f3', 'f4', 'f5', 'f6', 'f7', 'f8']) AS field) k)
 SELECT field, round(avg(available::INT) FILTER (label = 'phishing'), 6) AS phishing, round(avg(available::INT) FILTER (label = 'benign'), 6) AS benign, abs(avg(available::INT) FILTER (label = 'phishing') - avg(available::INT) FILTER (label = 'benign')) >= 0.05 AS flagged FROM x GROUP BY field"""
)
def agg11_availability_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field is available in the cases of either label, and fields where that differs by five hundredths."""
    got = findings(spark, sf_dir).groupBy("case_id").agg(F.collect_set("field").alias("have"))
    every = F.explode(F.array(*(F.lit(f"f{i}") for i in range(9)))).alias("field")
    rows = got.select("case_id", "have", every).select("field", F.array_contains("have", F.col("field")).alias("available"), F.when(F.col("case_id") * 7 % 5 < 2, "phishing").otherwise("benign").alias("label"))
    return rounded(E.availability_gaps(rows, 0.05))


@query(
    r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Subject: Hi, you!' || chr(10) || 'go http : / / a.example.com/x,y now. ' || text WHEN 1 THEN 'mail x.y@z.com: ' || text ELSE text END AS text FROM documents),
 a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '(?m)^\s*(?:subject|re|fwd?)\s*:\s*', '', 'g'), '(https?) ?: ?/ ?/ ?', '\1://', 'g'), '[\w.+-]+\s*@\s*[\w-]+(\s*\.\s*[\w-]+)+', ' ', 'g') AS t FROM t),
 b AS (SELECT doc_id, regexp_extract_all(t, 'https?://\S+') AS u, string_split_regex(t, 'https?://\S+') AS p FROM a), c AS (SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: regexp_replace(p[i], '([,.;:!?])', ' \1 ', 'g') || coalesce(u[i], '')), '') AS t FROM b)
 SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(t, '[ 	]+', ' ', 'g'), ' ?
 ?', chr(10), 'g'))) AS sha FROM c"""
)
def txt5_canonical_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in one form: urls whole and untouched, addresses and markers gone, punctuation spaced."""
    k, t = F.col("doc_id") % 3, F.col("text")
    t = F.when(k == 0, F.concat(F.lit("Subject: Hi, you!\ngo http : / / a.example.com/x,y now. "), t)).when(k == 1, F.concat(F.lit("mail x.y@z.com: "), t)).otherwise(t)
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(texts.canonical_message(t), 256).alias("sha"))


@query(
    f"""{FS}, s AS (SELECT case_id, list_sort(list(DISTINCT field) FILTER (direction = 'phishing')) AS a, list_sort(list(DISTINCT field) FILTER (direction = 'benign')) AS b FROM f GROUP BY case_id), t AS (SELECT case_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
 SELECT case_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS only_bad, list_has_all(a, b) AS covers, list_has_any(a, b) AS meet FROM t"""
)
def set5_field_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of either side of a case: union, intersection, difference, inclusion."""
    sides = [F.collect_set(F.when(F.col("direction") == s, F.col("field"))).alias(n) for s, n in (("phishing", "a"), ("benign", "b"))]
    t = findings(spark, sf_dir).groupBy("case_id").agg(*sides)
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return t.select(
        "case_id", text(F.array_union("a", "b")).alias("either"), text(F.array_intersect("a", "b")).alias("both"), text(F.array_except("a", "b")).alias("only_bad"), (F.size(F.array_except("b", "a")) == 0).alias("covers"),
        F.arrays_overlap("a", "b").alias("meet"),
    )
