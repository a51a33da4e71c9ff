"""Queries for brand joins, conflicts, lineage, issues, further audits and run statistics, and sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import texts, urls
from gleanery.operators import brands, metrics, paired
from gleanery.plans.corpus_queries import HOST, _sited
from gleanery.plans.evidence_queries import FS, GROUPS, LINKS
from gleanery.plans.registry import query, rounded
from gleanery.plans.score_queries import BOOT, COUNTS, D, DM
from gleanery.plans.tables import cases, decisions, findings
from gleanery.sources.shared import new_path
from gleanery.sources.tables import read_table
from gleanery.streaming import ledger

SITE = f"list_extract(string_split({HOST}, '.'), -3)"


@query(f"WITH l AS (SELECT DISTINCT {SITE} AS a FROM pages) SELECT x.a AS a, y.a AS b FROM l x JOIN l y ON x.a <> y.a AND damerau_levenshtein(x.a, y.a) = 1")
def join13_look_alike_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select(F.element_at(F.split(urls.host_of(F.col("url")), r"\."), -3).alias("a"))
    return brands.look_alikes(p, p.withColumnRenamed("a", "b"), "a", "b")


BRANDS = "(VALUES ('bets', ['bets.com']), ('casino', ['example.org']), ('pills', ['pills.com', 'example.com']), ('track', ['track.io']))"


def _brands(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT col1 AS word, col2 AS domains FROM VALUES ('bets', array('bets.com')), ('casino', array('example.org')), ('pills', array('pills.com', 'example.com')), ('track', array('track.io'))")


@query(
    f"""WITH b(word, domains) AS {BRANDS}, p AS (SELECT page_id, {HOST} AS host FROM pages), q AS (SELECT page_id, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS own,
 unnest(list_distinct(string_split_regex(host, '[^a-z0-9]+'))) AS word FROM p) SELECT page_id, own, word FROM q JOIN b USING (word) WHERE NOT list_contains(domains, own)"""
)
def join12_brand_in_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _sited(spark, sf_dir).select("page_id", F.col("registrable").alias("own"), F.array_distinct(F.split("host", "[^a-z0-9]+")).alias("tokens"))
    return brands.named_elsewhere(p, "tokens", "own", F.broadcast(_brands(spark))).select("page_id", "own", "word")  # four brands


@query(f"{FS}, a AS (SELECT unnest(['agent0', 'agent1', 'agent2', 'agent3', 'agent4']) AS agent), w AS (SELECT DISTINCT case_id, agent FROM (SELECT DISTINCT case_id FROM f), a), l AS (SELECT w.case_id, w.agent FROM w ANTI JOIN f ON w.case_id = f.case_id AND w.agent = f.agent), o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY agent) AS i FROM l) SELECT case_id, string_agg(agent, ',' ORDER BY agent) AS never, string_agg(agent, ',' ORDER BY agent) FILTER (i <= 2) AS targets FROM o GROUP BY case_id")
def evd22_never_dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents that never ran on a case, and the first two as the next round's targets."""
    every = F.array(*[F.lit(f"agent{i}") for i in range(5)])
    g = findings(spark, sf_dir).groupBy("case_id").agg(F.collect_set("agent").alias("ran"))
    never = F.array_sort(F.array_except(every, "ran"))
    return g.where(F.size(never) > 0).select("case_id", F.array_join(never, ",").alias("never"), F.array_join(F.slice(never, 1, 2), ",").alias("targets"))


@query(f"{D} SELECT arm, case_id, (row_number() OVER (PARTITION BY arm, ('0x' || substr(md5(CAST(case_id AS VARCHAR)), 1, 2))::BIGINT ORDER BY case_id) - 1) % 4 AS shard FROM d")
def win15_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work shards: rows dealt in turn inside each hash bucket, so no task orders all rows."""
    bucket = F.conv(F.substring(F.md5(F.col("case_id").cast("string")), 1, 2), 16, 10).cast("long")
    i = F.row_number().over(Window.partitionBy("arm", bucket).orderBy("case_id")) - 1
    return decisions(spark, sf_dir).select("arm", "case_id", (i % 4).cast("long").alias("shard"))


@query(f"{FS} SELECT case_id, ref, field || CASE WHEN i > 0 THEN '.' || i ELSE '' END AS locator FROM (SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY pos) - 1 AS i FROM f)")
def win16_occurrence_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("case_id", "field").orderBy("pos")) - 1
    name = F.concat("field", F.when(i > 0, F.concat(F.lit("."), i)).otherwise(""))
    return findings(spark, sf_dir).select("case_id", "ref", name.alias("locator"))


@query(
    f"""{D}, c AS (SELECT arm, {COUNTS} FROM d GROUP BY arm), r AS (SELECT arm, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + fp + tn + fn) / n AS coverage FROM c), z AS (SELECT f1 AS base FROM r WHERE arm = 'a0')
 SELECT arm, round(f1 - base, 6) AS delta, f1 - base > -0.03 AS within_margin, coverage >= 0.5 AS covers, CASE WHEN f1 - base > 0.001 THEN 'WIN' WHEN f1 - base < -0.001 THEN 'LOSS' ELSE 'TIE' END AS reading FROM r, z"""
)
def sta8_sta10_sta12_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm against the full one: margins, coverage and the reading, one row an arm."""
    r = metrics.rates(metrics.confusion(decisions(spark, sf_dir), ["arm"]))
    base = r.where("arm = 'a0'").select(F.col("f1").alias("base"))
    d = F.col("f1") - F.col("base")
    reading = F.when(d > 0.001, "WIN").when(d < -0.001, "LOSS").otherwise("TIE")
    j = r.crossJoin(F.broadcast(base))  # one row
    return rounded(j.select("arm", d.alias("delta"), (d > -0.03).alias("within_margin"), (F.col("coverage") >= 0.5).alias("covers"), reading.alias("reading")))


@query("SELECT doc_id, contains(text, 'é') AS accents, CAST(length(text) - length(replace(text, chr(8203), '')) AS BIGINT) AS zero_width, 'c-' || substr(sha256(text), 1, 12) AS id FROM documents")
def hsh1_short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").select("doc_id", t.contains("é").alias("accents"), texts.obfuscation(t)["zero_width"].alias("zero_width"), F.concat(F.lit("c-"), F.substring(F.sha2(t, 256), 1, 12)).alias("id"))


@query("SELECT event_type, user_id % 4 AS shard, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def src3_json_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written as partitioned, gzipped JSON lines and read again by an explicit schema."""
    path = new_path(spark, "ledger")
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value", (F.col("user_id") % 4).alias("shard"))
    e.write.partitionBy("shard").json(path, compression="gzip")
    back = spark.read.schema("event_id long, event_type string, value double, shard long").json(path)
    return rounded(back.groupBy("event_type", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query("SELECT source, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def src7_csv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with quotes and line breaks written as CSV and read again."""
    path = new_path(spark, "messages")
    read_table(spark, sf_dir, "documents").select("doc_id", "source", "text").write.csv(path, header=True, escape='"')
    back = spark.read.schema("doc_id long, source string, text string").csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT split_part(regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1), '/', 2) AS lang, count(*) AS n, CAST(sum(len(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def src1_snk1_page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored by language, compressed, and read back with the partition column."""
    path = new_path(spark, "pages")
    p = read_table(spark, sf_dir, "pages").withColumn("lang", F.split_part(F.regexp_extract("url", r"^[^/]*//[^/?#]*([^?#]*)", 1), F.lit("/"), F.lit(2)))
    p.write.partitionBy("lang").parquet(path, compression="zstd")
    return spark.read.parquet(path).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).cast("long").alias("chars"))


@query(
    """WITH x AS (SELECT CAST(ts AS DATE) AS day, event_type, quality FROM events JOIN labels ON user_id = doc_id) SELECT day, count(*) AS n, count(*) FILTER (event_type IN ('click', 'signup') AND quality = 0) AS tp, count(*) FILTER (event_type IN ('click', 'signup') AND quality = 1) AS fp,
 count(*) FILTER (event_type NOT IN ('click', 'signup') AND quality = 1) AS tn, count(*) FILTER (event_type NOT IN ('click', 'signup') AND quality = 0) AS fn FROM x GROUP BY day"""
)
def str5_rolling_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily confusion counts of a stream joined with the labels that have arrived."""
    s = ledger.ledger_stream(spark, f"{sf_dir}/events.parquet*", read_table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    truth = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), (F.col("quality") == 0).alias("bad"))
    hit, bad = F.col("event_type").isin("click", "signup"), F.col("bad")
    t = s.withWatermark("ts", "1 day").join(truth, F.col("user_id") == F.col("k")).groupBy(F.window("ts", "1 day"))
    t = t.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in (("tp", hit & bad), ("fp", hit & ~bad), ("tn", ~hit & ~bad), ("fn", ~hit & bad))))
    return ledger.drain(t, "quality", "update", ["window"]).select(F.to_date("window.start").alias("day"), "n", "tp", "fp", "tn", "fn")
