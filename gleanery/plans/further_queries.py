"""Queries for manifests, captures, guards, projections, summaries, similarity groups, augmentation and re-chosen thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import pages as P
from gleanery.functions import texts, urls
from gleanery.operators import corpus, evidence, learning, paired, similarity
from gleanery.operators.graph import connected_components
from gleanery.plans.corpus_queries import HOST
from gleanery.plans.evidence_queries import FS, GROUPS, SUPPORT
from gleanery.plans.learning_queries import COLUMNS, FOLDS, features
from gleanery.plans.registry import query, rounded
from gleanery.plans.score_queries import DM
from gleanery.plans.tables import cases, decisions, findings
from gleanery.sources.shared import materialize, new_path
from gleanery.sources.tables import read_table


@query(f"{DM} SELECT split, label, count(*) AS n, min(observed) AS first FROM m GROUP BY ALL")
def src5_manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as JSON lines and back, by an explicit schema with its map and array fields."""
    path = new_path(spark, "manifest")
    m = cases(spark, sf_dir).withColumns({"group_keys": F.array("grp", "stratum"), "post_cutoff": corpus.after_cutoff(F.col("observed"), [("a", "2023-12")])})
    m.write.json(path)
    back = spark.read.schema("case_id long, label string, split string, observed date, group_keys array<string>, post_cutoff map<string, boolean>").json(path)
    return back.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.min("observed").alias("first"))


@query(f"{FS} SELECT case_id FROM f GROUP BY case_id HAVING bool_or(field = 'f0') AND bool_or(field = 'f1')")
def src8_complete_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that hold all required entries."""
    need = [F.bool_or(F.col("field") == x).alias(x) for x in ("f0", "f1")]
    return findings(spark, sf_dir).groupBy("case_id").agg(*need).where("f0 and f1").select("case_id")


@query("WITH v AS (SELECT doc_id, sha256(text) AS was, sha256(CASE WHEN source = 'src1' THEN text || '!' ELSE text END) AS now FROM documents WHERE source <> 'src2') SELECT CASE WHEN was = now THEN 'same' ELSE 'modified' END AS state, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT 'missing', count(*) FROM documents WHERE source = 'src2'")
def snk6_checksum_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored checksums against what is there now: same, modified, missing. One source is changed and one removed on purpose."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    stored = d.select("doc_id", F.sha2("text", 256).alias("was"))
    now = d.where("source <> 'src2'").select("doc_id", F.sha2(F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("now"))
    j = stored.join(now, "doc_id", "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was") == F.col("now"), "same").otherwise("modified")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{FS}, k(artifact, field) AS (VALUES ('art0', 'f0'), ('art0', 'f1'), ('art1', 'f2'), ('art2', 'f3')) SELECT f.case_id, f.ref, f.field FROM f JOIN k ON f.artifact = k.artifact AND f.field = k.field")
def fil12_applicable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that apply to the kind of submission, by a small fixed table."""
    k = spark.sql("SELECT col1 AS artifact, col2 AS field FROM VALUES ('art0', 'f0'), ('art0', 'f1'), ('art1', 'f2'), ('art2', 'f3')")
    return findings(spark, sf_dir).join(F.broadcast(k), ["artifact", "field"]).select("case_id", "ref", "field")


@query(f"{FS} SELECT case_id, ref, agent, field, entity FROM f WHERE direction <> 'neutral'")
def fil16_judgment_free_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge may see: no direction, no strength."""
    return findings(spark, sf_dir).where("direction <> 'neutral'").select("case_id", "ref", "agent", "field", "entity")


@query("SELECT page_id, len(CASE WHEN len(html) > 1000 THEN substr(html, 1, 1000 - strpos(reverse(substr(html, 1, 1000)), '>') + 1) || '[cut]' ELSE html END) AS kept FROM pages")
def htm6_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages shortened at a tag end, with a notice, to a budget of characters."""
    return read_table(spark, sf_dir, "pages").select("page_id", F.length(P.truncate_html(F.col("html"), 1000)).cast("long").alias("kept"))


@query(r"WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x: x NOT IN ('that', 'with', 'from', 'this'))) AS entities, list_contains(w, 'clown') AS named FROM w")
def txt3_entity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0)))
    stop = F.array(*map(F.lit, ("that", "with", "from", "this")))
    d = read_table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    return d.select("doc_id", F.size(F.array_except("w", stop)).cast("long").alias("entities"), F.array_contains("w", "clown").alias("named"))


COSINE = r"""w AS (SELECT doc_id, doc_id // 8 AS case_id, regexp_extract_all(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
 s AS (SELECT *, array_to_string(w, ' ') AS s FROM w),
 t AS (SELECT doc_id, case_id, unnest(list_transform(w, lambda x: 'w:' || x) || list_transform(range(1, len(w)), lambda i: 'b:' || w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(s) - 2), lambda i: 'c:' || s[i:i + 3])) AS term FROM s),
 c AS (SELECT doc_id, case_id, term, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id),
 l AS (SELECT a.case_id, a.doc_id AS a, b.doc_id AS b FROM c a JOIN c b ON a.case_id = b.case_id AND a.term = b.term AND a.doc_id < b.doc_id JOIN m x ON x.doc_id = a.doc_id JOIN m y ON y.doc_id = b.doc_id GROUP BY a.case_id, a.doc_id, b.doc_id, x.norm, y.norm HAVING sum(a.n * b.n) / (x.norm * y.norm) >= 0.15)"""


@query(f"WITH RECURSIVE {COSINE}, e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), r(node, reach) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x) SELECT node // 8 AS case_id, node, min(reach) AS component FROM r GROUP BY node")
def gra4_evd17_similarity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of observations within a case, eight documents here: components of pairs whose counts of words, bigrams and runs of four
    characters have a cosine of 0.15 or more."""
    words = F.array_join(texts.semantic_words(F.col("text")), " ").alias("words")
    docs = read_table(spark, sf_dir, "documents").select(F.expr("doc_id div 8").alias("case_id"), "doc_id", words)
    groups = connected_components(similarity.similar_within(docs, "case_id", "doc_id", "words", 0.15), "a", "b")
    return groups.select(F.expr("node div 8").alias("case_id"), "node", "component")


@query(f"{FS}, g AS (SELECT case_id, capture_id, entity, list_sort(list(ref)) AS refs FROM f GROUP BY ALL HAVING count(*) >= 2) SELECT case_id, entity, len(refs) AS members, refs[1] AS first FROM g")
def evd30_exact_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evidence.shared_groups(findings(spark, sf_dir), "entity")
    return g.select("case_id", "entity", F.size("refs").cast("long").alias("members"), F.element_at("refs", 1).alias("first"))


@query()
def mld10_mld13_feature_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold log loss of three feature subsets, with a row more for each document and set of withheld evidence: its raw
    features are derived again without that evidence, and standardised with all others."""
    raw = corpus.folds(features(spark, sf_dir), "source", len(FOLDS), "f")
    for held in (["stars", "pipes"], ["digits", "upper"], ["log_length"]):
        raw = raw.unionByName(corpus.folds(features(spark, sf_dir), "source", len(FOLDS), "f").withColumns({c: F.lit(0.0) for c in held}))
    more = materialize(learning.standardise(raw, COLUMNS), "augmented")
    rows = None
    for name, cols in (("all", COLUMNS), ("symbols", ["stars", "pipes"]), ("shape", ["log_length", "digits", "upper"])):
        oof = learning.out_of_fold(learning.assemble(more, cols), FOLDS, 0.01)
        one = oof.agg(F.round(learning.log_loss(F.col("p"), F.col("y")), 4).alias("loss")).withColumn("subset", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


#: As many as the reference draws.
RESAMPLES = 2000


@query()
def sta2_bootstrap_with_rechosen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per resample, the false positive rate at the threshold that the resample itself gives recall 0.9. Cases of one label and score
    are drawn together; what a resample's window orders are its distinct scores."""
    d = decisions(spark, sf_dir).where("arm = 'a0' and score is not null").groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"))
    return rounded(paired.rechosen_rates(paired.class_draws(materialize(d, "classes"), "n", RESAMPLES, "a"), 0.9))


@query()
def sta3_two_sample_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change in accuracy between two strata, each resampled by a stream of draws of its own."""
    d = decisions(spark, sf_dir).where("arm = 'a0'").withColumn("ok", (F.col("verdict") == F.col("label")).cast("double"))
    means = []
    for s in ("s0", "s1"):
        kinds = d.where(F.col("stratum") == s).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))
        t = paired.class_draws(materialize(kinds, "classes"), "n", RESAMPLES, s)
        means.append(t.groupBy("b").agg((F.sum(F.col("k") * F.col("ok")) / F.sum("k")).alias(s)))
    return means[0].join(means[1], "b").select("b", F.round(F.col("s1") - F.col("s0"), 6).alias("delta"))


@query("SELECT CASE event_type WHEN 'click' THEN 'phishing' WHEN 'signup' THEN 'phishing' WHEN 'view' THEN 'benign' WHEN 'purchase' THEN 'benign' END AS label, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def fil2_label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source labels mapped, out-of-scope ones dropped."""
    label = F.when(F.col("event_type").isin("click", "signup"), "phishing").when(F.col("event_type").isin("view", "purchase"), "benign")
    return read_table(spark, sf_dir, "events").select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
