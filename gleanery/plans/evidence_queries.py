"""Evidence queries: findings, dependency groups, issues, selection, budgets and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import evidence as E
from gleanery.operators.graph import connected_components
from gleanery.plans.registry import query, rounded
from gleanery.plans.tables import FINDINGS_SQL, findings
from gleanery.sources.tables import read_table

FS = f"WITH {FINDINGS_SQL} "
SUPPORT = """o AS (SELECT case_id, direction AS side, count(DISTINCT field) AS breadth, max(strength) AS top FROM f WHERE direction <> 'neutral' GROUP BY ALL),
 a AS (SELECT case_id, CASE direction WHEN 'phishing' THEN 'benign' ELSE 'phishing' END AS side, field, max(strength) AS most FROM f WHERE direction <> 'neutral' GROUP BY ALL),
 s AS (SELECT o.*, (SELECT count(*) FROM a WHERE a.case_id = o.case_id AND a.side = o.side AND most >= top) AS opposition FROM o)"""
BAND = """CASE WHEN top IS NULL THEN 'none' WHEN top = 3 AND breadth >= 2 AND opposition = 0 THEN 'decisive' WHEN opposition = 0 AND (top = 3 OR (top = 2 AND breadth >= 2)) THEN 'strong'
 WHEN top = 2 AND opposition = 0 THEN 'suggestive' ELSE 'thin' END"""
GROUPS = "g AS (SELECT case_id, capture_id, artifact, list_sort(list(ref)) AS refs FROM f GROUP BY ALL HAVING count(*) >= 2), dis AS (SELECT DISTINCT case_id, unnest(refs[2:]) AS ref FROM g)"
LINKS = "lk AS (SELECT a.case_id, a.ref AS a, b.ref AS b FROM f a JOIN f b ON a.case_id = b.case_id AND a.capture_id = b.capture_id AND a.entity = b.entity AND a.ref < b.ref AND a.artifact <> b.artifact)"


@query(f"{FS}, {SUPPORT} SELECT * FROM s")
def agg19_breadth_strength_opposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.support(findings(spark, sf_dir))


@query(f"{FS}, {SUPPORT} SELECT case_id, side, {BAND} AS band FROM s")
def evd13_confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.support(findings(spark, sf_dir))
    return s.select("case_id", "side", E.band(F.col("top"), F.col("breadth"), F.col("opposition")).alias("band"))


@query(
    f"""{FS}, c AS (SELECT case_id, count(DISTINCT field) FILTER (direction = 'phishing') AS phishing, count(DISTINCT field) FILTER (direction = 'benign') AS benign FROM f GROUP BY case_id)
 SELECT *, CASE WHEN phishing > benign THEN 'phishing' WHEN benign > phishing THEN 'benign' ELSE 'neutral' END AS verdict FROM c"""
)
def evd11_preliminary_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.preliminary(findings(spark, sf_dir))


@query(f"{FS}, {GROUPS} SELECT case_id, ref FROM dis")
def evd18_discounted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.discounted(E.shared_groups(findings(spark, sf_dir), "artifact"))


@query(f"{FS}, {LINKS} SELECT case_id, a, b FROM lk")
def evd15_join8_common_cause_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.common_cause_links(findings(spark, sf_dir), [f"f{i}" for i in range(9)])


@query(
    f"""WITH RECURSIVE {FINDINGS_SQL}, {LINKS}, e AS (SELECT a AS x, b AS y FROM lk UNION SELECT b, a FROM lk), r(node, reach) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x)
 SELECT node, min(reach) AS component FROM r GROUP BY node"""
)
def gra2_components_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = E.common_cause_links(findings(spark, sf_dir), [f"f{i}" for i in range(9)])
    return connected_components(links, "a", "b")


@query(
    f"""{FS}, c AS (SELECT case_id, count(DISTINCT direction) AS k, string_agg(DISTINCT field, ',' ORDER BY field) AS fields, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents FROM f WHERE direction <> 'neutral' GROUP BY case_id)
 SELECT case_id, fields, agents FROM c WHERE k = 2"""
)
def evd19_conflict_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conflict_issues(findings(spark, sf_dir))


@query(
    f"""{FS}, h AS (SELECT DISTINCT case_id, 'f' || ((ref + 1) % 9) AS field FROM f), l AS (SELECT h.case_id, h.field FROM h ANTI JOIN f ON h.case_id = f.case_id AND h.field = f.field)
 SELECT case_id, string_agg(field, ',' ORDER BY field) AS fields FROM l GROUP BY case_id"""
)
def evd20_unexamined_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return E.unexamined(f, f.select("case_id", F.concat(F.lit("f"), (F.col("ref") + 1) % 9).alias("field")))


@query(
    f"{FS}, c AS (SELECT case_id, field || ':' || direction || ':' || strength AS key, count(*) AS n FROM f GROUP BY ALL) SELECT case_id, string_agg(key || '=' || n, ';' ORDER BY key) AS histogram FROM c GROUP BY case_id"
)
def agg18_feature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = E.feature_histogram(findings(spark, sf_dir))
    pairs = F.array_sort(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return h.select("case_id", F.array_join(pairs, ";").alias("histogram"))


GATE = """q AS (SELECT case_id, count(DISTINCT field) AS seen, count(DISTINCT field) FILTER (direction = 'phishing') AS p, count(DISTINCT field) FILTER (direction = 'benign') AS b, avg(strength) AS st FROM f GROUP BY case_id),
 gt AS (SELECT case_id, seen / 9 AS cov, coalesce(greatest(p, b) / nullif(p + b, 0), 0) AS agr, least(1, greatest(p, b) / 2) AS suf, p > 0 AND b > 0 AS conf, st / 3 AS sol FROM q)"""


@query(
    f"""{FS}, {GROUPS}, c AS (SELECT case_id, count(DISTINCT field) / 9 AS coverage FROM f GROUP BY case_id),
 l AS (SELECT f.case_id, count(DISTINCT field) FILTER (direction = 'phishing') AS phishing, count(DISTINCT field) FILTER (direction = 'benign') AS benign FROM f ANTI JOIN dis ON f.case_id = dis.case_id AND f.ref = dis.ref GROUP BY 1),
 o AS (SELECT case_id, coverage, coalesce(phishing, 0) AS phishing, coalesce(benign, 0) AS benign, CASE WHEN coverage < 0.4 THEN 'insufficient' WHEN phishing >= 2 AND benign >= 2 THEN 'contested' WHEN phishing >= 2 OR benign >= 2 THEN 'decided' ELSE 'insufficient' END AS outcome FROM c LEFT JOIN l USING (case_id))
 SELECT case_id, round(coverage, 6) AS coverage, phishing, benign, outcome, CASE WHEN outcome <> 'decided' THEN CASE WHEN phishing >= 2 AND benign >= 2 THEN 'contested' WHEN phishing + benign = 0 THEN 'undirected' ELSE 'insufficient support' END END AS cause FROM o"""
)
def evd27_evd28_evd29_bounded_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return rounded(E.bounded_conclusion(f, E.discounted(E.shared_groups(f, "artifact")), 9, 0.4))


SUBSETS = "SELECT bits AS subset, 'agent' || i AS agent, i + 1 AS cost FROM range(1, 32) b(bits), range(0, 5) a(i) WHERE (bits >> i) & 1 = 1"


@query(
    f"""{FS}, su AS ({SUBSETS}), sz AS (SELECT subset, sum(cost) AS cost FROM su GROUP BY subset HAVING sum(cost) <= 8),
 v AS (SELECT case_id, subset, sum(weight) AS covered FROM (SELECT DISTINCT case_id, subset, field, 1 AS weight FROM f JOIN su USING (agent) JOIN sz USING (subset)) GROUP BY ALL),
 w AS (SELECT case_id, v.subset, covered - 0.25 * cost AS value, cost FROM v JOIN sz USING (subset))
 SELECT case_id, arg_min(subset, (-value, cost, subset)) AS subset, round(max(value), 6) AS value FROM w GROUP BY case_id"""
)
def evd8_evd9_best_agent_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents cover the fields they report on; the 31 subsets of five agents are a fixed table."""
    bits = spark.range(1, 32).select(F.col("id").alias("subset"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    bits = bits.where("(subset & shiftleft(1, i)) <> 0").select("subset", F.concat(F.lit("agent"), "i").alias("agent"), (F.col("i") + 1).alias("cost"))
    cover = findings(spark, sf_dir).select("case_id", "agent", F.col("field").alias("trigger"), F.lit(1).alias("weight")).distinct()
    return rounded(E.best_subset(cover, bits, 8, 0.25))


SERVE = """tr AS (SELECT case_id, field, pos AS attempt, strength = 1 AS transient, agent = 'agent0' AS inapplicable, instrument = 'ins0' AS withheld, CASE WHEN direction = 'neutral' THEN 'timeout' END AS failure, CASE WHEN artifact <> 'art0' THEN entity END AS content FROM f),
 sv AS (SELECT *, CASE WHEN transient AND attempt = 1 THEN 'transient failure' WHEN inapplicable THEN 'inapplicable' WHEN withheld THEN 'withheld' WHEN failure IS NOT NULL THEN 'failed' WHEN content IS NULL THEN 'not captured' ELSE 'obtained' END AS status FROM tr)"""


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return E.serve(
        f.select(
            "case_id", "field", F.col("pos").alias("attempt"), (F.col("strength") == 1).alias("transient"), (F.col("agent") == "agent0").alias("inapplicable"),
            (F.col("instrument") == "ins0").alias("withheld"), F.when(F.col("direction") == "neutral", "timeout").alias("failure"), F.when(F.col("artifact") != "art0", F.col("entity")).alias("content"),
        )
    )


@query(f"{FS}, {SERVE} SELECT case_id, field, attempt, status, CASE WHEN status = 'obtained' THEN content END AS content FROM sv")
def fil9_evidence_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(spark, sf_dir).select("case_id", "field", "attempt", "status", "content")


@query(f"""{FS}, {SERVE}, l AS (SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY attempt DESC) AS i FROM sv)
 SELECT case_id, field, status, CASE WHEN status = 'obtained' THEN content END AS content FROM l WHERE i = 1""")
def evd2_latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest_attempt(_served(spark, sf_dir))


@query(
    f"""{FS}, {SERVE}, st AS (SELECT *, CASE WHEN status = 'obtained' OR attempt = 3 THEN content END AS stored FROM sv)
 SELECT status, count(*) AS n, count(*) FILTER (status <> 'obtained' AND stored IS NOT NULL) AS leaked, count(*) FILTER (withheld AND status = 'inapplicable') AS turned FROM st GROUP BY status"""
)
def fil11_withholding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations in a store that served too much on its third attempts: content beside a status that has none, and withheld
    fields that count as inapplicable."""
    served = _served(spark, sf_dir)
    raw = findings(spark, sf_dir).select("case_id", F.col("pos").alias("attempt"), F.when(F.col("artifact") != "art0", F.col("entity")).alias("kept"))
    stored = served.join(raw, ["case_id", "attempt"]).withColumn("content", F.when(F.col("attempt") == 3, F.col("kept")).otherwise(F.col("content")))
    return E.withholding_violations(stored)


CONDITIONS = "c(name, withheld) AS (VALUES ('base', []), ('no html', ['f1', 'f2']), ('url only', ['f1', 'f2', 'f3', 'f4', 'f5', 'f6', 'f7', 'f8']))"


@query(
    f"""{FS}, {CONDITIONS}, k AS (SELECT name, case_id, field, direction FROM f, c WHERE NOT list_contains(withheld, field)),
 b AS (SELECT case_id, count(DISTINCT field) AS base FROM f GROUP BY case_id), n AS (SELECT name, case_id, count(DISTINCT field) AS got FROM k GROUP BY ALL)
 SELECT name, count(*) AS cases, round(avg(got / 9), 6) AS coverage, round(avg((base - got) / base), 6) AS loss FROM n JOIN b USING (case_id) GROUP BY name"""
)
def fil10_agg23_ablation_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three named conditions, each withholding fields; the table of conditions is fixed."""
    rows = [("base", []), ("no html", ["f1", "f2"]), ("url only", [f"f{i}" for i in range(1, 9)])]
    items = [F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, w)).cast("array<string>").alias("withheld")) for n, w in rows]
    c = spark.range(1).select(F.explode(F.array(*items)).alias("c")).select("c.*")
    f = findings(spark, sf_dir).select("case_id", "field")
    left = f.distinct().crossJoin(F.broadcast(c)).where(~F.array_contains("withheld", F.col("field")))
    got = left.groupBy("name", "case_id").agg(F.count(F.lit(1)).alias("got"))
    base = f.groupBy("case_id").agg(F.count_distinct("field").alias("base"))
    j = got.join(base, "case_id").groupBy("name")
    return rounded(j.agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col("got") / 9).alias("coverage"), F.avg((F.col("base") - F.col("got")) / F.col("base")).alias("loss")))


@query(
    f"""{FS}, r AS (SELECT case_id, capture_id, list_sort(list(DISTINCT field)) AS fields FROM f GROUP BY ALL), n AS (SELECT *, lead(fields) OVER (PARTITION BY case_id ORDER BY capture_id) AS nxt FROM r)
 SELECT case_id, capture_id, len(list_filter(nxt, lambda x: NOT list_contains(fields, x))) AS added, len(list_filter(fields, lambda x: NOT list_contains(nxt, x))) AS resolved FROM n WHERE nxt IS NOT NULL"""
)
def win21_round_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = findings(spark, sf_dir).groupBy("case_id", "capture_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    n = r.withColumn("nxt", F.lead("fields").over(Window.partitionBy("case_id").orderBy("capture_id"))).where("nxt is not null")
    return n.select("case_id", "capture_id", F.size(F.array_except("nxt", "fields")).cast("long").alias("added"), F.size(F.array_except("fields", "nxt")).cast("long").alias("resolved"))


@query(
    f"""{FS}, {LINKS}, {GROUPS}, pt AS (SELECT a.case_id, a.ref AS a, b.ref AS b FROM f a JOIN f b ON a.case_id = b.case_id AND a.ref < b.ref AND a.capture_id = b.capture_id AND a.artifact = b.artifact),
 j AS (SELECT coalesce(pt.case_id, lk.case_id) AS c, pt.a IS NOT NULL AS truth, lk.a IS NOT NULL AS said FROM pt FULL JOIN lk ON pt.a = lk.a AND pt.b = lk.b)
 SELECT 'common cause' AS policy, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (truth AND NOT said) AS fn,
 round(count(*) FILTER (truth AND said) / nullif(count(*) FILTER (said), 0), 6) AS precision, round(count(*) FILTER (truth AND said) / nullif(count(*) FILTER (truth), 0), 6) AS recall FROM j"""
)
def agg28_join9_pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).select("case_id", "ref", "capture_id", "artifact")
    a, b = f.alias("a"), f.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("case_id", "capture_id", "artifact")]
    truth = a.join(b, [*same, F.col("a.ref") < F.col("b.ref")]).select(F.col("a.ref").alias("a"), F.col("b.ref").alias("b"), F.lit(True).alias("t"))
    said = E.common_cause_links(findings(spark, sf_dir), [f"f{i}" for i in range(9)]).select("a", "b", F.lit(True).alias("s"))
    no = F.lit(False)
    j = truth.join(said, ["a", "b"], "full_outer").select(F.lit("common cause").alias("policy"), F.coalesce("t", no).alias("truth"), F.coalesce("s", no).alias("said"))
    return rounded(E.pair_metrics(j))


@query(f"{FS}, q AS (SELECT case_id, list_sort(list(DISTINCT field)) AS have FROM f WHERE direction <> 'neutral' GROUP BY case_id) SELECT case_id, list_contains(have, 'f0') AND list_contains(have, 'f1') AS complete, CASE WHEN list_contains(have, 'f0') AND list_contains(have, 'f1') THEN 'A' ELSE 'B' END AS route FROM q")
def fil14_mld11_complete_evidence_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = findings(spark, sf_dir).where("direction <> 'neutral'").groupBy("case_id").agg(F.collect_set("field").alias("have"))
    full = F.size(F.array_except(F.array(F.lit("f0"), F.lit("f1")), "have")) == 0
    return have.select("case_id", full.alias("complete"), F.when(full, "A").otherwise("B").alias("route"))


