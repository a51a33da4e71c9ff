"""Queries on guards, records and their issues, audits, roll-ups, run statistics, adoption rules and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import records as S
from gleanery.functions import numbers, replies, urls
from gleanery.operators import certificates as CT
from gleanery.operators import evidence as E
from gleanery.operators import guards, metrics, paired, ranking
from gleanery.operators import records as R
from gleanery.plans.evidence_queries import FS, LINKS
from gleanery.plans.registry import query, rounded
from gleanery.plans.score_queries import D, DM
from gleanery.plans.tables import FINDINGS_SQL, cases, decisions, findings
from gleanery.sources.tables import read_table

# --- the ledger and its guards ---------------------------------------------------------------------------------------


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger: two repeats of three arms on a case, with records and decisions on child objects among them."""
    e, u = read_table(spark, sf_dir, "events"), F.col("user_id")
    verdict = F.when(F.col("event_type").isin("click", "signup"), "phishing").when(F.col("event_type") == "error", "insufficient").otherwise("benign")
    return e.select(
        F.when(u % 7 == 0, "record").otherwise("decision").alias("kind"), F.concat(F.lit("a"), F.col("event_id") % 3).alias("arm"), F.expr("event_id div 3 % 2").alias("repeat"),
        F.expr("event_id div 6").alias("case_id"), verdict.alias("verdict"), F.when(u % 5 == 0, "o1").alias("parent_object_id"), F.lit("m1").alias("model_id"), F.lit("v1").alias("data_version"),
    )


LEDGER = """lg AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'record' ELSE 'decision' END AS kind, 'a' || (event_id % 3) AS arm, event_id // 3 % 2 AS repeat, event_id // 6 AS case_id,
 CASE WHEN event_type IN ('click', 'signup') THEN 'phishing' WHEN event_type = 'error' THEN 'insufficient' ELSE 'benign' END AS verdict, CASE WHEN user_id % 5 = 0 THEN 'o1' END AS parent_object_id FROM events)"""


@query(f"WITH {LEDGER} SELECT arm, repeat, case_id, verdict FROM lg WHERE kind = 'decision' AND parent_object_id IS NULL")
def fil3_fil4_fil19_parent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on whole cases, behind the guards: known verdicts, one decision a key, one model and data version a run."""
    d = guards.parent_decisions(ledger(spark, sf_dir))
    guards.require_domain(d, "verdict", ("phishing", "benign", "insufficient"))
    guards.require_unique(d, ["arm", "repeat", "case_id"])
    guards.require_one(d, ["arm", "repeat"], ["model_id", "data_version"])
    return d.select("arm", "repeat", "case_id", "verdict")


@query(f"{DM}, x AS (SELECT DISTINCT case_id FROM d WHERE arm = 'a1' AND stratum = 's2') SELECT x.case_id, split FROM x LEFT JOIN m ON x.case_id = m.case_id AND m.case_id % 11 <> 3 WHERE coalesce(split, '') <> 'dev'")
def fil6_split_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of one arm that are not of the declared split; the manifest lacks some. The guard refuses such rows, and takes
    those that the manifest lists for the split."""
    d, m = decisions(spark, sf_dir).where("arm = 'a1' and stratum = 's2'"), cases(spark, sf_dir).where("case_id % 11 <> 3")
    bad = guards.split_mismatches(d, m, "dev")
    guards.require_split(d.join(bad, "case_id", "left_anti"), m, "dev")
    return bad


# --- records of agents -------------------------------------------------------------------------------------------------

AGENTS = range(5)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as items of agents: most declare a field of their agent, some another; most use its tool, some another."""
    f, k = findings(spark, sf_dir), F.substring("agent", 6, 1).cast("int")
    own = F.concat(F.lit("f"), (2 * k + F.col("ref") % 3) % 9)
    tool = F.when(F.col("ref") % 17 == 0, F.col("instrument")).otherwise(F.concat(F.lit("ins"), k % 4))
    return f.select("case_id", "ref", "pos", "agent", "direction", "strength", F.when(F.col("ref") % 10 == 0, F.col("field")).otherwise(own).alias("field"), tool.alias("tool"))


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a case and agent: the items of dispatched agents, the others skipped or not dispatched; fields that the
    case obtained; one field that nobody can read."""
    i = items(spark, sf_dir)
    fields = [F.array(*(F.lit(f"f{(2 * k + j) % 9}") for j in range(3))) for k in AGENTS]
    table = [F.struct(F.lit(f"agent{k}").alias("agent"), x.alias("fields"), F.slice(x, 1, 2).alias("required"), F.array(F.lit(f"ins{k % 4}")).alias("tools")) for k, x in zip(AGENTS, fields)]
    got = F.array_compact(F.array(*(F.when((F.col("case_id") * 7 + k * 5) % 4 != 0, F.lit(f"f{k}")) for k in range(9))))
    every = i.select("case_id").distinct().select("case_id", got.alias("obtained"), F.explode(F.array(*table)).alias("a")).select("case_id", "obtained", "a.*")
    sides = [F.count_distinct(F.when(F.col("direction") == s, F.col("field"))) for s in E.SIDES]
    said = i.groupBy("case_id", "agent").agg(
        F.collect_set("field").alias("declared"), F.collect_set("tool").alias("used"), F.array_sort(F.collect_list("ref")).alias("refs"),
        F.when(sides[0] > sides[1], "phishing").when(sides[1] > sides[0], "benign").alias("leaning"),
    )
    r = every.join(said, ["case_id", "agent"], "left")
    unreadable = F.array(F.lit("f4"))
    status = R.analysis_status(F.col("required"), F.col("obtained"), unreadable)
    idle = F.when((F.col("case_id") + F.substring("agent", 6, 1).cast("int")) % 2 == 0, "skipped").otherwise("not_dispatched")
    r = r.withColumn("status", F.when(F.col("refs").isNull(), idle).otherwise(status))
    # a record without data that still reports a verdict, and one that claims to have read what it could not, are in error
    verdict = F.when(F.col("status") == "ran", F.col("leaning")).when((F.col("status") == "no_data") & (F.col("case_id") % 5 == 0), F.col("leaning"))
    seen = F.array_intersect("fields", F.array_except("obtained", unreadable))
    seen = F.when(F.col("case_id") % 13 == 0, F.array_union(seen, F.array(F.lit("f8")))).otherwise(seen)
    none = F.array()
    return r.select(
        "case_id", "agent", "fields", "required", "tools", "obtained", "status", verdict.alias("verdict"), F.when(F.col("refs").isNull(), none.cast("array<string>")).otherwise(seen).alias("examined"),
        *(F.coalesce(c, none.cast("array<string>")).alias(c) for c in ("declared", "used")), F.coalesce("refs", none.cast("array<bigint>")).alias("refs"),
    )


ITEMS = """it AS (SELECT case_id, ref, pos, agent, direction, strength, CASE WHEN ref % 10 = 0 THEN field ELSE 'f' || ((2 * CAST(substr(agent, 6, 1) AS INT) + ref % 3) % 9) END AS field,
 CASE WHEN ref % 17 = 0 THEN instrument ELSE 'ins' || (CAST(substr(agent, 6, 1) AS INT) % 4) END AS tool FROM f)"""
RECORDS = f"""{ITEMS}, ag AS (SELECT k, 'agent' || k AS agent, ['f' || (2 * k % 9), 'f' || ((2 * k + 1) % 9), 'f' || ((2 * k + 2) % 9)] AS fields, ['ins' || (k % 4)] AS tools FROM range(5) t(k)),
 ob AS (SELECT case_id, list_transform(list_filter(range(9), lambda k: (case_id * 7 + k * 5) % 4 <> 0), lambda k: 'f' || k) AS obtained FROM (SELECT DISTINCT case_id FROM it)),
 sa AS (SELECT case_id, agent, list(DISTINCT field) AS declared, list(DISTINCT tool) AS used, list(ref ORDER BY ref) AS refs, count(DISTINCT field) FILTER (direction = 'phishing') AS p, count(DISTINCT field) FILTER (direction = 'benign') AS b FROM it GROUP BY ALL),
 r1 AS (SELECT ob.case_id, ag.agent, k, fields, tools, obtained, coalesce(declared, []) AS declared, coalesce(used, []) AS used, coalesce(refs, []) AS refs, refs IS NULL AS idle, CASE WHEN p > b THEN 'phishing' WHEN b > p THEN 'benign' END AS leaning,
   list_filter(obtained, lambda x: x <> 'f4') AS readable FROM ob CROSS JOIN ag LEFT JOIN sa ON sa.case_id = ob.case_id AND sa.agent = ag.agent),
 r2 AS (SELECT *, CASE WHEN idle THEN CASE WHEN (case_id + k) % 2 = 0 THEN 'skipped' ELSE 'not_dispatched' END WHEN list_has_any(fields[1:2], readable) THEN 'ran' ELSE 'no_data' END AS st FROM r1),
 r3 AS (SELECT *, CASE WHEN st = 'ran' OR (st = 'no_data' AND case_id % 5 = 0) THEN leaning END AS said, CASE WHEN idle THEN [] WHEN case_id % 13 = 0 THEN list_concat(list_intersect(fields, readable), ['f8']) ELSE list_intersect(fields, readable) END AS examined FROM r2),
 r4 AS (SELECT *, list_filter([CASE WHEN st <> 'ran' AND said IS NOT NULL THEN 'schema_valid' END, CASE WHEN NOT list_has_all(fields, declared) THEN 'scope_valid' END,
   CASE WHEN NOT list_has_all(list_intersect(fields, obtained), examined) THEN 'basis_valid' END, CASE WHEN NOT list_has_all(tools, used) THEN 'tool_valid' END,
   CASE WHEN NOT list_has_all(obtained, declared) THEN 'locators_resolve' END], lambda x: x IS NOT NULL) AS failed FROM r3),
 rc AS (SELECT * REPLACE (CASE WHEN len(failed) > 0 THEN 'error' ELSE st END AS st, CASE WHEN len(failed) = 0 THEN said END AS said) FROM r4)"""


@query(f"{FS}, {RECORDS} SELECT case_id, agent, st AS status, said AS verdict, array_to_string(failed, ',') AS failed FROM rc")
def fil15_evd12_record_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each agent's record, the conjuncts it fails, and the verdict that is left."""
    r = R.validated(all_records(spark, sf_dir))
    return r.select("case_id", "agent", "status", "verdict", F.array_join("failed", ",").alias("failed"))


ISSUES = """vr AS (SELECT case_id, agent, unnest(refs) AS ref FROM rc WHERE st = 'ran'), vs AS (SELECT case_id, list((agent, ref) ORDER BY ref) AS every FROM vr GROUP BY case_id),
 rf AS (SELECT rc.case_id, rc.agent, list_transform(list_filter(every, lambda x: x[1] <> rc.agent), lambda x: x[2]) AS others FROM rc JOIN vs ON vs.case_id = rc.case_id),
 iss AS (SELECT rc.case_id, rc.agent, CASE st WHEN 'not_dispatched' THEN 'selection' ELSE 'coverage' END AS kind, st AS status,
   CASE st WHEN 'no_data' THEN list_sort(fields) WHEN 'not_dispatched' THEN [] ELSE list_sort(list_intersect(fields, obtained)) END AS affected, CASE WHEN st = 'skipped' THEN [] ELSE coalesce(others, []) END AS refs
   FROM rc LEFT JOIN rf ON rf.case_id = rc.case_id AND rf.agent = rc.agent WHERE st IN ('no_data', 'error', 'not_dispatched') OR (st = 'skipped' AND list_has_any(fields, obtained)))"""


@query(f"{FS}, {RECORDS}, {ISSUES} SELECT case_id, agent, kind, status, array_to_string(affected, ',') AS affected, array_to_string(refs, ',') AS refs FROM iss")
def evd21_evd22_record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = R.record_issues(R.validated(all_records(spark, sf_dir)))
    refs = F.array_join(F.transform("refs", lambda x: x.cast("string")), ",")
    return i.select("case_id", "agent", "kind", "status", F.array_join("affected", ",").alias("affected"), refs.alias("refs"))


@query(
    f"""{FS}, {RECORDS}, {ISSUES}, cf AS (SELECT case_id FROM f WHERE direction <> 'neutral' GROUP BY case_id HAVING count(DISTINCT direction) = 2), al AS (SELECT case_id FROM iss UNION ALL SELECT case_id FROM cf),
 n AS (SELECT case_id, count(*) AS issues FROM al GROUP BY case_id), g AS (SELECT case_id, count(*) FILTER (st <> 'skipped') AS considered, count(*) FILTER (st = 'ran' AND said IS NOT NULL) AS decided FROM rc GROUP BY case_id)
 SELECT g.case_id, considered, decided, coalesce(issues, 0) AS issues, round(CASE WHEN considered = 0 THEN 1.0 ELSE least(1.0, 1.0 - decided / considered + 0.25 * coalesce(issues, 0)) END, 6) AS stopping_error FROM g LEFT JOIN n ON g.case_id = n.case_id"""
)
def evd25_stopping_error_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.validated(all_records(spark, sf_dir))
    issues = R.record_issues(r).select("case_id").unionByName(E.conflict_issues(findings(spark, sf_dir)).select("case_id"))
    return rounded(R.stopping_error(r, issues))


@query(
    f"""{FS}, {RECORDS}, pr AS (SELECT case_id, agent, list(DISTINCT field) AS declared, list(DISTINCT tool) AS used, list(ref ORDER BY ref) AS refs FROM it WHERE pos >= 3 AND direction <> 'neutral' GROUP BY ALL),
 ci AS (SELECT a.case_id, a.agent, list(i.ref) AS cited FROM pr a JOIN it i ON i.case_id = a.case_id AND i.agent <> a.agent AND i.ref % 3 = 0 GROUP BY ALL),
 j AS (SELECT rc.case_id, rc.agent, len(rc.refs) AS before, len(pr.refs) AS proposed, ci.cited IS NOT NULL AND list_has_all(list_intersect(fields, obtained), pr.declared) AND list_has_all(tools, pr.used) AND list_has_all(list_intersect(fields, obtained), examined) AS accepted
   FROM rc JOIN pr ON pr.case_id = rc.case_id AND pr.agent = rc.agent LEFT JOIN ci ON ci.case_id = rc.case_id AND ci.agent = rc.agent)
 SELECT case_id, agent, accepted, CASE WHEN accepted THEN proposed ELSE before END AS items FROM j"""
)
def evd26_revision_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions proposed from each agent's later directional items, citing others' observations."""
    i, r = items(spark, sf_dir), R.validated(all_records(spark, sf_dir))
    p = i.where("pos >= 3 and direction <> 'neutral'").groupBy("case_id", "agent")
    p = p.agg(F.collect_set("field").alias("declared"), F.collect_set("tool").alias("used"), F.array_sort(F.collect_list("ref")).alias("refs"))
    others = i.where("ref % 3 = 0").select("case_id", F.col("agent").alias("who"), "ref")
    cited = p.select("case_id", "agent").join(others, "case_id").where("who <> agent").groupBy("case_id", "agent").agg(F.collect_list("ref").alias("cited"))
    p = p.join(cited, ["case_id", "agent"], "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<bigint>")))
    return R.revised(r, p).select("case_id", "agent", "accepted", F.size("final").cast("long").alias("items"))


@query(
    f"""{FS}, ln AS (SELECT case_id, ref AS borrowed, unnest([ref - 3, ref - 2, ref]) AS original FROM f WHERE pos >= 3), cu AS (SELECT case_id, ref FROM f WHERE ref % 5 <> 0)
 SELECT ln.case_id, original, borrowed FROM ln JOIN cu a ON a.ref = original JOIN cu b ON b.ref = borrowed WHERE original <> borrowed"""
)
def join18_evd16_borrowed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later observations were shown earlier ones; groups of two where both still stand, the original first."""
    f = findings(spark, sf_dir)
    lineage = f.where("pos >= 3").select("case_id", F.col("ref").alias("borrowed"), F.array(F.col("ref") - 3, F.col("ref") - 2, F.col("ref")).alias("shown"))
    return R.borrowed_groups(lineage, f.where("ref % 5 <> 0"))


# --- audits and roll-ups -----------------------------------------------------------------------------------------------


@query(
    f"""{D}, g AS (SELECT arm, case_id, label, verdict, tokens % 7 AS returned, tokens % 2 AS bad_line, CASE WHEN tokens % 3 = 0 THEN 1 ELSE 0 END AS bad_quote FROM d),
 s AS (SELECT arm, count(*) AS n, sum(returned) AS returned, sum(bad_line + bad_quote) AS dropped FROM g GROUP BY arm), z AS (SELECT case_id, verdict AS ref FROM g WHERE arm = 'a0'),
 x AS (SELECT arm, count(*) FILTER (verdict <> ref) AS changed, count(*) FILTER (verdict <> ref AND verdict = label) AS changed_right, count(*) FILTER (verdict <> ref AND verdict <> label) AS changed_wrong FROM g JOIN z USING (case_id) GROUP BY arm)
 SELECT arm, n, CAST(returned AS BIGINT) AS returned, round(dropped / greatest(1, returned), 6) AS unsupported, changed, changed_right, changed_wrong FROM s JOIN x USING (arm)"""
)
def agg25_citation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of findings returned whose citation does not hold, and verdicts changed against the full arm, by arm."""
    t = F.col("tokens")
    g = decisions(spark, sf_dir).select("arm", "case_id", "label", "verdict", (t % 7).alias("returned"), (t % 2 + F.when(t % 3 == 0, 1).otherwise(0)).alias("dropped"))
    return rounded(metrics.citation_support(g, "a0"))


@query(
    """WITH e AS (SELECT 'a' || (event_id % 3) AS arm, event_id // 12 AS case_id, event_id // 3 % 4 AS slot, user_id, event_type FROM events),
 s AS (SELECT arm, case_id, user_id % 4 AS chosen, user_id % 3 AS spare FROM e WHERE slot = 0), l AS (SELECT arm, case_id, count(*) AS later FROM e WHERE slot > 0 AND event_type IN ('click', 'view') AND user_id % 2 = 0 GROUP BY ALL),
 h AS (SELECT arm, count(*) AS shortfalls FROM e WHERE slot > 0 AND event_type = 'error' GROUP BY arm)
 SELECT s.arm, count(*) AS pages, round(avg(chosen), 6) AS initial, CAST(sum(spare) AS BIGINT) AS unselected_ready, CAST(sum(coalesce(later, 0)) AS BIGINT) AS later_dispatched, round(sum(coalesce(later, 0)) / nullif(sum(spare), 0), 6) AS recovery_share, coalesce(any_value(shortfalls), 0) AS shortfalls
 FROM s LEFT JOIN l ON l.arm = s.arm AND l.case_id = s.case_id LEFT JOIN h ON h.arm = s.arm GROUP BY s.arm"""
)
def agg26_recovery_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later dispatches of agents that were ready and not chosen, as a share of those, from the kinds of events."""
    e = read_table(spark, sf_dir, "events")
    slot = F.expr("event_id div 3 % 4")
    later = F.col("event_type").isin("click", "view")
    kind = F.when(slot == 0, "selection").when(later, "later_dispatch").when(F.col("event_type") == "error", "dispatch_shortfall").otherwise("decision")
    log = e.select(
        F.concat(F.lit("a"), F.col("event_id") % 3).alias("arm"), F.expr("event_id div 12").alias("case_id"), kind.alias("kind"), (F.col("user_id") % 4).alias("chosen"), (F.col("user_id") % 3).alias("spare"),
        F.when(F.col("user_id") % 2 == 0, "dispatched").otherwise("refused").alias("outcome"),
    )
    return rounded(metrics.recovery_share(log))


@query(
    """WITH o AS (SELECT event_id // 8 AS case_id, event_id, user_id % 4 AS dispatched, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value / 8 AS cost, user_id % 3 AS eligible, event_type = 'error' AS insufficient FROM events)
 SELECT case_id, count(*) AS objects, round(sum(cost), 6) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(dispatched) AS BIGINT) AS dispatched, CAST(sum(eligible) AS BIGINT) AS eligible, bool_or(insufficient) AS insufficient FROM o GROUP BY case_id"""
)
def agg39_case_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored unit a case: the work of its objects summed, insufficient if any of them is."""
    e = read_table(spark, sf_dir, "events")
    o = e.select(
        F.expr("event_id div 8").alias("case_id"), (F.col("value") / 8).alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("user_id") % 4).alias("dispatched"),
        (F.col("user_id") % 3).alias("eligible"), (F.col("event_type") == "error").alias("insufficient"),
    )
    return rounded(metrics.case_roll_up(o))


@query(
    f"""{FS}, s AS (SELECT case_id, agent, avg(CASE WHEN ref % 6 <> 0 THEN ref * 37 % 101 / 101 END) AS p, CASE WHEN case_id * 7 % 5 < 2 THEN 1 ELSE 0 END AS y FROM f GROUP BY case_id, agent),
 k AS (SELECT agent, y, rank() OVER (PARTITION BY agent ORDER BY p) + (count(*) OVER (PARTITION BY agent, p) - 1) / 2 AS r FROM s WHERE p IS NOT NULL),
 a AS (SELECT agent, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM k GROUP BY agent),
 n AS (SELECT agent, count(*) AS ran, count(p) / count(*) AS returned FROM s GROUP BY agent), u AS (SELECT agent, ran, returned, auc FROM n LEFT JOIN a USING (agent))
 SELECT agent, ran, round(returned, 6) AS returned, round(auc, 6) AS auc FROM u UNION ALL SELECT 'mean', CAST(sum(ran) AS BIGINT), round(avg(returned), 6), round(avg(auc), 6) FROM u"""
)
def agg40_agent_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each agent returns a score, how well its scores rank the cases, and the mean of agents."""
    f = findings(spark, sf_dir)
    p = F.avg(F.when(F.col("ref") % 6 != 0, F.col("ref") * 37 % 101 / 101))
    s = f.groupBy("case_id", "agent").agg(p.alias("p"))
    # as a map a case, as ledgers store it; agents without a score are in it with null
    m = s.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("agent", "p"))).alias("agent_p"))
    m = m.withColumn("y", F.when(F.col("case_id") * 7 % 5 < 2, 1).otherwise(0))
    return rounded(ranking.agent_auc(m, "agent_p", "y"))


@query(f"{D}, g AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.8]) AS tau), t AS (SELECT tau, count(*) FILTER (score <= tau) AS stopped, avg((verdict <> label)::INT) FILTER (score <= tau) AS error FROM d, g WHERE score IS NOT NULL AND verdict <> 'inconclusive' GROUP BY tau) SELECT coalesce(max(tau) FILTER (error <= 0.48), min(tau)) AS tau, coalesce(bool_or(error <= 0.48), false) AS met FROM t")
def win23_largest_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest threshold whose stopped states err in at most 48 of 100; the smallest of the grid where none does."""
    d = decisions(spark, sf_dir).where("score is not null and verdict <> 'inconclusive'")
    return ranking.largest_threshold(d.select("score", (F.col("verdict") != F.col("label")).alias("error")), [0.05, 0.1, 0.2, 0.3, 0.5, 0.8], 0.48)


@query(
    f"""WITH RECURSIVE {FINDINGS_SQL}, {LINKS}, pt AS (SELECT a.case_id, a.ref AS a, b.ref AS b FROM f a JOIN f b ON a.case_id = b.case_id AND a.ref < b.ref AND a.capture_id = b.capture_id AND a.artifact = b.artifact),
 nd AS (SELECT case_id, ref FROM f WHERE direction <> 'neutral'), e1 AS (SELECT lk.a AS x, lk.b AS y FROM lk JOIN nd p ON p.ref = lk.a JOIN nd q ON q.ref = lk.b UNION SELECT lk.b, lk.a FROM lk JOIN nd p ON p.ref = lk.a JOIN nd q ON q.ref = lk.b),
 e2 AS (SELECT pt.a AS x, pt.b AS y FROM pt JOIN nd p ON p.ref = pt.a JOIN nd q ON q.ref = pt.b UNION SELECT pt.b, pt.a FROM pt JOIN nd p ON p.ref = pt.a JOIN nd q ON q.ref = pt.b),
 r1(node, reach) AS (SELECT ref, ref FROM nd UNION SELECT r1.node, y FROM r1 JOIN e1 ON reach = x), r2(node, reach) AS (SELECT ref, ref FROM nd UNION SELECT r2.node, y FROM r2 JOIN e2 ON reach = x),
 c1 AS (SELECT node, min(reach) AS c FROM r1 GROUP BY node), c2 AS (SELECT node, min(reach) AS c FROM r2 GROUP BY node),
 u AS (SELECT case_id, count(DISTINCT c1.c) AS units, count(DISTINCT c2.c) AS true_units FROM nd JOIN c1 ON c1.node = ref JOIN c2 ON c2.node = ref GROUP BY case_id)
 SELECT case_id, units, true_units, greatest(0, units - true_units) AS excess, greatest(0, true_units - units) AS lost FROM u"""
)
def gra3_support_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a case's directional observations under the predicted links and under the true ones."""
    f = findings(spark, sf_dir)
    nodes = f.where("direction <> 'neutral'").select("case_id", "ref")
    said = E.common_cause_links(f, [f"f{i}" for i in range(9)]).select("a", "b")
    a, b = f.alias("a"), f.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("case_id", "capture_id", "artifact")]
    truth = a.join(b, [*same, F.col("a.ref") < F.col("b.ref")]).select(F.col("a.ref").alias("a"), F.col("b.ref").alias("b"))
    return E.support_units(nodes, said, truth)


# --- statistics over runs, adoption -------------------------------------------------------------------------------------

RESAMPLES = 2000
#: Multiplicities of the cases' signatures in each resample: draw j of resample b is a part of the hash of b and j div 4.
DRAWS = f"""nu AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(case_id AS VARCHAR)), 1, 4))::BIGINT % 256, case_id) - 1 AS no, count(*) OVER () AS n FROM sg),
 gr AS (SELECT b, g, md5(b || '|' || g) AS h FROM range({RESAMPLES}) x(b), range((SELECT (count(*) + 3) // 4 FROM nu)) y(g)),
 dr AS (SELECT b, ('0x' || substr(h, CAST(1 + 8 * i AS INTEGER), 8))::BIGINT % (SELECT count(*) FROM nu) AS no FROM gr, range(4) q(i) WHERE 4 * g + i < (SELECT count(*) FROM nu)),
 tm AS (SELECT b, no, count(*) AS k FROM dr GROUP BY ALL)"""
F1 = "2.0 * coalesce(sum(k) FILTER (label = 'phishing' AND {v} = 'phishing'), 0) / nullif(2 * coalesce(sum(k) FILTER (label = 'phishing' AND {v} = 'phishing'), 0) + coalesce(sum(k) FILTER (label = 'benign' AND {v} <> 'benign'), 0) + coalesce(sum(k) FILTER (label = 'phishing' AND {v} <> 'phishing'), 0), 0)"
INTERVAL = "iv AS (SELECT max(x) FILTER (i = CAST(floor(0.025 * n + 1e-9) AS BIGINT)) AS low, max(x) FILTER (i = CAST(floor(0.975 * n + 1e-9) AS BIGINT) - 1) AS high, avg(x) AS mean, any_value(n) AS resamples FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM bs WHERE x IS NOT NULL))"


@query(
    f"""{D}, ok AS (SELECT case_id FROM d GROUP BY case_id HAVING count(DISTINCT arm) = 3), sg AS (SELECT case_id, any_value(label) AS label, max(verdict) FILTER (arm = 'a0') AS v0, max(verdict) FILTER (arm = 'a1') AS v1, max(verdict) FILTER (arm = 'a2') AS v2,
   max(CASE WHEN score >= 0.3 THEN 'phishing' ELSE 'benign' END) FILTER (arm = 'a0') AS w0, max(CASE WHEN score >= 0.3 THEN 'phishing' ELSE 'benign' END) FILTER (arm = 'a1') AS w1, max(CASE WHEN score >= 0.3 THEN 'phishing' ELSE 'benign' END) FILTER (arm = 'a2') AS w2
   FROM d JOIN ok USING (case_id) GROUP BY case_id), {DRAWS},
 fs AS (SELECT b, {F1.format(v='v0')} AS a0, {F1.format(v='v1')} AS a1, {F1.format(v='v2')} AS a2, {F1.format(v='w0')} AS b0, {F1.format(v='w1')} AS b1, {F1.format(v='w2')} AS b2 FROM tm JOIN nu USING (no) GROUP BY b),
 bs AS (SELECT (a0 + a1 + a2) / 3 - (b0 + b1 + b2) / 3 AS x FROM fs), {INTERVAL} SELECT round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, resamples FROM iv"""
)
def sta4_mean_over_runs_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two systems' F1, each averaged over three runs, on resampled cases that all runs have."""
    d = decisions(spark, sf_dir)
    by_score = F.when(F.coalesce(F.col("score") >= 0.3, F.lit(False)), "phishing").otherwise("benign")
    runs = [F.max(F.when(F.col("arm") == f"a{i}", x)).alias(f"{n}{i}") for n, x in (("v", F.col("verdict")), ("w", by_score)) for i in range(3)]
    s = d.groupBy("case_id").agg(F.first("label").alias("label"), F.count_distinct("arm").alias("arms"), *runs).where("arms = 3").drop("arms")
    t = paired.resample(s, RESAMPLES)
    f1 = [paired.weighted_f1(c) for c in ("v0", "v1", "v2", "w0", "w1", "w2")]
    delta = (f1[0] + f1[1] + f1[2]) / 3 - (f1[3] + f1[4] + f1[5]) / 3
    return rounded(paired.spread(t.groupBy("b").agg(delta.alias("x")), "x"))


@query(
    f"""{D}, sg AS (SELECT a.case_id, a.tokens - b.tokens AS diff FROM d a JOIN d b ON a.case_id = b.case_id AND a.arm = 'a1' AND b.arm = 'a0'), {DRAWS}, bs AS (SELECT sum(k * diff) / sum(k) AS x FROM tm JOIN nu USING (no) GROUP BY b), {INTERVAL}
 SELECT round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, resamples FROM iv"""
)
def sta5_cost_difference_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean difference in tokens of two arms on the same cases, with its interval."""
    d = decisions(spark, sf_dir)
    a, b = (d.where(F.col("arm") == x).select("case_id", F.col("tokens").alias(x)) for x in ("a1", "a0"))
    s = a.join(b, "case_id").select("case_id", (F.col("a1") - F.col("a0")).alias("diff"))
    means = paired.resample(s, RESAMPLES).groupBy("b").agg((F.sum(F.col("k") * F.col("diff")) / F.sum("k")).alias("x"))
    return rounded(paired.spread(means, "x"))


@query(
    f"""{D}, c AS (SELECT arm || ':' || stratum AS name, count(*) FILTER (label = 'phishing' AND verdict = 'phishing') AS tp, count(*) FILTER (label = 'benign' AND verdict = 'phishing') AS fp, count(*) FILTER (label = 'phishing' AND verdict = 'benign') AS fn, avg(tokens) AS cost FROM d GROUP BY ALL),
 r AS (SELECT name, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp / nullif(tp + fp, 0) AS precision, cost FROM c), z AS (SELECT f1 AS f0, precision AS p0 FROM r WHERE name = 'a0:s0'),
 e AS (SELECT name, f1, precision, cost, name <> 'a0:s0' AND f1 >= f0 + 0.01 AND precision >= p0 - 0.01 AS eligible FROM r, z), t AS (SELECT *, eligible AND f1 >= max(f1) FILTER (eligible) OVER () - 0.005 AS tied FROM e),
 w AS (SELECT coalesce((SELECT arg_min(name, (cost, name)) FROM t WHERE tied), 'a0:s0') AS winner) SELECT name, round(f1, 6) AS f1, round(precision, 6) AS precision, round(cost, 6) AS cost, eligible, tied, name = winner AS chosen FROM t, w"""
)
def sta9_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that beat the reference without losing precision; of those within a margin of the best the cheapest is taken,
    and the reference where none is eligible."""
    d = decisions(spark, sf_dir).withColumn("name", F.concat_ws(":", "arm", "stratum"))
    r = metrics.rates(metrics.confusion(d, ["name"])).join(d.groupBy("name").agg(F.avg("tokens").alias("cost")), "name")
    return rounded(paired.adopt(r.select("name", "f1", "precision", "cost"), "a0:s0", gain=0.01, loss=0.01, tie=0.005))


# --- summaries, objects, replies ------------------------------------------------------------------------------------------


OBSERVED, PLATFORMS = "2024-01-20", ("example.net", "example.org")


def observed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's host, every third one with a label more, and its day."""
    n = F.col("page_id")
    host = F.concat(F.when(n % 3 == 0, F.concat(F.lit("h"), n % 7, F.lit("."))).otherwise(""), urls.host_of(F.col("url")))
    day = F.date_add(F.lit(OBSERVED).cast("date"), (n % 10).cast("int"))
    return read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"), day.alias("day"))


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a certificate, two in a row of one serial number, for the host of the page that the number gives: for its name and
    others, its parent's wildcard, its own wildcard, or another host."""
    hosts = observed_hosts(spark, sf_dir)
    e = read_table(spark, sf_dir, "events").crossJoin(F.broadcast(hosts.agg(F.max("page_id").alias("_last"))))  # one row
    i = F.col("event_id")
    e = e.withColumn("page_id", F.expr("event_id div 2") % (F.col("_last") + 1)).join(hosts, "page_id")
    h, parent = F.col("host"), F.regexp_replace("host", r"^[^.]*\.", "")
    names = F.when(i % 4 == 0, F.concat(F.lit(" WWW."), h, F.lit("\n"), h, F.lit(" "))).when(i % 4 == 1, F.concat(F.lit("*."), parent)).when(i % 4 == 2, F.concat(F.lit("*."), h))
    begun = F.col("ts").cast("timestamp")
    return e.select(
        F.when(i % 50 > 1, F.expr("event_id div 2")).alias("serial"), F.when(i % 5 > 0, F.concat(F.lit("CA"), i % 5)).alias("issuer"),
        F.when(i % 8 == 7, h).otherwise("other.example").alias("common_name"), names.alias("names"), F.when(i % 11 > 0, begun).alias("not_before"), (begun + F.expr("INTERVAL 90 DAYS")).alias("not_after"),
    )


HOSTS_SQL = f"oh AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'h' || page_id % 7 || '.' ELSE '' END || lower(regexp_extract(url, '^[^/]*//([^/?#:]*)', 1)) AS host, DATE '{OBSERVED}' + CAST(page_id % 10 AS INTEGER) AS day FROM pages)"
CERTS_SQL = f"""{HOSTS_SQL}, ce AS (SELECT event_id AS i, CASE WHEN event_id % 50 > 1 THEN event_id // 2 END AS serial, CASE WHEN event_id % 5 > 0 THEN 'CA' || event_id % 5 END AS issuer, CASE WHEN event_id % 8 = 7 THEN host ELSE 'other.example' END AS common_name,
  CASE event_id % 4 WHEN 0 THEN ' WWW.' || host || chr(10) || host || ' ' WHEN 1 THEN '*.' || regexp_replace(host, '^[^.]*[.]', '') WHEN 2 THEN '*.' || host END AS names, CASE WHEN event_id % 11 > 0 THEN ts END AS not_before, ts + INTERVAL 90 DAY AS not_after
  FROM events JOIN oh ON page_id = (event_id // 2) % (SELECT max(page_id) + 1 FROM oh)),
 cn AS (SELECT *, list_distinct(list_transform(string_split_regex(coalesce(names, ''), '\\s+') || [common_name], lambda n: lower(trim(n)))) AS every FROM ce WHERE not_before IS NOT NULL),
 cj AS (SELECT oh.page_id, oh.host, oh.day, cn.*, CASE WHEN list_contains(every, oh.host) THEN 'exact' ELSE 'wildcard' END AS covers FROM oh JOIN cn ON not_before < day + INTERVAL 1 DAY
   AND (list_contains(every, oh.host) OR (len(string_split(oh.host, '.')) >= 3 AND list_contains(every, '*.' || regexp_replace(oh.host, '^[^.]*[.]', ''))))),
 cu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, coalesce(serial::VARCHAR, coalesce(issuer, '') || '|' || common_name || '|' || coalesce(names, '') || '|' || not_before) ORDER BY covers, not_before, coalesce(names, '')) AS k FROM cj) WHERE k = 1),
 cs AS (SELECT page_id, count(*) AS n_before, count(*) FILTER (covers = 'exact') AS n_exact, count(*) FILTER (covers = 'wildcard') AS n_wildcard, min(not_before) AS first_not_before,
   list((serial, issuer, names, not_before, not_after, covers) ORDER BY not_before DESC, serial DESC NULLS LAST) AS l FROM cu GROUP BY page_id)"""


@query(
    rf"""WITH {CERTS_SQL} SELECT oh.page_id, oh.host, coalesce(n_before, 0) AS n_before, coalesce(n_exact, 0) AS n_exact, coalesce(n_wildcard, 0) AS n_wildcard, first_not_before, l[1][6] AS latest_covers, len(l[:50]) AS listed,
 sha256(array_to_string(list_reverse(list_transform(l[:50], lambda x: coalesce(x[1]::VARCHAR, '-') || ':' || x[6])), ',')) AS listed_sha256, CASE WHEN n_before IS NULL THEN 'no_covering_cert_valid_before_observation' END AS reason FROM oh LEFT JOIN cs ON cs.page_id = oh.page_id"""
)
def join14_url11_covering_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host with the certificates that cover it and began by its day: counts by kind, the first, and the fifty latest."""
    s = CT.summary(observed_hosts(spark, sf_dir), certificates(spark, sf_dir), "page_id", columns=("serial", "covers"))
    each = F.transform("certificates", lambda c: F.concat(F.coalesce(c["serial"].cast("string"), F.lit("-")), F.lit(":"), c["covers"]))
    return s.select(
        "page_id", "host", "n_before", "n_exact", "n_wildcard", "first_not_before", F.col("last.covers").alias("latest_covers"),
        F.when(F.col("n_before") > 0, F.size("certificates").cast("long")).alias("listed"), F.sha2(F.array_join(each, ","), 256).alias("listed_sha256"), "reason",
    )


@query(
    rf"""WITH {CERTS_SQL}, c AS (SELECT oh.*, cs.*, l[1] AS z, CASE WHEN regexp_replace(host, '^.*?([^.]+[.][^.]+)$', '\1') IN ('example.net', 'example.org') AND len(string_split(host, '.')) >= 3 THEN regexp_replace(host, '^.*?([^.]+[.][^.]+)$', '\1') END AS plat FROM oh LEFT JOIN cs ON cs.page_id = oh.page_id),
 d AS (SELECT *, CASE WHEN n_exact > 0 THEN 'host' WHEN n_before > 0 AND coalesce(regexp_replace(host, '^[^.]*[.]', '') = plat, false) THEN 'platform_wildcard' WHEN n_before > 0 THEN 'own_wildcard' END AS scope FROM c)
 SELECT page_id, CASE WHEN n_before > 0 THEN 'cert_scope=' || scope || ' (' || CASE scope WHEN 'host' THEN 'a certificate names this exact host' WHEN 'platform_wildcard' THEN 'only the hosting platform''s own wildcard certificate covers this host' ELSE 'only a wildcard certificate of the host''s parent domain covers this host' END
 || '); platform_hosted=' || CASE WHEN plat IS NOT NULL THEN 'true (host is on the shared hosting platform ' || plat || ')' ELSE 'false (host is its own registered domain, not a shared hosting platform)' END || '; host=' || host
 || '; certs_covering_host_valid_on_or_before_observation=' || n_before || ' (exact_name=' || n_exact || ', wildcard=' || n_wildcard || '); first_covering_cert_valid_from=' || first_not_before::DATE || ' (' || date_diff('day', first_not_before::DATE, day)
 || ' days before observation); latest_cert_covers=' || z[6] || '; latest_cert_issuer=' || coalesce(z[2], 'None') || '; latest_not_before=' || z[4]::DATE || '; latest_not_after=' || z[5]::DATE || '; latest_names=' || left(trim(regexp_replace(coalesce(z[3], ''), '\s+', ' ', 'g')), 300) END AS certificate,
 CASE WHEN page_id % 4 > 0 THEN 'domain=' || regexp_replace(host, '^.*?([^.]+[.][^.]+)$', '\1') || '; registered=' || (day - CAST(page_id % 90 AS INTEGER)) || ' (' || page_id % 90 || ' days before observation); registrar=' || CASE page_id % 4 WHEN 1 THEN 'None' ELSE 'R' || page_id % 4 END || '; expiration=' || CASE page_id % 4 WHEN 2 THEN '' ELSE (day + 30)::VARCHAR END END AS registration FROM d"""
)
def crt1_certificate_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificates that cover a page's host, and its registration, as one line of ``key=value`` pieces each; null where there is none."""
    s = CT.summary(observed_hosts(spark, sf_dir), certificates(spark, sf_dir), "page_id", listed=1)
    domain, n = F.array_join(F.slice(F.split("host", r"\."), -2, 2), "."), F.col("page_id")
    platform = F.when(domain.isin(*PLATFORMS) & (F.size(F.split("host", r"\.")) >= 3), domain)
    row = {c: F.col(c) for c in ("host", "day", "n_before", "n_exact", "n_wildcard", "first_not_before")}
    text = S.certificate_summary(CT.scope(F.col("n_exact"), F.col("n_before"), F.col("host"), platform), platform, row, F.col("last"))
    registered = F.when(n % 4 > 0, F.date_sub("day", (n % 90).cast("int")))
    registrar, expires = F.when(n % 4 > 1, F.concat(F.lit("R"), n % 4)), F.when(n % 4 != 2, F.date_add("day", 30))
    return s.select("page_id", text.alias("certificate"), S.registration_summary(domain, registered, F.col("day"), registrar, expires).alias("registration"))


OBJECT_TEXT = "CASE WHEN conv_id % 3 = 0 THEN coalesce(text, '') || ' see https://a.example.com/x?q=1) and http://b.example.net/y' WHEN conv_id % 3 = 1 THEN coalesce(text, '') || ' http://c.example.org' ELSE text END"


@query(
    f"""WITH s AS (SELECT conv_id, turn, {OBJECT_TEXT} AS text FROM conversations WHERE conv_id >= 0), u AS (SELECT conv_id, turn, regexp_extract_all(text, 'https?://[^\\s<>"'')]+') AS links FROM s),
 o AS (SELECT conv_id, turn, 'o1' AS object_id, NULL AS parent_object_id, NULL AS link FROM u UNION ALL SELECT conv_id, turn, 'o1:page:' || unnest(range(1, len(links) + 1)), 'o1', unnest(links) FROM u)
 SELECT conv_id, turn, object_id, parent_object_id, link, CASE WHEN parent_object_id IS NULL THEN 'message_body' ELSE 'dns,html,url' END AS sources, CASE WHEN parent_object_id IS NULL THEN 'headless_browser' ELSE 'headless_browser,metadata_client' END AS instruments FROM o"""
)
def evd1_submission_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and their links as objects, each child under its message, with the sources that apply and their instruments."""
    c, t = read_table(spark, sf_dir, "conversations").where("conv_id >= 0"), F.coalesce("text", F.lit(""))
    more = F.when(F.col("conv_id") % 3 == 0, F.concat(t, F.lit(" see https://a.example.com/x?q=1) and http://b.example.net/y")))
    more = more.when(F.col("conv_id") % 3 == 1, F.concat(t, F.lit(" http://c.example.org"))).otherwise(F.col("text"))
    table = {"message": ("message_body",), "link": ("url", "html", "dns")}
    return E.submission_objects(c.select("conv_id", "turn", more.alias("text")), ["conv_id", "turn"], table, ("dns", "registration", "tls", "ct", "hosting"))


MODALITIES = ("url", "html")


@query(
    """SELECT event_id, CASE WHEN user_id % 5 IN (0, 1) THEN 0 ELSE (CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) + 1 END AS phishing_supports, CASE WHEN user_id % 5 IN (0, 1) OR event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 ELSE 0 END AS phishing_contradicts,
 CASE WHEN user_id % 5 IN (0, 1) THEN 0 WHEN event_type = 'view' THEN 1 ELSE 0 END AS benign_supports, CASE WHEN user_id % 5 IN (0, 1) THEN 0 ELSE 1 END AS benign_contradicts, user_id % 5 IN (0, 1) AS malformed FROM events"""
)
def jsn6_modality_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modalities that support and contradict each side in a judge's stored reply; a reply that lacks one or says something else
    is malformed."""
    says = F.when(F.col("event_type") == "click", "supports").when(F.col("event_type") == "view", "contradicts").otherwise("neutral")
    good = F.when(F.col("event_type") == "view", "supports").otherwise("neutral")
    html = F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "html": {"phishing": "supports", "benign": "'), F.when(F.col("user_id") % 5 == 1, "odd").otherwise("contradicts"), F.lit('"}')))
    reply = F.concat(F.lit('{"modalities": {"url": {"phishing": "'), says, F.lit('", "benign": "'), good, F.lit('"}'), html, F.lit("}}"))
    e = read_table(spark, sf_dir, "events").withColumn("reply", reply)
    return e.select("event_id", *(c.alias(n) for n, c in replies.matrix_features(F.col("reply"), MODALITIES).items()))


@query(
    f"""WITH RECURSIVE {FINDINGS_SQL}, go(case_id, pos, spent, status) AS (SELECT case_id, -1::BIGINT, 0::BIGINT, '' FROM (SELECT DISTINCT case_id FROM f) UNION ALL
 SELECT f.case_id, f.pos, CASE WHEN go.spent + strength <= 9 THEN go.spent + strength ELSE go.spent END, CASE WHEN go.spent + strength <= 9 THEN 'dispatched' ELSE 'not_dispatched' END FROM go JOIN f ON f.case_id = go.case_id AND f.pos = (SELECT min(pos) FROM f n WHERE n.case_id = go.case_id AND n.pos > go.pos))
 SELECT case_id, pos, spent, status FROM go WHERE pos >= 0"""
)
def evd10_dispatch_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents in order: each is dispatched if what is left of the case's budget covers its cost; refused ones cost nothing."""
    plan = findings(spark, sf_dir).select("case_id", "pos", F.col("strength").alias("cost"))
    return E.dispatch_in_order(plan, 9).select("case_id", "pos", "spent", "status")


@query(
    f"""{D} SELECT arm, case_id, CASE WHEN (tokens % 2 = 0 AND tokens % 3 > 0) AND NOT (tokens % 5 < 3 AND coalesce(score > 0.1, false)) THEN 'phishing' WHEN NOT (tokens % 2 = 0 AND tokens % 3 > 0) AND (tokens % 5 < 3 AND coalesce(score > 0.1, false)) THEN 'benign' ELSE 'insufficient' END AS conclusion,
 CASE WHEN verdict = 'phishing' OR score > 0.5 THEN 'phishing' WHEN score IS NOT NULL THEN 'benign' ELSE verdict END AS cascade FROM d"""
)
def jsn4_mth4_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's four flags made a conclusion, and a cascade of two stages where the first to say phishing wins."""
    d, t = decisions(spark, sf_dir), F.col("tokens")
    second = F.when(F.col("score") > 0.5, "phishing").when(F.col("score").isNotNull(), "benign")
    flags = numbers.conclusion(t % 2 == 0, t % 3 > 0, t % 5 < 3, F.col("score") > 0.1)
    return d.select("arm", "case_id", flags.alias("conclusion"), replies.cascade(F.col("verdict"), second).alias("cascade"))


@query(
    r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'shop.' ELSE '' END || lower(regexp_extract(url, '^[^/]*//([^/?#:]*)', 1)) AS host FROM pages), q AS (SELECT *, regexp_replace(host, '^[^.]*[.]', '') AS parent FROM p),
 n AS (SELECT *, CASE page_id % 4 WHEN 0 THEN host WHEN 1 THEN '*.' || parent WHEN 2 THEN '*.' || host ELSE '*.example.com' END AS name FROM q), k AS (SELECT *, CASE WHEN name = host THEN 'exact' WHEN name = '*.' || parent AND len(string_split(host, '.')) >= 3 THEN 'wildcard' END AS kind FROM n)
 SELECT page_id, name, page_id % 7 AS n, kind, CASE WHEN kind = 'exact' THEN 'host' WHEN kind = 'wildcard' AND name = '*.example.net' THEN 'platform_wildcard' WHEN kind = 'wildcard' THEN 'own_wildcard' END AS scope FROM k"""
)
def url11_url12_jsn5_certificate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of ``key=value`` notes, how they cover the page's host, and the scope of that."""
    k = F.col("page_id")
    host = F.concat(F.when(k % 5 == 0, "shop.").otherwise(""), urls.host_of(F.col("url")))
    name = F.when(k % 4 == 0, host).when(k % 4 == 1, F.concat(F.lit("*."), F.regexp_replace(host, r"^[^.]*\.", ""))).when(k % 4 == 2, F.concat(F.lit("*."), host)).otherwise("*.example.com")
    note = F.concat(F.lit("name="), name, F.lit(" ; n="), (k % 7).cast("string"))
    p = read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"), replies.notes(note).alias("m"))
    p = p.select("page_id", "host", F.col("m")["name"].alias("name"), F.col("m")["n"].cast("long").alias("n"))
    kind = urls.cover_kind(F.col("host"), F.col("name"))
    return p.select("page_id", "name", "n", kind.alias("kind"), urls.certificate_scope(F.col("host"), F.col("name"), F.lit("example.net")).alias("scope"))
