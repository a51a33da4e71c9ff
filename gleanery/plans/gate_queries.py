"""Queries of the collaboration gate: its features, its policies, the targets of rounds, and the model that opens it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import evidence as E
from gleanery.operators import gate
from gleanery.operators import records as R
from gleanery.plans.evidence_queries import FS, GROUPS
from gleanery.plans.registry import query, rounded
from gleanery.plans.rule_queries import ISSUES, RECORDS, all_records, items
from gleanery.plans.tables import findings
from gleanery.sources.shared import materialize

#: A frozen model of the gate, its threshold, the rounds there are, and the agents that a round asks.
INTERCEPT, WEIGHTS = 0.5, {"Cov": -1.0, "Agr": -1.5, "Suf": -0.5, "Conf": 2.0, "Band": -1.0, "Sol": 0.25}
TAU, MOST_ROUNDS, ASKED = 0.3, 2, 2


def gate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every case: items that share an artifact count once, a case's conflict is one issue, every third finding of
    the last three places came with a revision."""
    f = findings(spark, sf_dir)
    solicited = f.where("pos >= 5 and ref % 3 = 0").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    conflicts = E.conflict_issues(f).select("case_id", F.lit(1).alias("n"))
    dropped = E.discounted(E.shared_groups(f, "artifact"))
    return gate.gate_features(R.validated(all_records(spark, sf_dir)), items(spark, sf_dir), dropped, conflicts, solicited)


def all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(case_id, no, agents)``: a case's conflict first, which names the agents of its directional findings, then its records' issues."""
    i = R.record_issues(R.validated(all_records(spark, sf_dir)))
    own = i.select("case_id", (1 + F.substring("agent", 6, 1).cast("int")).alias("no"), F.array("agent").alias("agents"))
    conflict = E.conflict_issues(findings(spark, sf_dir)).select("case_id", F.lit(0).alias("no"), F.split("agents", ",").alias("agents"))
    return own.unionByName(conflict)


def tried_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent of each case was tried, in every seventh case all."""
    agent = F.explode(F.array(*(F.lit(f"agent{k}") for k in range(5)))).alias("agent")
    t = findings(spark, sf_dir).select("case_id").distinct().select("case_id", agent)
    return t.where("case_id % 7 = 0 or cast(substring(agent, 6, 1) as int) = case_id % 5")


BAND_OF = """CASE WHEN top IS NULL THEN 0 WHEN top = 3 AND breadth >= 2 AND opp = 0 THEN 4 WHEN opp = 0 AND (top = 3 OR (top = 2 AND breadth >= 2)) THEN 3 WHEN top = 2 AND opp = 0 THEN 2 ELSE 1 END"""
GATE_SQL = f"""{RECORDS}, {GROUPS}, mi AS (SELECT it.*, rc.said FROM it JOIN rc ON rc.case_id = it.case_id AND rc.agent = it.agent WHERE rc.st = 'ran'), ki AS (SELECT mi.* FROM mi ANTI JOIN dis ON dis.case_id = mi.case_id AND dis.ref = mi.ref),
 sc AS (SELECT case_id, count(*) FILTER (st <> 'skipped') AS applicable, count(*) FILTER (st = 'ran') AS ran FROM rc GROUP BY case_id),
 kc AS (SELECT case_id, count(*) FILTER (direction = 'phishing') AS p, count(*) FILTER (direction = 'benign') AS b, count(DISTINCT field) FILTER (direction <> 'neutral') AS fields FROM ki GROUP BY case_id),
 ow AS (SELECT case_id, agent, count(DISTINCT field) AS breadth, max(strength) AS top FROM mi WHERE direction = said GROUP BY ALL),
 op AS (SELECT ow.case_id, ow.agent, count(DISTINCT m.field) AS opp FROM ow JOIN (SELECT case_id, agent, field, said, direction, max(strength) AS most FROM mi WHERE direction <> 'neutral' GROUP BY ALL) m ON m.case_id = ow.case_id AND m.agent = ow.agent AND m.direction <> m.said AND most >= top GROUP BY ALL),
 bn AS (SELECT rc.case_id, avg({BAND_OF.replace("opp", "coalesce(opp, 0)")}) AS band FROM rc LEFT JOIN ow ON ow.case_id = rc.case_id AND ow.agent = rc.agent LEFT JOIN op ON op.case_id = rc.case_id AND op.agent = rc.agent WHERE rc.st = 'ran' GROUP BY rc.case_id),
 cn AS (SELECT case_id FROM f WHERE direction <> 'neutral' GROUP BY case_id HAVING count(DISTINCT direction) = 2), so AS (SELECT case_id, count(*) AS n FROM f WHERE pos >= 5 AND ref % 3 = 0 GROUP BY case_id), hi AS (SELECT case_id, count(*) AS items FROM mi GROUP BY case_id),
 gf AS (SELECT sc.case_id, coalesce(ran / nullif(applicable, 0), 0) AS Cov, coalesce(abs(p - b) / nullif(p + b, 0), 0) AS Agr, least(coalesce(fields, 0), 5) / 5 AS Suf, (cn.case_id IS NOT NULL)::INT / (1 + coalesce(fields, 0)) AS Conf, coalesce(band, 0) / 4 AS Band, coalesce(so.n, 0) / (1 + coalesce(items, 0)) AS Sol
   FROM sc LEFT JOIN kc ON kc.case_id = sc.case_id LEFT JOIN bn ON bn.case_id = sc.case_id LEFT JOIN cn ON cn.case_id = sc.case_id LEFT JOIN so ON so.case_id = sc.case_id LEFT JOIN hi ON hi.case_id = sc.case_id)"""
TRIED_SQL = "tr AS (SELECT DISTINCT case_id, 'agent' || k AS agent FROM f, range(5) r(k) WHERE case_id % 7 = 0 OR k = case_id % 5)"
NAMED_SQL = f"""{ISSUES}, an AS (SELECT case_id, 1 + substr(agent, 6, 1)::INT AS no, agent FROM iss UNION ALL SELECT DISTINCT case_id, 0, agent FROM f WHERE direction <> 'neutral' AND case_id IN (SELECT case_id FROM cn)), {TRIED_SQL}"""


@query(f"{FS}, {GATE_SQL} SELECT case_id, round(Cov, 6) AS Cov, round(Agr, 6) AS Agr, round(Suf, 6) AS Suf, round(Conf, 6) AS Conf, round(Band, 6) AS Band, round(Sol, 6) AS Sol FROM gf")
def agg21_gate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, agreement, sufficiency, conflict, band and solicited evidence of every case."""
    return rounded(gate_features(spark, sf_dir))


@query(
    f"""{FS}, {GATE_SQL}, {NAMED_SQL}, ac AS (SELECT DISTINCT case_id FROM an ANTI JOIN tr ON tr.case_id = an.case_id AND tr.agent = an.agent),
 q AS (SELECT gf.case_id, 1 / (1 + exp(-({INTERCEPT} + {" + ".join(f"({w}) * {n}" for n, w in WEIGHTS.items())}))) AS p, ac.case_id IS NOT NULL AS actionable, gf.case_id % 4 AS budget FROM gf LEFT JOIN ac ON ac.case_id = gf.case_id)
 SELECT case_id, r::INT AS round, policy, round(p, 6) AS p, CASE policy WHEN 'never' THEN false WHEN 'calibrated' THEN p > {TAU} AND actionable AND r < {MOST_ROUNDS} AND budget - r > 0 ELSE actionable END AS admits
 FROM q, range(3) x(r), (VALUES ('never'), ('fixed'), ('always'), ('calibrated')) y(policy)"""
)
def evd24_gate_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each policy opens each of three rounds of every case; a round costs one of the case's budget."""
    features = gate_features(spark, sf_dir).withColumn("p", gate.stopping_probability(INTERCEPT, WEIGHTS))
    tried = tried_agents(spark, sf_dir).groupBy("case_id").agg(F.collect_set("agent").alias("tried"))
    some = gate.actionable(all_issues(spark, sf_dir), tried).select("case_id").distinct().withColumn("actionable", F.lit(True))
    rows = features.join(some, "case_id", "left").fillna(False, ["actionable"])
    rows = rows.withColumn("round", F.explode(F.array(*map(F.lit, range(3))))).withColumn("policy", F.explode(F.array(*map(F.lit, gate.POLICIES))))
    rows = rows.withColumn("left", F.col("case_id") % 4 - F.col("round"))
    return rounded(gate.gate(rows, TAU, MOST_ROUNDS).select("case_id", "round", "policy", "p", "admits"))


def _round_sql(r: int) -> str:
    """SQL: the targets of a round, after those of the rounds before it."""
    tried = " UNION ALL ".join(["SELECT case_id, agent FROM tr", *(f"SELECT case_id, agent FROM t{q}" for q in range(r))])
    return f"""n{r} AS (SELECT an.case_id, an.agent, min(no) AS no FROM an JOIN rc ON rc.case_id = an.case_id AND rc.agent = an.agent AND rc.st <> 'skipped' ANTI JOIN ({tried}) x ON x.case_id = an.case_id AND x.agent = an.agent GROUP BY ALL),
 t{r} AS (SELECT *, {r} AS round, row_number() OVER (PARTITION BY case_id ORDER BY no, agent) AS place FROM (SELECT *, (SELECT count(*) FROM n{r} e WHERE e.case_id = n{r}.case_id AND e.no < n{r}.no) AS before FROM n{r}) WHERE before < {ASKED})"""


@query(f"{FS}, {GATE_SQL}, {NAMED_SQL}, {_round_sql(0)}, {_round_sql(1)} SELECT case_id, round::INT AS round, place::INT AS place, agent, no FROM t0 UNION ALL SELECT case_id, round::INT, place::INT, agent, no FROM t1")
def evd23_targets_of_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom the first two rounds of each case ask, and for which issue."""
    applicable = R.validated(all_records(spark, sf_dir)).where("status <> 'skipped'")
    return gate.round_targets(all_issues(spark, sf_dir), applicable, tried_agents(spark, sf_dir), ASKED, MOST_ROUNDS)


@query()
def mld15_gate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's model, fitted on the directional states of three quarters of the cases and applied to the others: how likely the verdict
    is wrong. A case's truth follows its number."""
    truth = F.when(F.col("case_id") * 7 % 5 < 2, "phishing").otherwise("benign")
    said = E.preliminary(findings(spark, sf_dir)).where("verdict <> 'neutral'").select("case_id", (F.col("verdict") != truth).alias("wrong"))
    states = materialize(gate_features(spark, sf_dir).join(said, "case_id"), "states")
    intercept, weights = gate.fit_gate(states.where(~gate.held_out(F.col("case_id"))))
    rest = states.where(gate.held_out(F.col("case_id")))
    return rest.select("case_id", F.col("wrong").cast("double").alias("y"), F.round(gate.stopping_probability(intercept, weights), 3).alias("p"))
