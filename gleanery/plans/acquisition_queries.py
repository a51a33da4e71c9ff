"""Queries of acquisition under conditions: attempts, audits of cases, and figures per condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import acquisition as A
from gleanery.plans.registry import query, rounded
from gleanery.plans.tables import findings

BUDGET = 14


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen fields of every case of the findings; what became of each follows the case's and the field's number. Every fifth case has
    swapped captures too."""
    names = sorted(A.STAGES)
    field = F.posexplode(F.array(*map(F.lit, names))).alias("k", "field")
    c = findings(spark, sf_dir).select("case_id").distinct()
    sets = F.explode(F.when(F.col("case_id") % 5 == 0, F.array(F.lit("split"), F.lit("conflict"))).otherwise(F.array(F.lit("split")))).alias("captures")
    c = c.select("case_id", sets).select("case_id", "captures", field)
    code = (F.col("case_id") * 7 + F.col("k") * 5 + F.when(F.col("captures") == "conflict", 3).otherwise(0)) % 11
    message = (F.col("field") == "message_body") & (F.col("case_id") % 3 > 0)
    state = F.when(message, "inapplicable").when(code == 0, "failed").when(code < 3, "absent").when((code == 3) & (F.col("k") % 4 == 1), "inapplicable").otherwise("ok")
    return c.select("case_id", "captures", "field", state.alias("state"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


FIELDS_SQL = ", ".join(f"({k}, '{f}', {A.STAGES[f]})" for k, f in enumerate(sorted(A.STAGES)))
AUDIT_SQL = f"""cd(condition, withheld, transient, r_max, captures) AS (VALUES {", ".join(f"('{n}', {_list(w)}, {_list(t)}, {r}, '{c}')" for n, w, t, r, c, _ in A.CONDITIONS)}),
 fl(k, field, stage) AS (VALUES {FIELDS_SQL}), cs AS (SELECT DISTINCT event_id // 8 AS case_id FROM events), cc AS (SELECT case_id, 'split' AS captures FROM cs UNION ALL SELECT case_id, 'conflict' FROM cs WHERE case_id % 5 = 0),
 ca AS (SELECT case_id, captures, k, field, stage, (case_id * 7 + k * 5 + CASE captures WHEN 'conflict' THEN 3 ELSE 0 END) % 11 AS code FROM cc, fl),
 st AS (SELECT *, CASE WHEN field = 'message_body' AND case_id % 3 > 0 THEN 'inapplicable' WHEN code = 0 THEN 'failed' WHEN code < 3 THEN 'absent' WHEN code = 3 AND k % 4 = 1 THEN 'inapplicable' ELSE 'ok' END AS state FROM ca),
 tr AS (SELECT condition, case_id, field, stage, list_contains(transient, field) AND NOT list_contains(withheld, field) AS strikes, r_max, CASE WHEN list_contains(withheld, field) THEN 'withheld' WHEN state = 'failed' THEN 'failed' WHEN state = 'absent' THEN 'not_captured' ELSE 'obtained' END AS fin FROM st JOIN cd USING (captures) WHERE state <> 'inapplicable'),
 am AS (SELECT condition, case_id, field, stage, 1 AS attempt, CASE WHEN strikes THEN 'transient' ELSE fin END AS outcome FROM tr UNION ALL SELECT condition, case_id, field, stage, 2, fin FROM tr WHERE strikes AND r_max > 1),
 md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition, case_id ORDER BY stage, field, attempt) AS spent FROM am) WHERE spent <= {BUDGET}),
 fi AS (SELECT condition, case_id, field, arg_max(outcome, attempt) AS fin, count(*) AS tries, count(*) FILTER (outcome = 'transient') AS bad FROM md GROUP BY ALL),
 ob AS (SELECT condition, case_id, coalesce(list(field ORDER BY field) FILTER (fin = 'obtained'), []) AS obtained, coalesce(list(field ORDER BY field) FILTER (fin <> 'obtained'), []) AS gaps, count(*) FILTER (fin = 'obtained' AND bad > 0) AS recovered, sum(tries) AS attempts, sum(bad) AS failures FROM fi GROUP BY ALL),
 ag(agent, fields, needs) AS (VALUES {", ".join(f"('{a}', {_list(f)}, {_list(A.AGENT_REQUIRED[a])})" for a, f in A.AGENT_FIELDS.items())}),
 ap AS (SELECT case_id, captures, list(field) AS applies FROM st WHERE state <> 'inapplicable' GROUP BY ALL),
 aa AS (SELECT ob.condition, ob.case_id, agent, fields, list_has_any(fields, obtained) AS ready, list_has_any(needs, list_filter(obtained, lambda x: x <> 'screenshot')) AS good FROM ob JOIN cd ON cd.condition = ob.condition JOIN ap ON ap.case_id = ob.case_id AND ap.captures = cd.captures JOIN ag ON list_has_any(ag.fields, applies)),
 au AS (SELECT ob.condition, ob.case_id, count(*) AS applicable, count(*) FILTER (ready) AS ready, count(*) FILTER (good) AS analysable, any_value(obtained) AS obtained, any_value(gaps) AS gaps, any_value(recovered) AS recovered, any_value(attempts) AS attempts, any_value(failures) AS failures,
   list_sort(list_intersect(list_filter(any_value(obtained), lambda x: x <> 'screenshot'), coalesce(flatten(list(fields) FILTER (good)), []))) AS readable FROM ob JOIN aa ON aa.condition = ob.condition AND aa.case_id = ob.case_id GROUP BY ob.condition, ob.case_id)"""


@query(f"WITH {AUDIT_SQL} SELECT condition, case_id, field, stage, attempt, outcome FROM md")
def win20_fil10_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of every case under the twelve conditions, transient failures tried again, until the budget is spent."""
    return A.attempts(captured(spark, sf_dir), A.condition_table(spark), BUDGET)


@query(f"WITH {AUDIT_SQL} SELECT condition, case_id, applicable, ready, analysable, round(analysable / applicable, 6) AS ceiling, array_to_string(readable, ',') AS readable, len(readable) >= 2 AS verdict_possible, array_to_string(gaps, ',') AS gaps FROM au WHERE condition IN ('base', 'no_dom', 'transient_browser_no_retry')")
def evd32_case_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each case's evidence allows at most under three of the conditions: agents, fields, a verdict, and the fields that are gaps."""
    three = A.condition_table(spark, tuple(c for c in A.CONDITIONS if c[0] in ("base", "no_dom", "transient_browser_no_retry")))
    a = A.audit(captured(spark, sf_dir), three, BUDGET)
    return rounded(a.select("condition", "case_id", "applicable", "ready", "analysable", "ceiling", F.array_join("readable", ",").alias("readable"), "verdict_possible", F.array_join("gaps", ",").alias("gaps")))


@query(
    f"""WITH {AUDIT_SQL}, b AS (SELECT case_id, len(readable) >= 2 AS could FROM au WHERE condition = 'base')
 SELECT condition, count(*) AS cases, round(avg(ready), 6) AS mean_ready, round(avg(analysable), 6) AS mean_analysable, round(avg(analysable / applicable), 6) AS mean_ceiling, count(*) FILTER (analysable / applicable < 0.5) AS ceiling_below_half, round(avg(len(readable)), 6) AS mean_readable,
 round(avg((len(readable) >= 2)::INT), 6) AS verdict_possible, round(1 - avg((len(readable) >= 2)::INT), 6) AS forced_abstention, count(*) FILTER (could AND len(readable) < 2) AS lost_vs_base, round(avg(len(gaps)), 6) AS mean_gaps, round(avg(attempts), 6) AS mean_attempts,
 sum(failures)::BIGINT AS transient_failures, sum(recovered)::BIGINT AS recovered, round(sum(recovered) / nullif(sum(failures), 0), 6) AS recovery_rate FROM au JOIN b ON b.case_id = au.case_id GROUP BY condition"""
)
def agg23_fil10_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of all twelve conditions."""
    return rounded(A.by_condition(A.audit(captured(spark, sf_dir), A.condition_table(spark), BUDGET)))
