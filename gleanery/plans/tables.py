"""Working tables of the queries, derived from the shared tables, each with its SQL.

``decisions``: each event is one system's decision on one case. Three events in a row judge the same case for three
systems (arms); the type gives the verdict, the value the score, the properties the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources.tables import read_table


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    case = F.expr("event_id div 3")
    return e.select(
        F.concat(F.lit("a"), F.col("event_id") % 3).alias("arm"),
        case.alias("case_id"),
        F.when(case * 7 % 5 < 2, "phishing").otherwise("benign").alias("label"),
        F.when(F.col("event_type").isin("click", "signup"), "phishing")
        .when(F.col("event_type").isin("purchase", "view"), "benign")
        .otherwise("inconclusive")
        .alias("verdict"),
        F.when(F.col("event_type") != "error", F.col("value") / 512).alias("score"),
        F.concat(F.lit("s"), case % 4).alias("stratum"),
        F.concat(F.lit("g"), case % 97).alias("grp"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        (F.col("value") / 8).alias("latency_s"),
        F.col("user_id").alias("model"),
        "ts",
    )


DECISIONS_SQL = """d AS (SELECT 'a' || (event_id % 3) AS arm, event_id // 3 AS case_id,
  CASE WHEN (event_id // 3) * 7 % 5 < 2 THEN 'phishing' ELSE 'benign' END AS label,
  CASE WHEN event_type IN ('click', 'signup') THEN 'phishing' WHEN event_type IN ('purchase', 'view') THEN 'benign' ELSE 'inconclusive' END AS verdict,
  CASE WHEN event_type <> 'error' THEN value / 512 END AS score, 's' || ((event_id // 3) % 4) AS stratum, 'g' || ((event_id // 3) % 97) AS grp,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value / 8 AS latency_s, user_id AS model, ts FROM events)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is one observation in a case of eight, with field, direction, strength and provenance."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.expr("event_id div 8").alias("case_id"),
        F.col("event_id").alias("ref"),
        (F.col("event_id") % 8).alias("pos"),
        F.concat(F.lit("agent"), F.col("user_id") % 5).alias("agent"),
        F.concat(F.lit("f"), F.col("user_id") % 9).alias("field"),
        F.when(F.col("event_type").isin("click", "signup"), "phishing")
        .when(F.col("event_type").isin("purchase", "view"), "benign")
        .otherwise("neutral")
        .alias("direction"),
        (1 + F.floor(F.col("value")) % 3).cast("int").alias("strength"),
        F.concat(F.lit("art"), F.col("user_id") % 6).alias("artifact"),
        F.concat(F.lit("ins"), F.col("user_id") % 4).alias("instrument"),
        F.concat(F.lit("cap"), F.col("event_id") % 2).alias("capture_id"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("entity"),
    )


FINDINGS_SQL = """f AS (SELECT event_id // 8 AS case_id, event_id AS ref, event_id % 8 AS pos, 'agent' || (user_id % 5) AS agent, 'f' || (user_id % 9) AS field,
  CASE WHEN event_type IN ('click', 'signup') THEN 'phishing' WHEN event_type IN ('purchase', 'view') THEN 'benign' ELSE 'neutral' END AS direction,
  CAST(1 + CAST(floor(value) AS BIGINT) % 3 AS INTEGER) AS strength, 'art' || (user_id % 6) AS artifact, 'ins' || (user_id % 4) AS instrument,
  'cap' || (event_id % 2) AS capture_id, 'k' || json_extract_string(props, '$.k') AS entity FROM events)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest: one row per case with its label, stratum, group, observation day and split."""
    d = decisions(spark, sf_dir).where("arm = 'a0'")
    split = F.when(F.col("case_id") % 10 < 6, "train").when(F.col("case_id") % 10 < 8, "dev").otherwise("test")
    return d.select("case_id", "label", "stratum", "grp", F.to_date("ts").alias("observed"), split.alias("split"))


CASES_SQL = """m AS (SELECT case_id, label, stratum, grp, CAST(ts AS DATE) AS observed,
  CASE WHEN case_id % 10 < 6 THEN 'train' WHEN case_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split FROM d WHERE arm = 'a0')"""
