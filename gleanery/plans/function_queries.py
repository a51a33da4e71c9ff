"""Queries for SQL functions, Arrow functions, lateral expansion, grouped functions, and two small reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.sql import fold_marks, register
from gleanery.operators import evidence as E
from gleanery.plans.evidence_queries import FS, LINKS
from gleanery.plans.registry import query, rounded
from gleanery.plans.score_queries import COUNTS, D
from gleanery.plans.tables import FINDINGS_SQL, decisions, findings
from gleanery.sources.shared import new_path
from gleanery.sources.tables import read_table


@query("SELECT doc_id, CAST(ceil(len(text) / 4) AS BIGINT) AS tokens, substr(sha256(text), 1, 20) AS key FROM documents")
def udf1_functions_from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT doc_id, token_estimate(text) AS tokens, short_hash(text) AS key FROM {d}", d=read_table(spark, sf_dir, "documents"))


@query("SELECT item_id, strip_accents(text) AS plain FROM benchmark")
def udf2_folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", fold_marks("text").alias("plain"))


@query("SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id) - 1 AS INTEGER) AS pos, line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)")
def udf3_lines_by_lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT item_id, pos, line FROM {b}, LATERAL posexplode(split(text, '\n')) AS l(pos, line)", b=read_table(spark, sf_dir, "benchmark"))


@query(f"{D}, c AS (SELECT arm, stratum, {COUNTS} FROM d GROUP BY ALL) SELECT arm, stratum, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def udf4_metric_as_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    hit = "count_if(label = '{}' AND verdict = '{}')".format
    sql = f"SELECT arm, stratum, f1_score({hit('phishing', 'phishing')}, {hit('benign', 'phishing')}, {hit('phishing', 'benign')}) AS f1 FROM {{d}} GROUP BY arm, stratum"
    return rounded(spark.sql(sql, d=decisions(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {FINDINGS_SQL}, {LINKS}, e AS (SELECT a AS x, b AS y FROM lk UNION SELECT b, a FROM lk), r(node, reach) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x)
 SELECT node, min(reach) AS component FROM r GROUP BY node"""
)
def udf5_components_inside_a_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a case's few links, one case at a time: the cross-check of the distributed form."""

    def parts(links: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in zip(links["a"], links["b"]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
        return pd.DataFrame({"node": list(root), "component": [find(x) for x in root]})

    links = E.common_cause_links(findings(spark, sf_dir), [f"f{i}" for i in range(9)])
    return links.groupBy("case_id").applyInPandas(parts, "node long, component long")


@query("WITH r AS (SELECT CASE WHEN len(text) < 200 THEN 'short' ELSE 'kept' END AS reason FROM documents) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def snk4_build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel written as JSON and read back."""
    path = new_path(spark, "report")
    d = read_table(spark, sf_dir, "documents").groupBy(F.when(F.length("text") < 200, "short").otherwise("kept").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    d.write.json(path)
    return spark.read.schema("reason string, n long").json(path)


@query(f"{FS}, c AS (SELECT case_id, list(DISTINCT agent) FILTER (strength >= 2) AS ready, list(DISTINCT agent) FILTER (direction <> 'neutral') AS ran FROM f GROUP BY case_id) SELECT case_id, array_to_string(list_sort(list_filter(coalesce(ready, []), lambda x: NOT list_contains(coalesce(ran, []), x))), ',') AS recoverable FROM c")
def fil17_eligible_for_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [F.collect_set(F.when(w, F.col("agent"))).alias(n) for n, w in (("ready", F.col("strength") >= 2), ("ran", F.col("direction") != "neutral"))]
    g = findings(spark, sf_dir).groupBy("case_id").agg(*sets)
    return g.select("case_id", F.array_join(F.array_sort(F.array_except("ready", "ran")), ",").alias("recoverable"))
