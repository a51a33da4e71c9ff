"""Scoring queries: metrics, ranking, paired statistics, cost and sink tables over the decision table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import numbers
from gleanery.operators import metrics, paired, ranking
from gleanery.plans.registry import query, rounded
from gleanery.plans.tables import CASES_SQL, DECISIONS_SQL, cases, decisions

D = f"WITH {DECISIONS_SQL} "
DM = f"WITH {DECISIONS_SQL}, {CASES_SQL} "
COUNTS = """count(*) AS n, count(*) FILTER (label = 'phishing' AND verdict = 'phishing') AS tp, count(*) FILTER (label = 'benign' AND verdict = 'phishing') AS fp,
 count(*) FILTER (label = 'benign' AND verdict = 'benign') AS tn, count(*) FILTER (label = 'phishing' AND verdict = 'benign') AS fn,
 count(*) FILTER (label = 'phishing' AND verdict = 'inconclusive') AS abstained_bad, count(*) FILTER (label = 'benign' AND verdict = 'inconclusive') AS abstained_good"""
RATES = """round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
 round(fp / nullif(fp + tn, 0), 6) AS fpr, round((tp + fp + tn + fn) / n, 6) AS coverage, round((fp + fn) / nullif(tp + fp + tn + fn, 0), 6) AS risk"""


@query(f"{D}, c AS (SELECT arm, stratum, {COUNTS} FROM d GROUP BY ALL) SELECT *, {RATES} FROM c")
def agg1_agg2_rates_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rates(metrics.confusion(decisions(spark, sf_dir), ["arm", "stratum"])))


@query(
    f"""{D}, c AS (SELECT arm, {COUNTS} FROM d GROUP BY ALL), x AS (SELECT *, fn + abstained_bad AS forced_fn, fp + abstained_good AS forced_fp FROM c)
 SELECT *, round(tp / (tp + forced_fn), 6) AS forced_recall, round(tp / (tp + forced_fp), 6) AS forced_precision,
 round(2 * tp / (2 * tp + forced_fn + forced_fp), 6) AS forced_f1, round(forced_fp / (forced_fp + tn), 6) AS forced_fpr, round((tp + tn) / n, 6) AS forced_accuracy FROM x"""
)
def agg3_forced_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.forced(metrics.confusion(decisions(spark, sf_dir), ["arm"])))


@query(
    f"""{D}, c AS (SELECT arm, count(*) FILTER (label = 'phishing' AND verdict = label) AS tp, count(*) FILTER (label = 'phishing' AND verdict <> label) AS fn,
 count(*) FILTER (label = 'benign' AND verdict = label) AS tn, count(*) FILTER (label = 'benign' AND verdict <> label) AS fp FROM d GROUP BY ALL)
 SELECT *, round(tn / nullif(tn + fp, 0), 6) AS tnr, round(fn / nullif(fn + tp, 0), 6) AS fnr FROM c"""
)
def agg5_full_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.full_table(decisions(spark, sf_dir), ["arm"]))


@query(
    f"""{D}, s AS (SELECT *, unnest(list_filter(['all', 'stratum:' || stratum, CASE WHEN CAST(ts AS DATE) > DATE '2024-01-15' THEN 'after-cutoff' END,
 CASE WHEN score IS NULL THEN 'unscored' END], lambda x: x IS NOT NULL)) AS subset FROM d) SELECT arm, subset, {COUNTS} FROM s GROUP BY ALL"""
)
def agg6_fil13_metrics_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(metrics.with_subsets(decisions(spark, sf_dir), "2024-01-15"), ["arm", "subset"])


@query(
    f"""{D}, l AS (SELECT arm, list_sort(list(latency_s)) AS v FROM d WHERE latency_s IS NOT NULL GROUP BY arm)
 SELECT arm, v[len(v) // 2 + 1] AS median, v[greatest(0, len(v) * 95 // 100 - 1) + 1] AS p95 FROM l"""
)
def agg14_latency_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.index_quantiles(decisions(spark, sf_dir), ["arm"], "latency_s")


@query(
    f"""{D} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_p, round(avg(CASE WHEN label = 'phishing' THEN 1 ELSE 0 END), 6) AS observed,
 round(avg((score - (label = 'phishing')::INT) * (score - (label = 'phishing')::INT)), 6) AS brier FROM d WHERE score IS NOT NULL GROUP BY 1"""
)
def agg29_reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.reliability(decisions(spark, sf_dir)))


PRICES = "(VALUES (0, 0.15, 0.60), (1, 0.5, 1.5), (2, 2.5, 10.0))"


def _prices(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT CAST(col1 AS BIGINT) AS kind, CAST(col2 AS DOUBLE) AS price_in, CAST(col3 AS DOUBLE) AS price_out FROM VALUES {PRICES[8:-1]}")


@query(
    f"""{D}, p(kind, price_in, price_out) AS {PRICES} SELECT arm, count(*) AS calls, sum(tokens) AS tokens, round(avg(tokens), 6) AS mean_tokens,
 round(sum(tokens * price_in + tokens / 4 * price_out) / 1000000, 6) AS usd FROM d JOIN p ON d.model % 3 = p.kind GROUP BY ROLLUP (arm)"""
)
def agg13_join17_cost_per_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir).withColumn("kind", F.col("model") % 3).join(F.broadcast(_prices(spark)), "kind")  # three price rows
    usd = F.sum(F.col("tokens") * F.col("price_in") + F.col("tokens") / 4 * F.col("price_out")) / 1000000
    return rounded(d.rollup("arm").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.avg("tokens").alias("mean_tokens"), usd.alias("usd")))


@query(
    f"""{D}, r AS (SELECT arm, stratum, {COUNTS} FROM d GROUP BY ALL), x AS (SELECT arm, avg(2 * tp / nullif(2 * tp + fp + fn, 0)) AS f1 FROM r GROUP BY arm)
 SELECT arm, round(f1, 6) AS f1, round(f1 - (SELECT f1 FROM x WHERE arm = 'a0'), 6) AS delta FROM x"""
)
def agg31_mean_over_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata stand for repeated runs; each arm's mean against the full arm's."""
    m = metrics.rates(metrics.confusion(decisions(spark, sf_dir), ["arm", "stratum"])).groupBy("arm").agg(F.avg("f1").alias("f1"))
    full = m.where("arm = 'a0'").select(F.col("f1").alias("base"))
    return rounded(m.crossJoin(F.broadcast(full)).select("arm", "f1", (F.col("f1") - F.col("base")).alias("delta")))  # one row


@query(f"{D} SELECT case_id, round(avg(score), 9) AS score, count(score) AS judges FROM d GROUP BY ALL")
def agg32_mean_of_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions(spark, sf_dir).groupBy("case_id").agg(F.avg("score").alias("score"), F.count("score").alias("judges")), 9)


@query(
    f"""{D}, c AS (SELECT arm, score, count(*) AS k FROM d WHERE score IS NOT NULL GROUP BY ALL) SELECT arm, count(*) AS distinct_scores, round(max(k) / sum(k), 6) AS modal_share FROM c GROUP BY arm"""
)
def agg33_tie_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decisions(spark, sf_dir).where("score is not null").groupBy("arm", "score").agg(F.count(F.lit(1)).alias("k"))
    return rounded(c.groupBy("arm").agg(F.count(F.lit(1)).alias("distinct_scores"), (F.max("k") / F.sum("k")).alias("modal_share")))


@query(
    f"""{D}, g(tau) AS (VALUES (0.01), (0.02), (0.05), (0.1)), x AS (SELECT arm, score, verdict <> label AS wrong FROM d WHERE score IS NOT NULL)
 SELECT arm, tau, round(avg((score >= tau)::INT), 6) AS stopped, round(avg(wrong::INT) FILTER (score >= tau), 6) AS error FROM x, g GROUP BY ALL"""
)
def agg35_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.sql("SELECT CAST(col1 AS DOUBLE) AS tau FROM VALUES (0.01), (0.02), (0.05), (0.1)")
    d = decisions(spark, sf_dir).withColumn("wrong", F.col("verdict") != F.col("label"))
    out = rounded(ranking.grid_rates(d, grid, ["arm"]))
    return out.withColumn("tau", F.col("tau").cast("decimal(3,2)"))


@query(
    f"""{D}, r AS (SELECT arm, label, score, sum((label = 'phishing')::INT) OVER w AS tp, row_number() OVER w AS i FROM d WHERE score IS NOT NULL WINDOW w AS (PARTITION BY arm ORDER BY score DESC, case_id ROWS UNBOUNDED PRECEDING))
 SELECT arm, round(sum(tp / i) FILTER (label = 'phishing') / count(*) FILTER (label = 'phishing'), 6) AS ap FROM r GROUP BY arm"""
)
def win7_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.average_precision(decisions(spark, sf_dir).where("score is not null"), ["arm"]))


@query(
    f"""{D}, r AS (SELECT arm, label, rank() OVER (PARTITION BY arm ORDER BY score) + (count(*) OVER (PARTITION BY arm, score) - 1) / 2 AS r FROM d WHERE score IS NOT NULL),
 s AS (SELECT arm, sum(r) FILTER (label = 'phishing') AS sr, count(*) FILTER (label = 'phishing') AS p, count(*) FILTER (label = 'benign') AS n FROM r GROUP BY arm)
 SELECT arm, round((sr - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s"""
)
def win8_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.roc_auc(decisions(spark, sf_dir), ["arm"]))


CUM = """t AS (SELECT arm, score, count(*) FILTER (label = 'phishing') AS pos, count(*) FILTER (label = 'benign') AS neg FROM d WHERE score IS NOT NULL GROUP BY ALL),
 c AS (SELECT arm, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY arm) AS p, sum(neg) OVER (PARTITION BY arm) AS n FROM t WINDOW w AS (PARTITION BY arm ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"{D}, {CUM} SELECT arm, min(score) AS threshold, round(max(tp / p), 6) AS recall FROM c WHERE tp >= 0.4 * (tp + fp) GROUP BY arm")
def win9_mld9_threshold_at_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.threshold_at_precision(decisions(spark, sf_dir), ["arm"], 0.4)
    return out.withColumn("recall", F.round("recall", 6))


@query(f"{D}, {CUM} SELECT arm, max(score) AS threshold, round(min(fp / n), 6) AS fpr, round(min(tp / p), 6) AS tpr FROM c WHERE tp >= ceil(p * 0.9 - 1e-9) GROUP BY arm")
def win10_operating_point_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.at_recall(decisions(spark, sf_dir), ["arm"], 0.9)
    return out.withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


@query(f"{D}, {CUM} SELECT arm, round(max(tp / p), 6) AS tpr FROM c WHERE fp <= floor(n * 0.1) GROUP BY arm")
def win11_tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.at_false_positives(decisions(spark, sf_dir), ["arm"], 0.1))


@query(
    f"""{D}, {CUM}, b AS (SELECT arm AS baseline, tp / (tp + fp) AS target FROM (SELECT arm, count(*) FILTER (label = 'phishing') AS tp, count(*) FILTER (label = 'benign') AS fp FROM d WHERE verdict = 'phishing' GROUP BY arm))
 SELECT arm, baseline, min(score) AS threshold FROM c JOIN b ON c.arm <> b.baseline AND tp >= target * (tp + fp) GROUP BY ALL"""
)
def win12_matched_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    base = d.where("verdict = 'phishing'").groupBy(F.col("arm").alias("baseline")).agg(F.avg((F.col("label") == "phishing").cast("double")).alias("target"))
    t = ranking.score_table(d, ["arm"])
    on = (F.col("arm") != F.col("baseline")) & (F.col("tp") >= F.col("target") * (F.col("tp") + F.col("fp")))
    return t.join(F.broadcast(base), on).groupBy("arm", "baseline").agg(F.min("score").alias("threshold"))  # a row per arm


PAIR = """pr AS (SELECT x.case_id, x.label, x.verdict AS one, y.verdict AS two, x.arm || '/' || y.arm AS test FROM d x JOIN d y ON x.case_id = y.case_id AND x.arm < y.arm)"""
MCN = """q AS (SELECT test, count(*) FILTER (one = label AND two <> label) AS b, count(*) FILTER (one <> label AND two = label) AS c FROM pr GROUP BY test),
 z AS (SELECT q.test, b, c, least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) AS p FROM q, range(0, 100000) r(i) WHERE i <= least(b, c) GROUP BY ALL)"""


@query(
    f"""{D}, {PAIR}, {MCN}, h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS s FROM z)
 SELECT test, b, c, round(p, 6) AS p, round(least(1, max(s) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM h"""
)
def sta7_sta8_win13_mcnemar_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    tests = None
    for one, two in (("a0", "a1"), ("a0", "a2"), ("a1", "a2")):
        t = paired.discordant(paired.pair(d, one, two)).withColumn("test", F.lit(f"{one}/{two}"))
        tests = t if tests is None else tests.unionByName(t)
    t = tests.select("test", F.col("only_one").alias("b"), F.col("only_two").alias("c")).withColumn("p", paired.mcnemar(F.col("b"), F.col("c")))
    return rounded(ranking.holm(t, "p"))  # a row per test


@query(
    f"""{D}, pr AS (SELECT x.case_id, x.label, x.verdict AS one, y.verdict AS two FROM d x JOIN d y USING (case_id) WHERE x.arm = 'a0' AND y.arm = 'a1')
 SELECT one, two, count(*) AS flips, count(*) FILTER (one = label) AS first_right, count(*) FILTER (two = label) AS second_right FROM pr WHERE one <> two GROUP BY ALL"""
)
def sta11_join2_verdict_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.flips(paired.pair(decisions(spark, sf_dir), "a0", "a1"))


#: As many resamples as the reference draws.
B = 2000
BOOT = f"""pr AS (SELECT x.case_id, x.label, x.verdict AS one, y.verdict AS two FROM d x JOIN d y USING (case_id) WHERE x.arm = 'a0' AND y.arm = 'a1'),
 nb AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(case_id AS VARCHAR)), 1, 4))::BIGINT % 256, case_id) - 1 AS no FROM pr),
 gr AS (SELECT b, g, md5(b || '|' || g) AS h FROM range(0, {B}) t(b), range(0, (SELECT (count(*) + 3) // 4 FROM nb)) s(g)),
 dr AS (SELECT b, ('0x' || substr(h, CAST(1 + 8 * i AS INTEGER), 8))::BIGINT % (SELECT count(*) FROM nb) AS no FROM gr, range(0, 4) q(i) WHERE 4 * g + i < (SELECT count(*) FROM nb)),
 fs AS (SELECT b, count(*) FILTER (label = 'phishing' AND one = 'phishing') AS tp1, count(*) FILTER (label = 'benign' AND one <> label) AS fp1, count(*) FILTER (label = 'phishing' AND one <> 'phishing') AS fn1,
 count(*) FILTER (label = 'phishing' AND two = 'phishing') AS tp2, count(*) FILTER (label = 'benign' AND two <> label) AS fp2, count(*) FILTER (label = 'phishing' AND two <> 'phishing') AS fn2 FROM dr JOIN nb USING (no) GROUP BY b),
 dl AS (SELECT b, 2 * tp2 / (2 * tp2 + fp2 + fn2) - 2 * tp1 / (2 * tp1 + fp1 + fn1) AS delta FROM fs)"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.bootstrap_f1(paired.pair(decisions(spark, sf_dir), "a0", "a1"), B)


@query(f"{D}, {BOOT} SELECT b, round(delta, 6) AS delta FROM dl")
def sta1_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_deltas(spark, sf_dir))


@query(
    f"""{D}, {BOOT}, o AS (SELECT delta, row_number() OVER (ORDER BY delta) - 1 AS i, count(*) OVER () AS n FROM dl)
 SELECT round(max(delta) FILTER (i = CAST(floor(0.025 * n + 1e-9) AS BIGINT)), 6) AS low, round(max(delta) FILTER (i = greatest(0, CAST(floor(0.975 * n + 1e-9) AS BIGINT) - 1)), 6) AS high,
 round(2 * least(avg((delta <= 0)::INT), avg((delta >= 0)::INT)), 6) AS p FROM o"""
)
def sta1_sta6_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.interval(_deltas(spark, sf_dir)))


@query(
    f"""{D} SELECT arm, case_id, CASE WHEN verdict IN ('phishing', 'benign') THEN verdict WHEN score >= 0.5 THEN 'phishing' WHEN score IS NOT NULL THEN 'benign' ELSE 'benign' END AS forced,
 CASE WHEN verdict IN ('phishing', 'benign') THEN 'substantive' WHEN score IS NOT NULL THEN 'score' ELSE 'default' END AS origin,
 CASE WHEN score >= 0.5 + 0.2 THEN 'phishing' WHEN score <= 0.5 - 0.2 THEN 'benign' ELSE 'inconclusive' END AS banded,
 CASE WHEN score IS NOT NULL THEN round(1 / (1 + exp(-(1.5 * ln(least(0.99, greatest(0.01, score)) / (1 - least(0.99, greatest(0.01, score)))) + 0.25))), 6) END AS platt FROM d"""
)
def mth1_mth2_mth3_forced_and_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict, origin = numbers.forced_verdict(F.col("verdict"), F.col("score"))
    return rounded(
        decisions(spark, sf_dir).select(
            "arm", "case_id", verdict.alias("forced"), origin.alias("origin"), numbers.band_verdict(F.col("score"), 0.2).alias("banded"), numbers.platt(F.col("score"), 1.5, 0.25).alias("platt")
        )
    )


@query(f"{DM} SELECT arm, split, m.label, count(*) AS n, count(*) FILTER (verdict = m.label) AS right_ones FROM d JOIN m USING (case_id) GROUP BY ALL")
def join1_decisions_with_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir).drop("label", "stratum", "grp")
    j = d.join(cases(spark, sf_dir), "case_id")
    return j.groupBy("arm", "split", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == F.col("label")).alias("right_ones"))


@query(f"{DM}, w AS (SELECT case_id, arm FROM m, (SELECT DISTINCT arm FROM d)) SELECT w.case_id, w.arm FROM w ANTI JOIN (SELECT * FROM d WHERE verdict <> 'inconclusive') x ON w.case_id = x.case_id AND w.arm = x.arm")
def join3_join4_open_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and arms without a substantive decision; the arms are a few names."""
    d = decisions(spark, sf_dir)
    arms = d.select("arm").distinct()
    work = cases(spark, sf_dir).select("case_id").crossJoin(F.broadcast(arms))
    return work.join(d.where("verdict <> 'inconclusive'"), ["case_id", "arm"], "left_anti")


@query(f"{D} SELECT case_id FROM d WHERE score IS NOT NULL GROUP BY case_id HAVING count(DISTINCT arm) = 3")
def join15_set4_cases_all_arms_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = decisions(spark, sf_dir).where("score is not null").groupBy("case_id").agg(F.count_distinct("arm").alias("k"))
    return g.where("k = 3").select("case_id")


@query(f"{D} SELECT x.case_id, x.verdict AS first, y.verdict AS second FROM d x JOIN d y USING (case_id) WHERE x.arm = 'a0' AND y.arm = 'a1' AND (x.verdict IS DISTINCT FROM y.verdict OR x.score IS DISTINCT FROM y.score)")
def join16_reproduction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    a = d.where("arm = 'a0'").select("case_id", F.col("verdict").alias("first"), F.col("score").alias("s1"))
    b = d.where("arm = 'a1'").select("case_id", F.col("verdict").alias("second"), F.col("score").alias("s2"))
    same = F.col("first").eqNullSafe(F.col("second")) & F.col("s1").eqNullSafe(F.col("s2"))
    return a.join(b, "case_id").where(~same).select("case_id", "first", "second")


@query(f"{D} SELECT case_id FROM d WHERE arm = 'a0' EXCEPT ALL SELECT case_id FROM d WHERE arm = 'a1' AND verdict = 'phishing'")
def set3_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    return d.where("arm = 'a0'").select("case_id").exceptAll(d.where("arm = 'a1' and verdict = 'phishing'").select("case_id"))


@query(f"{D} SELECT 'full' AS ledger, verdict, count(*) AS n FROM d WHERE arm = 'a0' GROUP BY ALL UNION ALL SELECT 'ablated', verdict, count(*) FROM d WHERE arm <> 'a0' GROUP BY ALL")
def set1_union_of_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    whole = d.where("arm = 'a0'").withColumn("ledger", F.lit("full")).unionByName(d.where("arm <> 'a0'").withColumn("ledger", F.lit("ablated")), allowMissingColumns=True)
    return whole.groupBy("ledger", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"{D} SELECT arm, count(*) FILTER (verdict NOT IN ('phishing', 'benign', 'inconclusive')) AS bad_verdicts, count(*) - count(DISTINCT case_id) AS repeats, count(DISTINCT model) AS models FROM d GROUP BY arm")
def fil4_fil19_ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(~F.col("verdict").isin("phishing", "benign", "inconclusive"))
    return decisions(spark, sf_dir).groupBy("arm").agg(bad.alias("bad_verdicts"), (F.count(F.lit(1)) - F.count_distinct("case_id")).alias("repeats"), F.count_distinct("model").alias("models"))


@query(
    f"""{DM}, p AS (SELECT case_id, arm, score, CASE WHEN abs(score - 0.05) >= 0.02 THEN CASE WHEN score >= 0.05 THEN 'phishing' ELSE 'benign' END ELSE 'inconclusive' END AS v, label FROM d WHERE score IS NOT NULL)
 SELECT arm, count(*) AS n, round(avg((v <> 'inconclusive')::INT), 6) AS coverage, round(avg((v <> label)::INT) FILTER (v <> 'inconclusive'), 6) AS risk FROM p GROUP BY arm"""
)
def mld17_abstention_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir).where("score is not null")
    sure = F.abs(F.col("score") - 0.05) >= 0.02
    v = F.when(sure, F.when(F.col("score") >= 0.05, "phishing").otherwise("benign")).otherwise("inconclusive")
    d = d.withColumn("v", v)
    risk = F.avg(F.when(F.col("v") != "inconclusive", (F.col("v") != F.col("label")).cast("int")))
    return rounded(d.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("v") != "inconclusive").cast("int")).alias("coverage"), risk.alias("risk")))


@query(
    f"""{D}, g(w) AS (VALUES (0.0), (0.1), (0.2), (0.3), (0.4)), x AS (SELECT arm, w, abs(score * 4 - 0.5) >= w AS done, (CASE WHEN score * 4 >= 0.5 THEN 'phishing' ELSE 'benign' END) <> label AS wrong FROM d, g WHERE score IS NOT NULL)
 , y AS (SELECT arm, w, avg(wrong::INT) FILTER (done) AS risk FROM x GROUP BY ALL) SELECT arm, min(w) AS width FROM y WHERE risk <= 0.5 GROUP BY arm"""
)
def win22_smallest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest half-width whose selective risk is within bounds, over a grid of five."""
    grid = spark.sql("SELECT CAST(col1 AS DECIMAL(2,1)) AS w FROM VALUES (0.0), (0.1), (0.2), (0.3), (0.4)")
    d = decisions(spark, sf_dir).where("score is not null").select("arm", "label", (F.col("score") * 4).alias("s")).crossJoin(F.broadcast(grid))
    wrong = F.when(F.col("s") >= 0.5, "phishing").otherwise("benign") != F.col("label")
    risk = F.avg(F.when(F.abs(F.col("s") - 0.5) >= F.col("w"), wrong.cast("int")))
    return d.groupBy("arm", "w").agg(risk.alias("risk")).where("risk <= 0.5").groupBy("arm").agg(F.min("w").alias("width"))


