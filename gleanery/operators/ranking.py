"""Ranking metrics, thresholds and operating points. Rows are first counted per distinct score, so what a window orders
is the much smaller table of scores; only average precision needs the order inside a score, by case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.metrics import PHISHING


def _bad() -> Column:
    return (F.col("label") == PHISHING).cast("long")


def score_table(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and distinct score: positives and negatives at it, and at it or above (``tp``, ``fp``)."""
    t = df.where("score is not null").groupBy(*by, "score").agg(F.sum(_bad()).alias("pos"), F.sum(1 - _bad()).alias("neg"))
    down = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    return t.select(
        "*",
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(every).alias("p"),
        F.sum("neg").over(every).alias("n"),
    )


def average_precision(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """WIN7: mean over positives of tp / rank in the order of falling score, ties by case; null if any score is missing."""
    t = score_table(df, by).select(*by, "score", (F.col("tp") - F.col("pos")).alias("tp0"), (F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")).alias("r0"))
    tie = Window.partitionBy(*by, "score").orderBy("case_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("bad", _bad()).withColumn("i", F.row_number().over(tie)).withColumn("k", F.sum("bad").over(tie))
    rows = rows.join(t, [*by, "score"], "left")
    part = F.when(F.col("bad") == 1, (F.col("tp0") + F.col("k")) / (F.col("r0") + F.col("i")))
    missing = F.bool_or(F.col("score").isNull())
    ap = F.when(~missing, F.try_divide(F.sum(part), F.sum("bad").cast("double")))
    return rows.groupBy(*by).agg(ap.alias("ap"))


def roc_auc(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """WIN8: by mid-ranks: a tie counts half."""
    t = score_table(df, by)
    below = F.col("n") - F.col("fp")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return t.groupBy(*by).agg(F.try_divide(area, F.max(F.col("p") * F.col("n")).cast("double")).alias("auc"))


def threshold_at_precision(df: DataFrame, by: Sequence[str], target: float) -> DataFrame:
    """WIN9: the lowest score at which the precision of all rows at or above it meets the target, and the recall there."""
    t = score_table(df, by).where(F.col("tp") >= target * (F.col("tp") + F.col("fp")))
    return t.groupBy(*by).agg(F.min("score").alias("threshold"), F.max(F.col("tp") / F.col("p")).alias("recall"))


def at_recall(df: DataFrame, by: Sequence[str], recall: float) -> DataFrame:
    """WIN10: the k-th largest positive score, k = ceil(recall * P - 1e-9), and the false positive rate at it."""
    t = score_table(df, by).where(F.col("tp") >= F.ceil(F.col("p") * recall - 1e-9))
    return t.groupBy(*by).agg(F.max("score").alias("threshold"), F.min(F.try_divide("fp", "n")).alias("fpr"), F.min(F.try_divide("tp", "p")).alias("tpr"))


def at_false_positives(df: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    """WIN11: the share of positives strictly above the (floor(alpha N) + 1)-th largest negative."""
    t = score_table(df, by).where(F.col("fp") <= F.floor(F.col("n") * alpha))
    return t.groupBy(*by).agg(F.max(F.try_divide("tp", "p")).alias("tpr"))


def holm(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """WIN13 and STA8: Holm's step-down: the running maximum of (m - i) p, at most 1."""
    order = Window.partitionBy(*by).orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    scaled = (m - F.row_number().over(order) + 1) * F.col(p)
    t = df.withColumn("scaled", scaled)
    return t.withColumn("p_holm", F.least(F.lit(1.0), F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("scaled")


def grid_rates(df: DataFrame, grid: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG35: for each threshold of a small grid, the share of rows that stop at it and their error rate."""
    counts = df.where("score is not null").groupBy(*by, "score").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("wrong").cast("long")).alias("bad"))
    at = counts.crossJoin(F.broadcast(grid)).withColumn("stop", F.col("score") >= F.col("tau"))
    stop, bad = F.sum(F.when(F.col("stop"), F.col("k")).otherwise(0)), F.sum(F.when(F.col("stop"), F.col("bad")).otherwise(0))
    return at.groupBy(*by, "tau").agg((stop / F.sum("k")).alias("stopped"), F.try_divide(bad.cast("double"), stop.cast("double")).alias("error"))


def largest_threshold(df: DataFrame, grid: Sequence[float], most: float) -> DataFrame:
    """WIN23: the largest threshold of a small grid at or below which stopped rows err in at most a share ``most``, and whether
    there is one; the grid's smallest where there is none. ``df`` has ``score`` and a boolean ``error``."""
    counts = df.groupBy("score").agg(F.count(F.lit(1)).alias("k"), F.count_if("error").alias("bad"))
    taus = F.explode(F.array(*map(F.lit, grid))).alias("tau")
    at = counts.select("*", taus).where("score <= tau").groupBy("tau").agg((F.sum("bad") / F.sum("k")).alias("rate"))
    ok = F.max(F.when(F.col("rate") <= most, F.col("tau")))
    return at.agg(F.coalesce(ok, F.lit(min(grid))).alias("tau"), ok.isNotNull().alias("met"))


def agent_auc(cases: DataFrame, scores: str, y: str) -> DataFrame:
    """AGG40: from a map of agents' scores a case: on how many cases each agent ran, how often it returned a score, and the area
    under its curve; a row ``mean`` averages the agents."""
    rows = cases.select(F.explode(scores).alias("agent", "score"), F.when(F.col(y) == 1, PHISHING).otherwise("benign").alias("label"))
    n = rows.groupBy("agent").agg(F.count(F.lit(1)).alias("ran"), (F.count("score") / F.count(F.lit(1))).alias("returned"))
    each = n.join(roc_auc(rows, ["agent"]), "agent", "left").select("agent", "ran", "returned", "auc")
    return each.unionByName(each.agg(F.lit("mean").alias("agent"), F.sum("ran").alias("ran"), F.avg("returned").alias("returned"), F.avg("auc").alias("auc")))
