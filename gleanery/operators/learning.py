"""Feature assembly, standardisation, logistic models with folds and calibration, boosted trees, routing. Spark ML does the fitting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators import ranking
from gleanery.operators.metrics import PHISHING


def standardise(df: DataFrame, columns: Sequence[str], floor: float = 1e-9) -> DataFrame:
    """MLD2: by the population deviation, never below ``floor``."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = {c: (F.col(c) - F.lit(row[f"m_{c}"] or 0.0)) / F.lit(max(row[f"s_{c}"] or 0.0, floor)) for c in columns}
    return df.withColumns(scale)


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """MLD1, MLD13: the named columns as one vector."""
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(df)


def logistic(df: DataFrame, reg: float, weight: str | None = None, rounds: int = 100):
    """MLD3, MLD5: L2 logistic regression, intercept unpenalised; ``weight`` names a column of row weights."""
    lr = LogisticRegression(labelCol="y", regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=1e-9)
    return (lr.setWeightCol(weight) if weight else lr).fit(df)


def boosted(df: DataFrame, depth: int, rounds: int, seed: int = 7):
    """MLD6: boosted shallow trees."""
    return GBTClassifier(labelCol="y", maxDepth=depth, maxIter=rounds, stepSize=0.1, minInstancesPerNode=10, seed=seed).fit(df)


def probability(model, df: DataFrame, out: str = "p") -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), p))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def out_of_fold(df: DataFrame, folds: Sequence[int], reg: float, fit: Callable | None = None) -> DataFrame:
    """MLD7: each fold's rows scored by the model of the other folds: a logistic one, or what ``fit`` makes of the rows."""
    parts = None
    for k in folds:
        others = df.where(F.col("fold") != k)
        scored = probability(fit(others) if fit else logistic(others, reg), df.where(F.col("fold") == k))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def choose_reg(df: DataFrame, folds: Sequence[int], grid: Sequence[float]) -> DataFrame:
    """MLD4: out-of-fold log loss of each penalty of a grid, the least chosen (the larger penalty where two are equal)."""
    rows = None
    for reg in grid:
        one = out_of_fold(df, folds, reg).agg(log_loss(F.col("p"), F.col("y")).alias("loss")).withColumn("reg", F.lit(reg))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.agg(F.min_by("reg", F.struct("loss", -F.col("reg"))).alias("best"))
    return rows.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("reg") == F.col("best")).drop("best")  # one row


def choose_learner(scored: dict[str, DataFrame], reference: str, precision: float = 0.95) -> DataFrame:
    """MLD7: out-of-fold recall at a precision and average precision of each learner; of those better than the reference on both,
    the best is chosen, and the reference where there is none. ``scored`` has ``doc_id``, ``y`` and ``p``."""
    rows = None
    for name, df in scored.items():
        d = df.select(F.lit(name).alias("learner"), F.col("doc_id").alias("case_id"), F.when(F.col("y") > 0, PHISHING).otherwise("benign").alias("label"), F.col("p").alias("score"))
        rows = d if rows is None else rows.unionByName(d)
    found = ranking.threshold_at_precision(rows, ["learner"], precision).select("learner", "recall")
    t = ranking.average_precision(rows, ["learner"]).join(found, "learner", "left").fillna(0.0, ["recall"])
    ref = F.broadcast(t.where(F.col("learner") == reference).select(F.col("recall").alias("r0"), F.col("ap").alias("a0")))  # one row
    t = t.crossJoin(ref).withColumn("better", (F.col("recall") > F.col("r0")) & (F.col("ap") > F.col("a0"))).drop("r0", "a0")
    best = t.agg(F.coalesce(F.max_by("learner", F.when(F.col("better"), F.struct("recall", "ap", "learner"))), F.lit(reference)).alias("best"))
    return t.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("learner") == F.col("best")).drop("best")


def require_thresholds(rebuilt: dict[str, float], frozen: dict[str, float], tolerance: float = 1e-9) -> None:
    """MLD16: refuses to apply a frozen model whose thresholds do not come out again."""
    for name, value in frozen.items():
        if name not in rebuilt or abs(rebuilt[name] - value) > tolerance:
            raise ValueError(f"threshold {name}: frozen {value}, rebuilt {rebuilt.get(name)}")


def platt_fit(df: DataFrame):
    """MLD8: one-feature logistic on the clipped logit of a score."""
    from gleanery.functions.numbers import clipped_logit

    return logistic(assemble(df.withColumn("logit", clipped_logit(F.col("score"))), ["logit"]), 0.0)


def route(complete: Column, a: Column, b: Column, threshold_a: float, threshold_b: float) -> Column:
    """MLD11: the complete-evidence model where all evidence is there, else the other, each with its threshold."""
    return F.when(complete, a >= threshold_a).otherwise(b >= threshold_b)


def override(verdict: Column, p: Column, high: float) -> Column:
    """MLD12: a very high probability decides."""
    return F.when(p >= high, True).otherwise(verdict)


def linear_apply(df: DataFrame, weights: dict[str, float], intercept: float, out: str = "p") -> DataFrame:
    """MLD16: a frozen linear model's probability, from stored weights."""
    z = F.lit(intercept)
    for c, w in weights.items():
        z = z + F.lit(w) * F.col(c)
    return df.withColumn(out, 1 / (1 + F.exp(-z)))
