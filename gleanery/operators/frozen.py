"""MLD16: a frozen model in the shared folder, applied only if nothing behind it has changed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import learning, ranking


class Refused(ValueError):
    """A frozen model that is not what was frozen."""


def rows_checksum(rows: DataFrame) -> str:
    """A checksum of a table's rows in whatever order: of every row's hash, their sum and number; columns by name."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = rows.select(digest.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s"), F.sum(F.col("h") * F.col("h") % 999999937).alias("q")).first()
    return f"{r.n}:{r.s}:{r.q}"


def rebuilt_threshold(scored: DataFrame, precision: float) -> float | None:
    """MLD9: the lowest score of ``(score, y)`` at which the precision is met; None if none is."""
    label = F.when(F.col("y") == 1, "phishing").otherwise("benign")
    t = ranking.threshold_at_precision(scored.select("score", label.alias("label"), F.lit(0).alias("all")), ["all"], precision).first()
    return t and float(t.threshold)


def _text(body: dict) -> str:
    return json.dumps(body, sort_keys=True)


def freeze(spark: SparkSession, path: str, weights: dict[str, float], intercept: float, training: DataFrame, precision: float) -> None:
    """Store a linear model with the threshold that ``training`` (its columns and ``y``) gives at a precision, the training rows' checksum,
    and a checksum of all that. A training table that reaches the precision nowhere is refused."""
    scored = learning.linear_apply(training, weights, intercept, "score")
    threshold = rebuilt_threshold(scored, precision)
    if threshold is None:
        raise Refused(f"no threshold reaches a precision of {precision}")
    body = {"weights": weights, "intercept": intercept, "precision": precision, "threshold": threshold, "training": rows_checksum(training)}
    line = _text({"model": body, "sha256": hashlib.sha256(_text(body).encode()).hexdigest()})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def thaw(spark: SparkSession, path: str) -> dict:
    """The stored model; refused if the file is not as it was written."""
    rows = spark.read.text(path).collect()  # one line
    try:
        stored = json.loads(rows[0][0])
        body, digest = stored["model"], stored["sha256"]
    except (IndexError, ValueError, KeyError, TypeError) as e:
        raise Refused(f"{path} holds no frozen model") from e
    if len(rows) != 1 or hashlib.sha256(_text(body).encode()).hexdigest() != digest:
        raise Refused(f"{path} changed since the freeze")
    return body


def apply_frozen(path: str, training: DataFrame, rows: DataFrame, out: str = "p", tolerance: float = 1e-9) -> DataFrame:
    """Adds the model's probability and ``flagged`` (at its threshold or above) to ``rows``. Refused if the file, the training rows, or the
    threshold that they give now differ from the freeze."""
    model = thaw(rows.sparkSession, path)
    if rows_checksum(training) != model["training"]:
        raise Refused("training rows changed since the freeze")
    now = rebuilt_threshold(learning.linear_apply(training, model["weights"], model["intercept"], "score"), model["precision"])
    learning.require_thresholds({} if now is None else {"precision": now}, {"precision": model["threshold"]}, tolerance)
    return learning.linear_apply(rows, model["weights"], model["intercept"], out).withColumn("flagged", F.col(out) >= model["threshold"])
