"""Learning queries over the labelled documents: features, folds, models, calibration. SQL has no fitting, so those that
fit have none; tests check them against a plain solver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import learning as L
from gleanery.operators import frozen
from gleanery.operators.corpus import folds
from gleanery.plans.registry import query, rounded
from gleanery.sources.shared import materialize, new_path
from gleanery.sources.tables import read_table

FOLDS = range(5)
COLUMNS = ["log_length", "stars", "pipes", "digits", "upper"]
FEATURES = """x AS (SELECT doc_id, source, CAST(quality AS DOUBLE) AS y, ln(1 + len(text)) AS log_length, len(regexp_extract_all(text, '[*]')) / (1 + len(text)) AS stars,
 len(regexp_extract_all(text, '[|]')) / (1 + len(text)) AS pipes, len(regexp_extract_all(text, '[0-9]')) / (1 + len(text)) AS digits, len(regexp_extract_all(text, '[A-Z]')) / (1 + len(text)) AS upper
 FROM documents JOIN labels USING (doc_id))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with five text features; the wide text is dropped before anything is shuffled again."""
    t = F.col("text")
    share = {n: F.regexp_count(t, F.lit(p)) / (1 + F.length(t)) for n, p in (("stars", "[*]"), ("pipes", "[|]"), ("digits", "[0-9]"), ("upper", "[A-Z]"))}
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.log1p(F.length(t).cast("double")).alias("log_length"), *[c.alias(n) for n, c in share.items()])
    return d.join(read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised features in five folds of whole sources, written once for all fits."""
    return L.assemble(materialize(folds(L.standardise(features(spark, sf_dir), COLUMNS), "source", len(FOLDS), "f"), "features"), COLUMNS)


@query(f"WITH {FEATURES} SELECT doc_id, y, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / greatest(stddev_pop({c}) OVER (), 1e-9), 5) AS {c}" for c in COLUMNS) + " FROM x")
def mld2_standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.standardise(features(spark, sf_dir), COLUMNS).select("doc_id", "y", *COLUMNS), 5)


@query()
def mld3_out_of_fold_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.out_of_fold(_ready(spark, sf_dir), FOLDS, 0.01).select("doc_id", "fold", "y", F.round("p", 3).alias("p"))


@query()
def mld4_penalty_by_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold log loss of two penalties over five folds, and the choice."""
    return rounded(L.choose_reg(_ready(spark, sf_dir), FOLDS, [0.001, 0.1]), 4)


@query()
def mld5_class_weighted_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _ready(spark, sf_dir).withColumn("w", F.when(F.col("y") == 0, 2.0).otherwise(1.0))
    return L.probability(L.logistic(df, 0.01, "w"), df).select("doc_id", "y", F.round("p", 3).alias("p"))


@query()
def mld6_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rounds of depth-one trees."""
    df = _ready(spark, sf_dir)
    return L.probability(L.boosted(df, 1, 100), df).select("doc_id", "y", F.round("p", 3).alias("p"))


@query()
def mld7_learner_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three learners by five folds of whole sources: one is taken over the plain logistic one only if it beats it both in recall at
    a precision of 0.95 and in average precision."""
    df = _ready(spark, sf_dir).withColumn("w", F.when(F.col("y") == 0, 2.0).otherwise(1.0))
    fits = {"logistic": None, "weighted": lambda d: L.logistic(d, 0.01, "w"), "stumps": lambda d: L.boosted(d, 1, 20)}
    scored = {n: materialize(L.out_of_fold(df, FOLDS, 0.01, fit).select("doc_id", "y", "p"), "scored") for n, fit in fits.items()}
    return rounded(L.choose_learner(scored, "logistic"), 4)


@query()
def mld8_mld11_mld12_calibrated_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The out-of-fold score calibrated on one fold and applied to the others, routed by length, with a high override."""
    from gleanery.functions.numbers import clipped_logit

    oof = L.out_of_fold(_ready(spark, sf_dir), FOLDS, 0.01).select("doc_id", "fold", "y", "log_length", F.col("p").alias("score"))
    model = L.platt_fit(oof.where("fold = 0"))
    rest = L.assemble(oof.where("fold <> 0").withColumn("logit", clipped_logit(F.col("score"))), ["logit"])
    cal = L.probability(model, rest)
    said = L.route(F.col("log_length") > 0, F.col("p"), F.col("score"), 0.6, 0.5)
    return cal.select("doc_id", "y", F.round("p", 3).alias("p"), L.override(said, F.col("p"), 0.99).alias("verdict"))


WEIGHTS = {"log_length": 0.5, "stars": -20.0, "pipes": -10.0, "digits": 1.0, "upper": -3.0}
PRECISION = 0.9


@query(
    f"""WITH {FEATURES}, p AS (SELECT doc_id, y, 1 / (1 + exp(-(-2.0 + 0.5 * log_length - 20.0 * stars - 10.0 * pipes + 1.0 * digits - 3.0 * upper))) AS p FROM x), g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM p WHERE doc_id % 3 > 0 GROUP BY p),
 c AS (SELECT p, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT doc_id, round(p, 6) AS p, p >= (SELECT min(p) FROM c WHERE tp >= {PRECISION} * k) - 1e-12 AS flagged FROM p"""
)
def mld16_frozen_linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model frozen in the shared folder with the threshold of two thirds of the documents, then applied to all, once the file, the
    training rows and the threshold that they give are found as they were."""
    x = features(spark, sf_dir)
    training, path = x.where("doc_id % 3 > 0").drop("source"), new_path(spark, "frozen")
    frozen.freeze(spark, path, WEIGHTS, -2.0, training, PRECISION)
    return rounded(frozen.apply_frozen(path, training, x).select("doc_id", "p", "flagged"))
