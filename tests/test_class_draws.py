"""Draws by class: their law, their cost, and the rates that STA2 and STA3 take from them; calibrated routes and feature subsets."""

import math

import numpy as np
import pytest
from gleanery.operators import learning, paired
from pyspark.sql import functions as F


def drawn(spark, classes, resamples, stream="s"):
    df = spark.createDataFrame(classes, "label string, score double, n long")
    rows = paired.class_draws(df, "n", resamples, stream).collect()
    out = np.zeros((resamples, len(classes)), np.int64)
    index = {(c[0], c[1]): i for i, c in enumerate(classes)}
    for r in rows:
        assert r.k > 0
        out[r.b, index[r.label, r.score]] += r.k
    return out


CLASSES = [("phishing", 0.9, 50), ("phishing", 0.4, 30), ("benign", 0.9, 10), ("benign", 0.2, 110), ("benign", None, 0)]


def test_each_resample_has_all_draws_and_reruns_agree(spark):
    k = drawn(spark, CLASSES, 400)
    assert (k.sum(axis=1) == 200).all() and not k[:, 4].any()
    assert (k == drawn(spark, CLASSES, 400)).all() and not (k == drawn(spark, CLASSES, 400, "t")).all()


def test_the_law_is_that_of_single_draws(spark):
    k = drawn(spark, CLASSES, 4000)[:, :4].astype(float)
    n, p = 200, np.array([0.25, 0.15, 0.05, 0.55])
    var = n * p * (1 - p)
    assert np.abs(k.mean(axis=0) - n * p).max() < 4 * np.sqrt(var.max() / 4000)
    assert np.allclose(k.var(axis=0), var, rtol=0.12)
    cov = np.cov(k.T)
    assert np.allclose(cov[~np.eye(4, dtype=bool)], (-n * np.outer(p, p))[~np.eye(4, dtype=bool)], atol=0.12 * var.max())
    # one margin as a whole, against the binomial
    seen = np.bincount(k[:, 2].astype(int), minlength=30)[:30] / 4000
    want = [math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(30)]
    assert np.abs(np.cumsum(seen) - np.cumsum(want)).max() < 1.95 / math.sqrt(4000)


def test_a_hundred_million_cases_cost_as_much_as_their_kinds(spark):
    k = drawn(spark, [("phishing", 0.9, 60_000_000), ("benign", 0.1, 40_000_000)], 300)
    assert (k.sum(axis=1) == 100_000_000).all()
    assert abs(k[:, 0].std() / math.sqrt(1e8 * 0.24) - 1) < 0.2


def test_many_classes_in_several_buckets(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("n"))
    t = paired.class_draws(df, "n", 5, "x", rows=100).groupBy("b").agg(F.sum("k").alias("k"), F.count_distinct("id").alias("ids"))
    assert [(r.b, r.k) for r in t.orderBy("b").collect()] == [(b, 3000) for b in range(5)]
    assert paired.class_draws(df.limit(0), "n", 5, "x").count() == 0


def test_threshold_rechosen_in_each_resample(spark):
    rows = [(0, "phishing", 0.9, 6), (0, "phishing", 0.5, 3), (0, "phishing", 0.1, 1), (0, "benign", 0.9, 1), (0, "benign", 0.5, 1), (0, "benign", 0.2, 2), (1, "phishing", 0.3, 2), (1, "benign", 0.3, 5), (2, "benign", 0.3, 5)]
    got = {r.b: (r.threshold, r.fpr) for r in paired.rechosen_rates(spark.createDataFrame(rows, "b long, label string, score double, k long"), 0.9).collect()}
    assert got[0] == (0.5, 0.5) and got[1] == (0.3, 1.0)  # 0.9 of ten positives are the nine from 0.5 up


def test_accuracy_of_two_samples_moves_as_it_should(spark):
    kinds = lambda good, bad: spark.createDataFrame([(1.0, good), (0.0, bad)], "ok double, n long")
    mean = F.sum(F.col("k") * F.col("ok")) / F.sum("k")
    a, b = (paired.class_draws(kinds(*x), "n", 3000, s).groupBy("b").agg(mean.alias(s)) for x, s in (((70, 30), "s0"), ((160, 40), "s1")))
    delta = np.array([r.s1 - r.s0 for r in a.join(b, "b").collect()])
    sd = math.sqrt(0.7 * 0.3 / 100 + 0.8 * 0.2 / 200)
    assert abs(delta.mean() - 0.1) < 4 * sd / math.sqrt(3000) and abs(delta.std() / sd - 1) < 0.06


def test_routes_and_overrides(spark):
    rows = [(True, 0.7, 0.1), (True, 0.5, 0.9), (False, 0.9, 0.4), (False, 0.1, 0.6), (True, 0.995, 0.0)]
    df = spark.createDataFrame(rows, "complete boolean, a double, b double")
    said = learning.route(F.col("complete"), F.col("a"), F.col("b"), 0.6, 0.5)
    got = [(r.x, r.y) for r in df.select(said.alias("x"), learning.override(~said, F.col("a"), 0.99).alias("y")).collect()]
    assert got == [(True, False), (False, True), (False, True), (True, False), (True, True)]


def test_a_calibrated_score_is_a_logistic_of_its_clipped_logit(spark):
    rng = np.random.default_rng(1)
    score = rng.uniform(0, 1, 4000)
    z = np.log(np.clip(score, 0.01, 0.99) / (1 - np.clip(score, 0.01, 0.99)))
    y = (rng.uniform(0, 1, 4000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    model = learning.platt_fit(spark.createDataFrame(list(zip(score.tolist(), y.tolist(), strict=True)), "score double, y double"))
    a, b = float(model.coefficients[0]), float(model.intercept)
    for _ in range(50):  # Newton's steps on the same sum
        p = 1 / (1 + np.exp(-(a * z + b)))
        g, h = np.array([((p - y) * z).sum(), (p - y).sum()]), np.array([[(p * (1 - p) * z * z).sum(), (p * (1 - p) * z).sum()], [(p * (1 - p) * z).sum(), (p * (1 - p)).sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    assert (float(model.coefficients[0]), float(model.intercept)) == (pytest.approx(a, abs=1e-4), pytest.approx(b, abs=1e-4))
    assert abs(a - 0.5) < 0.08 and abs(b + 1) < 0.12


def test_subsets_leave_the_other_columns_out(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 2))
    y = (rng.uniform(0, 1, 600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    loss = {}
    for columns in (["a"], ["b"], ["a", "b"]):
        v = learning.assemble(df, columns)
        model = learning.logistic(v, 0.001)
        assert len(model.coefficients) == len(columns)
        loss["".join(columns)] = learning.probability(model, v).agg(learning.log_loss(F.col("p"), F.col("y"))).first()[0]
    assert loss["ab"] <= loss["a"] + 1e-9 < loss["b"] - 0.1
