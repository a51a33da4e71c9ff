"""Fits and choices against plain versions: class weights, penalties, calibration, learners, trees by the ranking they give."""

import numpy as np
import pytest
from gleanery.operators import learning as L
from pyspark.sql import functions as F


def newton(x, y, lam, weight=None, rounds=80):
    """Mean weighted log loss with lam / 2 |w|^2, intercept free."""
    w, z = np.zeros(x.shape[1] + 1), np.c_[x, np.ones(len(x))]
    k = np.ones(len(x)) if weight is None else weight
    reg = np.diag([lam] * x.shape[1] + [0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (k * (p - y)) / k.sum() + reg @ w
        w -= np.linalg.solve((z * (k * p * (1 - p))[:, None]).T @ z / k.sum() + reg, g)
    return w


def sample(n=90, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    return x, (x[:, 0] - 0.5 * x[:, 1] + r.normal(size=n) > 0.3).astype(float)


def frame(spark, x, y):
    rows = [(i, float(a), float(b), float(t), i % 5) for i, ((a, b), t) in enumerate(zip(x, y))]
    return L.assemble(spark.createDataFrame(rows, "doc_id int, a double, b double, y double, fold int"), ["a", "b"])


def test_class_weights(spark):
    x, y = sample()
    df = frame(spark, x, y).withColumn("w", F.when(F.col("y") == 0, 2.0).otherwise(1.0))
    m = L.logistic(df, 0.05, "w")
    assert np.allclose([*m.coefficients, m.intercept], newton(x, y, 0.05, np.where(y == 0, 2.0, 1.0)), atol=1e-4)


def test_penalty_is_chosen_by_out_of_fold_loss(spark):
    x, y = sample()
    fold, want = np.arange(len(y)) % 5, {}
    for lam in (0.001, 0.1, 3.0):
        p = np.zeros(len(y))
        for k in range(5):
            w = newton(x[fold != k], y[fold != k], lam)
            p[fold == k] = 1 / (1 + np.exp(-np.c_[x, np.ones(len(x))][fold == k] @ w))
        want[lam] = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    got = L.choose_reg(frame(spark, x, y), range(5), list(want)).collect()
    assert {r.reg: r.loss for r in got} == pytest.approx(want, abs=1e-4)
    assert [r.reg for r in got if r.chosen] == [min(want, key=want.get)]


def test_platt_step(spark):
    r = np.random.default_rng(4)
    s = np.clip(r.beta(2, 2, 200), 0.001, 0.999)
    y = (r.random(200) < s**2).astype(float)
    m = L.platt_fit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y)], "score double, y double"))
    q = np.clip(s, 0.01, 0.99)
    assert np.allclose([*m.coefficients, m.intercept], newton(np.log(q / (1 - q))[:, None], y, 0.0), atol=1e-3)


def test_trees_rank_what_no_line_can(spark):
    x, _ = sample(300, 6)
    y = (x[:, 0] ** 2 > 0.6).astype(float)
    df = frame(spark, x, y)
    auc = {}
    for name, fit in (("line", lambda d: L.logistic(d, 0.01)), ("trees", lambda d: L.boosted(d, 2, 10))):
        p = np.array([r.p for r in L.out_of_fold(df, range(5), 0.01, fit).orderBy("doc_id").collect()])
        auc[name] = np.mean(p[y == 1][:, None] > p[y == 0][None])
    assert auc["trees"] > 0.95 and auc["line"] < 0.7


def test_a_learner_must_beat_the_reference_on_both(spark):
    y = [1, 1, 1, 0, 0, 0]
    scores = {"ref": [0.9, 0.5, 0.3, 0.4, 0.2, 0.1], "good": [0.9, 0.8, 0.7, 0.3, 0.2, 0.1], "same": [0.9, 0.5, 0.3, 0.4, 0.2, 0.1], "worse": [0.1, 0.2, 0.3, 0.9, 0.8, 0.7]}
    rows = {n: spark.createDataFrame([(i, float(t), p) for i, (t, p) in enumerate(zip(y, s))], "doc_id int, y double, p double") for n, s in scores.items()}
    got = {r.learner: (round(r.recall, 4), r.better, r.chosen) for r in L.choose_learner(rows, "ref").collect()}
    assert got == {"ref": (0.6667, False, False), "good": (1.0, True, True), "same": (0.6667, False, False), "worse": (0.0, False, False)}
    del rows["good"]
    assert [r.learner for r in L.choose_learner(rows, "ref").where("chosen").collect()] == ["ref"]


def test_frozen_thresholds_must_come_out_again():
    L.require_thresholds({"a": 0.5, "b": 0.1}, {"a": 0.5})
    for rebuilt in ({}, {"a": 0.51}):
        with pytest.raises(ValueError):
            L.require_thresholds(rebuilt, {"a": 0.5})
