"""The gate: features, the four conjuncts, policies, targets of rounds, and its model, on literal cases."""

import math

import pytest
from gleanery.operators import gate
from pyspark.sql import functions as F

RECORDS = "case_id long, agent string, status string, verdict string"
ITEMS = "case_id long, agent string, ref long, field string, direction string, strength int"


def features(spark, records, items, dropped=(), conflicts=(), solicited=()):
    frames = [spark.createDataFrame(list(r), s) for r, s in ((records, RECORDS), (items, ITEMS), (dropped, "case_id long, ref long"), (conflicts, "case_id long, n long"), (solicited, "case_id long, n long"))]
    return {r.case_id: tuple(round(x, 6) for x in r[1:]) for r in gate.gate_features(*frames).collect()}


def test_features(spark):
    records = [(1, "a", "ran", "phishing"), (1, "b", "ran", "benign"), (1, "c", "no_data", None), (1, "d", "skipped", None), (2, "a", "skipped", None), (3, "a", "not_dispatched", None), (4, "a", "ran", None)]
    items = [
        (1, "a", 1, "f1", "phishing", 3), (1, "a", 2, "f2", "phishing", 2), (1, "a", 3, "f2", "neutral", 1), (1, "b", 4, "f3", "benign", 1), (1, "b", 5, "f3", "benign", 1),
        (1, "c", 6, "f9", "phishing", 3), (4, "a", 7, "f1", "neutral", 1),
    ]
    got = features(spark, records, items, [(1, 5)], [(1, 2)], [(1, 3)])
    # bands: a decisive (4: top 3, two fields, nothing against), b thin (1); item 5 is discounted, c's item is of no record that ran
    assert got[1] == (round(2 / 3, 6), round(1 / 3, 6), 0.6, 0.5, round(2.5 / 4, 6), 0.5)
    assert got[2] == (0, 0, 0, 0, 0, 0) and got[3] == (0, 0, 0, 0, 0, 0)
    assert got[4] == (1, 0, 0, 0, 0, 0)
    wide = [(1, "a", i, f"f{i}", "phishing", 1) for i in range(7)]
    assert features(spark, records[:1], wide)[1][1:4] == (1, 1, 0)  # six or seven fields are no more than five


CASES = [(0.9, True, 0, 5, True), (0.1, True, 0, 5, False), (0.5, True, 0, 5, False), (0.9, False, 0, 5, False), (0.9, True, 2, 5, False), (0.9, True, 1, 0, False)]


def test_policies(spark):
    rows = [(i, p, act, r, left, policy) for i, (p, act, r, left, _) in enumerate(CASES) for policy in gate.POLICIES]
    df = spark.createDataFrame(rows, "i int, p double, actionable boolean, round int, left int, policy string")
    got = {(r.i, r.policy): r.admits for r in gate.gate(df, 0.5, 2).collect()}
    for i, (_, act, _, _, calibrated) in enumerate(CASES):
        assert [got[i, p] for p in gate.POLICIES] == [False, act, act, calibrated]
    with pytest.raises(Exception, match="unknown gate mode: often"):
        gate.gate(df.limit(1).withColumn("policy", F.lit("often")), 0.5, 2).collect()


ISSUES = "case_id long, no int, agents array<string>"


def test_a_tried_route_is_not_actionable(spark):
    issues = spark.createDataFrame([(1, 0, ["url"]), (2, 0, ["url"]), (3, 0, []), (4, 0, ["url", "dns"])], ISSUES)
    tried = spark.createDataFrame([(2, ["url"]), (4, ["url"])], "case_id long, tried array<string>")
    assert sorted(r.case_id for r in gate.actionable(issues, tried).collect()) == [1, 4]


def test_targets_of_rounds(spark):
    issues = [(1, 0, ["url"]), (1, 1, ["url"]), (1, 2, ["dns"]), (1, 3, ["web"]), (2, 0, ["d", "a", "c", "b", "e"]), (3, 0, ["a", "b"]), (3, 1, ["c"])]
    agents = [(c, a) for c in (1, 2, 3) for a in ("url", "dns", "web", "a", "b", "c", "d")]
    frames = spark.createDataFrame(issues, ISSUES), spark.createDataFrame(agents, "case_id long, agent string"), spark.createDataFrame([(3, "a")], "case_id long, agent string")
    got = {}
    for r in gate.round_targets(*frames, 2, 2).orderBy("case_id", "round", "place").collect():
        got.setdefault((r.case_id, r.round), []).append((r.agent, r.no))
    # two issues that name one agent use one place; one issue's agents all count; an inapplicable agent (e) and a tried one are not asked
    assert got == {(1, 0): [("url", 0), ("dns", 2)], (1, 1): [("web", 3)], (2, 0): [("a", 0), ("b", 0), ("c", 0), ("d", 0)], (3, 0): [("b", 0), ("c", 1)]}


def test_model(spark):
    low = [dict.fromkeys(gate.FEATURES, 0.0) | {"Cov": c, "wrong": c < 0.5} for c in (0.1, 0.2, 0.3, 0.7, 0.8, 0.9)]
    df = spark.createDataFrame(low)
    intercept, weights = gate.fit_gate(df, 0.01)
    assert weights["Cov"] < 0 and all(abs(weights[f]) < 1e-6 for f in gate.FEATURES[1:])
    p = {r.Cov: r.p for r in df.withColumn("p", gate.stopping_probability(intercept, weights)).collect()}
    assert p[0.1] > 0.5 > p[0.9] and p[0.1] == pytest.approx(1 / (1 + math.exp(-intercept - 0.1 * weights["Cov"])))
    # the plain descent of the penalised mean loss ends where the fit does
    w, b = 0.0, 0.0
    for _ in range(20000):
        g = [(1 / (1 + math.exp(-b - w * r["Cov"])) - r["wrong"]) / len(low) for r in low]
        w, b = w - 0.5 * (sum(x * r["Cov"] for x, r in zip(g, low, strict=True)) + 0.01 * w), b - 0.5 * sum(g)
    assert (weights["Cov"], intercept) == (pytest.approx(w, abs=1e-3), pytest.approx(b, abs=1e-3))
    with pytest.raises(ValueError, match="both"):
        gate.fit_gate(df.withColumn("wrong", F.lit(False)))
    cases = spark.range(4000).where(gate.held_out(F.col("id"))).count()
    assert 900 < cases < 1100
