"""The draws of resamples: those of the hashes, counted without a row for each."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from gleanery.operators import paired
from pyspark.sql import functions as F


def plain(resample, n):
    """The numbers of the cases drawn, hash by hash."""
    out = []
    for g in range((n + 3) // 4):
        h = hashlib.md5(f"{resample}|{g}".encode()).hexdigest()
        out += [int(h[8 * i : 8 * i + 8], 16) % n for i in range(4) if 4 * g + i < n]
    return out


@pytest.mark.parametrize("n", [1, 3, 41, 4003, 70001])
def test_draws_are_those_of_the_hashes(n):
    for b in (0, 9, 10, 1999):
        assert [list(d) for _, d in paired.kinds_drawn([b], np.arange(n))] == [plain(b, n)]


def counted(spark, cases, columns, resamples):
    """Multiplicities by resample and values, from the plain draws."""
    numbered = {r.no: tuple(r[c] for c in columns) for r in paired.number_rows(cases, "case_id").collect()}
    return Counter((b, *numbered[i]) for b in range(resamples) for i in plain(b, len(numbered)))


def test_no_draw_becomes_a_row(spark):
    cases = spark.range(1001).select(F.col("id").alias("case_id"), (F.col("id") % 3).alias("v"))
    t = paired.resample(cases, 3)
    assert "Generate" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.b, r.v): r.k for r in t.collect()} == counted(spark, cases, ["v"], 3)


def test_cases_of_several_runs_meet_their_draws_with_null_values(spark):
    v = [F.when(F.col("id") % m > 0, F.concat(F.lit(f"v{m}"), F.col("id") % m)).alias(f"v{m}") for m in (2, 3, 5)]
    cases = spark.range(500).select(F.col("id").alias("case_id"), *v)
    t = paired.resample(cases, 4)
    assert "Generate" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.b, r.v2, r.v3, r.v5): r.k for r in t.collect()} == counted(spark, cases, ["v2", "v3", "v5"], 4)
    assert paired.resample(cases.limit(0), 4).count() == 0


def test_paired_f1_differences_are_those_of_the_plain_draws(spark):
    pick = lambda m: F.when(F.col("id") * m % 7 < 3, "phishing").otherwise("benign")
    cases = spark.range(203).select(F.col("id").alias("case_id"), pick(1).alias("label"), pick(3).alias("one"), pick(5).alias("two"))
    rows = {r.no: r for r in paired.number_rows(cases, "case_id").collect()}

    def f1(drawn, arm):
        tp = sum(r.label == "phishing" == r[arm] for r in drawn)
        return 2 * tp / (2 * tp + sum(r.label != r[arm] for r in drawn))

    t = paired.bootstrap_f1(cases, 3)
    assert "Generate" not in t._jdf.queryExecution().optimizedPlan().toString()
    for r in t.collect():
        drawn = [rows[i] for i in plain(r.b, 203)]
        assert r.delta == pytest.approx(f1(drawn, "two") - f1(drawn, "one"))


def test_mean_differences_are_those_of_the_plain_draws(spark):
    cases = spark.range(150).select(F.col("id").alias("case_id"), (F.col("id") * 31 % 17 - 8).alias("diff"))
    of = {r.no: r["diff"] for r in paired.number_rows(cases, "case_id").collect()}
    t = paired.resample(cases, 3)
    assert "Generate" not in t._jdf.queryExecution().optimizedPlan().toString()
    means = t.groupBy("b").agg((F.sum(F.col("k") * F.col("diff")) / F.sum("k")).alias("x"))
    assert {r.b: pytest.approx(r.x) for r in means.collect()} == {b: sum(of[i] for i in plain(b, 150)) / 150 for b in range(3)}
