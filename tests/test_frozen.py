"""Frozen models, ledgers by file, evidence lines, the yield of rounds, and folds: literal cases."""

import json
import random

import pytest
from gleanery.functions import texts
from gleanery.operators import corpus, evidence, frozen, metrics
from gleanery.sources.shared import new_path
from pyspark.sql import functions as F

TRAINING = [(i, float(i), int(i >= 6 or i == 2)) for i in range(10)]


def training(spark, rows=TRAINING):
    return spark.createDataFrame(rows, "k long, x double, y int")


@pytest.fixture
def stored(spark):
    path = new_path(spark, "frozen")
    frozen.freeze(spark, path, {"x": 1.0}, -5.0, training(spark), 0.9)
    return path


def test_a_frozen_model_applies_to_new_rows(spark, stored):
    new = spark.createDataFrame([(1, 5.9), (2, 6.0), (3, 60.0)], "k long, x double")
    assert [r.flagged for r in frozen.apply_frozen(stored, training(spark), new).orderBy("k").collect()] == [False, True, True]
    shuffled = training(spark, random.Random(1).sample(TRAINING, 10)).select("y", "x", "k").repartition(3)
    assert frozen.apply_frozen(stored, shuffled, new).count() == 3  # the order of rows and columns is no change


def test_a_changed_row_refuses(spark, stored):
    for rows in ([*TRAINING[:-1], (9, 9.0, 0)], TRAINING[:-1], [*TRAINING, TRAINING[0]], [(100, *TRAINING[0][1:]), *TRAINING[1:]]):
        with pytest.raises(frozen.Refused, match="training rows"):
            frozen.apply_frozen(stored, training(spark, rows), training(spark))


def test_a_changed_file_refuses(spark, stored):
    body = frozen.thaw(spark, stored)
    assert (body["threshold"], body["weights"]) == (pytest.approx(0.7310585786), {"x": 1.0})
    body["weights"]["x"] = 1.01
    text = json.dumps({"model": body, "sha256": json.loads(spark.read.text(stored).first()[0])["sha256"]}, sort_keys=True)
    for value in (text, "{", "", '{"model": 1}'):
        path = new_path(spark, "changed")
        spark.createDataFrame([(value,)], "value string").write.text(path)
        with pytest.raises(frozen.Refused):
            frozen.apply_frozen(path, training(spark), training(spark))


def test_a_threshold_that_does_not_come_out_again_refuses(spark, stored):
    body = frozen.thaw(spark, stored) | {"threshold": 0.75}
    text = json.dumps({"model": body, "sha256": frozen.hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}, sort_keys=True)
    path = new_path(spark, "forged")
    spark.createDataFrame([(text,)], "value string").write.text(path)
    with pytest.raises(ValueError, match="threshold precision"):
        frozen.apply_frozen(path, training(spark), training(spark))
    with pytest.raises(frozen.Refused, match="no threshold"):
        frozen.freeze(spark, new_path(spark, "none"), {"x": -1.0}, 0.0, training(spark), 0.99)


def test_cost_by_ledger(spark):
    path = new_path(spark, "ledgers")
    row = lambda **x: json.dumps({"kind": "decision", "model_id": "m", "input_tokens": 1_000_000, "output_tokens": 500_000} | x)
    ledgers = {
        "one.jsonl": [row(), row(model_id="n", output_tokens=None), row(parent_object_id="o1"), row(kind="record"), row(model_id="free"), "{broken"],
        "two.jsonl": [row(), row()], "two.failures.jsonl": [row()], "three.csv": [row()],
    }
    for name, lines in ledgers.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/{name}")
    got = {(r.model, r.file): (r.n, r.tokens_in, r.tokens_out, r.usd) for r in metrics.cost_by_file(spark, f"{path}/*", (("m", 2.0, 4.0), ("n", 1.0, 1.0))).collect()}
    m = 1_000_000
    assert got == {
        ("m", "one.jsonl"): (1, m, m // 2, 4.0), ("m", "two.jsonl"): (2, 2 * m, m, 8.0), ("n", "one.jsonl"): (1, m, 0, 1.0), ("m", None): (3, 3 * m, 3 * m // 2, 12.0),
        ("n", None): (1, m, 0, 1.0), (None, None): (4, 4 * m, 3 * m // 2, 13.0),
    }


def lines(spark, f, text, **limits):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    return [r.line for r in f(df, "k", "t", **limits).orderBy("no").collect()]


def test_evidence_lines(spark):
    text = "Sign  in now!  Your account? OK\n\nsign in NOW!\n a \n3.5 apples. No\t" + "x" * 250
    assert lines(spark, texts.evidence_lines, text) == ["Sign in now!", "Your account?", "3.5 apples.", "No " + "x" * 196 + "…"]
    assert lines(spark, texts.evidence_lines, "\n".join(f"line {i}" for i in range(60)))[-1] == "line 39"
    assert lines(spark, texts.evidence_lines, "one. two. three.", most=2, chars=3) == ["on…", "tw…"] and lines(spark, texts.evidence_lines, None) == []
    assert lines(spark, texts.record_lines, "a=1; b=2 ;;\n c = 3\n\na=1") == ["a=1", "b=2", "c = 3", "a=1"]


def test_yield_of_rounds(spark):
    rows = [(1, 0, ["f"], ["i"]), (1, 1, ["f"], ["i"]), (1, 2, ["f", "g"], ["i"]), (1, 3, ["f", "g"], ["j"]), (2, 0, [], ["i"])]
    df = spark.createDataFrame(rows, "case_id long, round int, found array<string>, opened array<string>")
    assert tuple(evidence.escalation_yield(df, "case_id", "round").first()) == (3, 1, 1, pytest.approx(2 / 3))


def test_folds_deal_groups_in_hash_order(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("g"), "id").withColumn("g", F.when(F.col("g") < 699, F.col("g")))
    got = {r.g: r.fold for r in corpus.folds(df, "g", 5, "s").collect()}
    ranked = [r.g for r in df.select("g").distinct().where("g is not null").orderBy(corpus.hash_order("g", seed="s"), "g").collect()]
    assert len(got) == 699 and [got[g] for g in ranked] == [i % 5 for i in range(699)]
    sizes = [list(got.values()).count(k) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1
