"""Features, log-count ratios and dual coordinate descent against plain versions, and edge cases of rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from gleanery.llm import classifier as C
from pyspark.sql import functions as F

SPACE = " \t\n\v\f\r"


def words(text):
    out = [""]
    for c in text:
        out.append("") if c in SPACE else out.__setitem__(-1, out[-1] + c)
    return [w for w in out if w]


def shape(word):
    kinds = ["A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" or not c.isascii() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)


def indicators(text):
    """A document's n-grams: words, and runs of one to three shapes."""
    w = words(text)
    s = [(shape(x), i > 0 and fold(x) == fold(w[i - 1])) for i, x in enumerate(w)]
    grams = {("word", fold(x)) for x in w}
    return grams | {("shape", *s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def fold(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


TEXTS = ["", "a", "The the THE cat", "Ab12 x|y é É 9", "a b c a b c", "one two\nthree  four", "!!! ??? a1b2", "x " * 50 + "End."]


def test_features_are_the_distinct_n_grams():
    rows, cols = C.features(pa.array([*TEXTS, None]))
    for i, t in enumerate([*TEXTS, ""]):
        mine = cols[rows == i]
        assert len(set(mine.tolist())) == len(mine) == len(indicators(t))  # as many columns as n-grams: no two met in one here
    same = lambda a, b: set(cols[rows == a].tolist()) & set(cols[rows == b].tolist())
    for a in range(len(TEXTS)):
        for b in range(a):
            assert len(same(a, b)) == len(indicators(TEXTS[a]) & indicators(TEXTS[b]))


def cases(n=60, size=12, columns=40):
    r = random.Random(4)
    sets = [np.array(sorted(r.sample(range(columns), r.randint(1, size)))) for _ in range(n)]
    y = np.array([1.0 if (2 in s) + (3 in s) + r.random() > 0.8 else -1.0 for s in sets])
    return sets, y


def test_ratios_against_counters():
    sets, y = cases()
    got = C.log_count_ratios(sets, y)
    n = {k: Counter(c for s, label in zip(sets, y) if label == k for c in s.tolist()) for k in (1.0, -1.0)}
    total = {k: sum(v.values()) + C.BUCKETS for k, v in n.items()}
    for c in range(60):
        assert got[c] == pytest.approx(math.log(((n[1.0][c] + 1) / total[1.0]) / ((n[-1.0][c] + 1) / total[-1.0])))


def test_descent_reaches_the_hinge_loss_minimum():
    """The dual's solution against projected gradient steps on the same dual with full matrices, and its optimality conditions."""
    sets, y = cases()
    scale, cost = C.log_count_ratios(sets, y), np.where(y > 0, 0.7, 1.3)
    w, b = C.dual_coordinate_descent(sets, scale, y, cost, 2000)
    x = np.zeros((len(sets), 41))
    for i, s in enumerate(sets):
        x[i, s], x[i, 40] = scale[s] / math.sqrt(len(s)), 1
    q = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(len(sets)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    v = x.T @ (alpha * y)
    value = lambda u: u @ u / 2 + cost @ np.maximum(0, 1 - y * (x @ u))
    mine = np.append(w[:40], b)
    assert value(mine) == pytest.approx(value(v), rel=1e-3)
    assert np.allclose(x @ mine, x @ v, atol=0.02)
    assert not w[40:].any()


ROWS = [(1, "good calm text here"), (2, "bad | bad | bad"), (2, "bad | bad | bad"), (3, None), (4, ""), (None, "good calm"), (5, "good calm text " * 5000), (6, "bad | " * 5000)]
LABELS = [(1, 1), (2, 0), (5, 1), (6, 0), (6, 0), (None, 1), (3, None), (99, 1)]


def frames(spark, labels=LABELS):
    docs = spark.createDataFrame([(*r, 7, "s") for r in ROWS], "doc_id long, text string, SCORE int, cols string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, label int")


def test_rows_of_all_kinds_get_a_score(spark):
    docs, labels = frames(spark)
    out = C.score(docs, C.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "cols", "score"]
    got = out.collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, (r.text or "")[:4]): r.score for r in got}
    assert by[1, "good"] > 0.5 > by[2, "bad "] and by[None, "good"] > 0.5
    assert by[3, ""] == by[4, ""]


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(1, 1)], 0.95), ([(1, 0), (2, 0)], 0.05)])
def test_one_class_or_none(spark, labels, want):
    docs, labels = frames(spark, labels)
    got = [r.score for r in C.score(docs, C.fit(docs, labels)).collect()]
    assert got == pytest.approx([want] * len(ROWS), abs=0.01)


def test_empty_table(spark):
    docs, labels = frames(spark)
    assert C.score(docs.limit(0), C.fit(docs.limit(0), labels)).count() == 0


def test_a_null_id_is_not_held_out(spark, tmp_path):
    from gleanery.llm.queries import QUERIES

    docs, labels = frames(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumnRenamed("label", "quality").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["op3_naive_bayes_svm"](spark, str(tmp_path)).collect()
    assert {r.held_out for r in rows if r.doc_id is None} == {False} and len(rows) == len(ROWS)
