"""Thresholded pairs and nearest rows against brute force, with words that stand in every row."""

import math
import random
from collections import Counter

import pytest
from gleanery.functions import texts
from gleanery.operators import similarity


def corpus(n, seed):
    rng = random.Random(seed)
    topics = [[f"t{t}w{i}" for i in range(30)] for t in range(12)]
    out = {}
    for i in range(n):
        words = ["the", "of", "and"] * rng.randint(1, 4) + rng.choices(topics[i % 12], k=rng.randint(1, 25)) + rng.choices(topics[(i + 1) % 12], k=rng.randint(0, 3))
        out[i] = words if i % 17 else ["the"]
    out[n], out[n + 1] = [], ["only", "here"]
    return out


def weighed(docs, idf=True):
    df = Counter(t for w in docs.values() for t in set(w))
    total = sum(bool(w) for w in docs.values())
    out = {}
    for i, words in docs.items():
        v = {t: c * ((math.log((total + 1) / (df[t] + 1)) + 1) if idf else 1) for t, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[i] = {t: x / norm for t, x in v.items()}
    return out


def cosines(v):
    return {(a, b): s for a in v for b in v if a != b and (s := sum(x * v[b].get(t, 0.0) for t, x in v[a].items())) > 0}


def counts_of(spark, docs):
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    return texts.terms(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_pairs_above_a_threshold(spark, threshold):
    docs = corpus(240, 1)
    rows = texts.tf_idf(counts_of(spark, docs), "doc_id")
    got = {(r.a, r.b): r.cosine for r in similarity.similar_pairs(rows, "doc_id", threshold).collect()}
    want = {p: s for p, s in cosines(weighed(docs)).items() if p[0] < p[1] and s >= threshold}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)


def test_words_in_every_row_pair_no_rows(spark):
    docs = corpus(240, 2)
    rows = texts.tf_idf(counts_of(spark, docs), "doc_id")
    formed = similarity.candidate_pairs(rows, "doc_id", 0.7).count()
    link = sum(s >= 0.7 for (a, b), s in cosines(weighed(docs)).items() if a < b)
    everything = 241 * 240 // 2  # "the" is in every row but two, so a plain join on terms forms nearly all pairs
    assert link <= formed < 0.25 * everything


@pytest.mark.parametrize("idf", [True, False])
def test_nearest_of_other_groups(spark, idf):
    docs = corpus(240, 3)
    counts = counts_of(spark, docs)
    rows = texts.tf_idf(counts, "doc_id") if idf else similarity.unit_rows(counts, "doc_id")
    group = {i: None if i % 19 == 0 else i % 5 for i in docs}
    groups = spark.createDataFrame(list(group.items()), "doc_id long, grp long")
    got = {}
    for r in similarity.nearest(rows, "doc_id", groups, 10).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((r.s, r.o))
    sims, want = cosines(weighed(docs, idf)), {}
    for (q, o), s in sims.items():
        if round(s, 9) > 0 and (group[q] is None or group[o] is None or group[q] != group[o]):
            want.setdefault(q, []).append((s, o))
    assert got.keys() == want.keys()
    for q, all_of in want.items():
        best = sorted(((round(s, 9), o) for s, o in all_of), reverse=True)[:10]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in best], abs=2e-9)
        assert len({o for _, o in got[q]}) == len(best)


def test_label_features_and_keys_without_vectors(spark):
    near = spark.createDataFrame([(1, 2, 0.6, 1), (1, 3, 0.2, 2)], "q long, o long, s double, place int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, y int")
    rows = spark.createDataFrame([(1,), (2,), (3,), (3,)], "doc_id long")
    got = {r.doc_id: tuple(r)[1:] for r in similarity.nearest_label_features(near, labels, "doc_id", rows).collect()}
    assert got == {1: (pytest.approx(0.75), 0.6, 0.2, False), 2: (0.5, 0, 0, False), 3: (0.5, 0, 0, False), 4: (0.5, 0, 0, True)}


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "doc_id long, term string, w double")
    assert similarity.similar_pairs(rows, "doc_id", 0.5).count() == 0
    assert similarity.nearest(rows, "doc_id", spark.createDataFrame([], "doc_id long, grp long"), 3).count() == 0
