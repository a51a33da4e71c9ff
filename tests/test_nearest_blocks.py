"""The nearest by blocks that meet, and pairs inside groups, against brute force."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from gleanery.operators import similarity
from test_similarity import corpus, cosines, counts_of, weighed


def test_many_blocks_with_copies_give_the_same_nearest(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MEMBERS", 30)
    docs = corpus(150, 4)
    docs |= {1000 + i: docs[i] for i in range(0, 150, 3)} | {2000 + i: docs[i] for i in range(0, 150, 5)}  # ties
    group = {i: None if i % 19 == 0 else i % 4 for i in docs}
    rows = similarity.unit_rows(counts_of(spark, docs), "doc_id")
    near = similarity.nearest(rows, "doc_id", spark.createDataFrame(list(group.items()), "doc_id long, grp long"), 7)
    assert "UDTF" not in near._jdf.queryExecution().toString() and "CartesianProduct" in near._jdf.queryExecution().toString()
    got = {}
    for r in near.orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((round(r.s, 6), r.o))
    sims, want = cosines(weighed(docs, False)), {}
    for (q, o), s in sims.items():
        if group[q] is None or group[o] is None or group[q] != group[o]:
            want.setdefault(q, []).append((round(s, 9), o))
    assert got == {q: [(round(s, 6), o) for s, o in sorted(x, reverse=True)[:7]] for q, x in want.items()}


def test_matrices_and_single_postings_give_the_same(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    tables = []
    for block in (0, 1):
        rows = [(f"p{block}{i:02d}", 1 + i % 3 if i % 7 else None, t, rng.random()) for i in range(40) for t in rng.sample(range(60), 20)]
        key, grp, term, w = zip(*rows)
        t = similarity.packed_block(pa.table({"block": pa.array([block] * len(rows), pa.int32()), "key": key, "grp": pa.array(grp, pa.int64()), "term": pa.array(term, pa.int64()), "w": w}))
        tables.append({c: t[c][0] for c in t.column_names})
    found = []
    for dense in (0, 10**9):
        monkeypatch.setattr(similarity, "DENSE", dense)
        found.append([tuple(r.values()) for pair in (tables, tables[:1] * 2) for b in similarity.meeting(*pair, 5, 9) for r in b.to_pylist()])
    assert len(found[0]) == 3 * 40 * 5 and [x[:2] for x in found[0]] == [x[:2] for x in found[1]]
    assert [x[2] for x in found[0]] == pytest.approx([x[2] for x in found[1]])
    assert all(q != o for q, o, _ in found[0])


@pytest.mark.parametrize("together", [256, 5])
def test_pairs_inside_groups(spark, monkeypatch, together):
    monkeypatch.setattr(similarity, "TOGETHER", together)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i // 9 if i < 50 else 7, i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)] + [(1, 9, "w1 w2"), (None, 70, "w1"), (2, None, "w1"), (2, 71, None)]
    texts = {}
    for g, k, s in docs:
        if None not in (g, k, s):
            texts.setdefault((g, k), []).append(s)
    count = {}
    for at, parts in texts.items():
        c = Counter()
        for s in parts:
            w = s.split()
            c.update([("w", x) for x in w] + [("b", *x) for x in zip(w, w[1:])] + [("c", s[i : i + 4]) for i in range(len(s) - 3)])
        count[at] = c
    want = {}
    for (g, a), (h, b) in combinations(sorted(count), 2):
        x, y = count[g, a], count[h, b]
        if g == h and x and y and (cos := sum(x[t] * y[t] for t in x) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))) >= 0.15:
            want[a, b] = cos
    df = spark.createDataFrame(docs, "case_id long, doc_id long, words string")
    got = {(r.a, r.b): r.cosine for r in similarity.similar_within(df, "case_id", "doc_id", "words", 0.15).collect()}
    assert got.keys() == want.keys() and len(got) > 20 and all(got[p] == pytest.approx(want[p]) for p in want)
