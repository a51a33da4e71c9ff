"""The work that near duplicates take whatever the size: each stage has a task for each shuffle partition, many of them empty."""

import random

from test_near_dedup import brute, cases

from gleanery.llm import near_dedup as N
from gleanery.operators import graph as G


def stages(spark, run):
    """What ``run`` returns, and the number of stages that Spark ran for it."""
    sc = spark.sparkContext
    sc.setJobGroup("near-duplicate stages", "")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    ids = {s for j in seen.getJobIdsForGroup("near-duplicate stages") for s in seen.getJobInfo(j).stageIds}
    return out, sum(1 for s in ids if (i := seen.getStageInfo(s)) and i.numCompletedTasks)


def test_stages_of_near_duplicates(spark):
    rows = cases()[30:110]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got, n = stages(spark, lambda: sorted(map(tuple, N.near_duplicates(df).collect())))
    assert got == brute(rows)
    assert n <= 115  # 98 as measured; 141 before


def test_components_broadcast_or_shuffled(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000 + i % 90, 2500) for i in range(180)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = sorted((x, find(x)) for e in {frozenset(e) for e in edges if e[0] != e[1]} for x in e)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for small in (G.SMALL, 0):
        monkeypatch.setattr(G, "SMALL", small)
        assert sorted(map(tuple, G.connected_components(df, "a", "b").collect())) == sorted(set(want))
        stars = sorted(map(tuple, G.component_stars(df, "a", "b").collect()))
        assert stars == sorted({w for w in want if w[0] != w[1]})
