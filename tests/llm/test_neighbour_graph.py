"""Nearest neighbours by pruned graphs against brute force, the parts of the method, and its edge cases."""

import os

import numpy as np
import pytest
from gleanery.llm import neighbour_graph as g
from gleanery.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, size string, shard int, rank double"


def found(spark, rows, k=10, every=100, **parts):
    df = spark.createDataFrame([(i, v, "clash", 7, 0.5) for i, v in rows], SCHEMA)
    rows = g.vector_rows(df, "embedding")
    graph = g.build_graph(rows, k + 1, **{p: v for p, v in parts.items() if p == "shard_rows"})
    out = g.search(graph, rows.where(f"vec_id % {every} = 0"), k, **{p: v for p, v in parts.items() if p != "shard_rows"})
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def brute(rows, k=10, every=100):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in kept:
        if i % every == 0:
            best = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in kept if j != i)[:k]
            out[i] = [(r + 1, j, s) for r, (s, j) in enumerate(best)]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        mine = got.get(q, [])
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(s, j) for _, j, s in mine] == sorted((s, j) for _, j, s in mine)
        reach = best[-1][2] * (1 + 1e-12)
        hits += sum(s <= reach for _, _, s in mine)
        total += len(best)
    return hits / total


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")
def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = {}, brute(rows)
    for r in QUERIES["op11_robust_pruned_graph"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert recall(got, want) >= 0.9 and got.keys() == want.keys()
    score = {(q, j): s for q, best in want.items() for _, j, s in best}
    assert all(s == pytest.approx(score[q, j], abs=1e-12) for q, best in got.items() for _, j, s in best if (q, j) in score)


def test_several_shards_and_blocks_of_queries(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (30, 12))
    rows = [(i, (middles[i % 30] + rng.normal(0, 0.2, 12)).astype(np.float32).tolist()) for i in range(3000)]
    want = brute(rows, 5, 30)
    assert recall(found(spark, rows, 5, 30, shard_rows=500, query_rows=20), want) >= 0.98
    assert recall(found(spark, rows, 5, 30), want) >= 0.98


def test_a_third_of_the_rows_are_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 4).astype(np.float32).tolist() if i % 3 else [1.0, 2.0, 3.0, 4.0]) for i in range(900)]
    assert found(spark, rows) == {q: [(r, j, pytest.approx(s, abs=1e-12)) for r, j, s in best] for q, best in brute(rows).items()}


def test_vectors_that_take_no_part_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 1.0]), (200, None), (201, [0.0, 0.0]), (300, [float("nan"), 1.0]), (301, [None, 1.0]), (302, [float("inf"), 1.0]), (303, []), (None, [1.0, 0.0])]
    got = found(spark, rows)
    assert got == {0: [(1, 1, pytest.approx(2**0.5)), (2, 2, pytest.approx(5**0.5))], 100: [(1, 3, 0.0)]}
    assert found(spark, rows[:1]) == {} and found(spark, []) == {}


def test_all_nodes_are_reached_and_pruning_keeps_diverse_edges():
    rng = np.random.default_rng(3)
    far_apart = np.concatenate([rng.normal(c, 0.01, (60, 8)) for c in (0, 50, 100, 1000)]).astype(np.float32)  # islands
    edges = g.grow(far_apart, degree=4, beam=8)
    assert g._reached(edges).all()
    line = np.array([[0.0], [1.0], [2.0], [-1.5], [3.0]], np.float32)
    kept = g.robust_prune(line, np.array([[1, 2, 3, 4]]), np.array([[1, 4, 2.25, 9]], np.float32), 3, 1.2)
    assert kept[0][kept[0] >= 0].tolist() == [1, 3]  # 2 and 4 lie behind 1
    ids, far, _ = g.beam_search(far_apart, edges, far_apart[:3], 8)
    assert ids[:, 0].tolist() == [0, 1, 2] and (far[:, 0] == 0).all()
