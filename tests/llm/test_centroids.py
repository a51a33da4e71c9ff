"""Centroid clustering against plain rounds over all vectors, and its edge cases."""

import hashlib

import numpy as np
import pytest
from gleanery.llm import centroids
from pyspark.sql import functions as F

SIZE = 6
SCHEMA = "vec_id long, embedding array<double>, cluster string, x int, distance double"


def place():
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def vectors(spark, rows):
    df = spark.createDataFrame([(i, v, "clash", 1, 2.0) for i, v in rows], SCHEMA)
    return centroids.integer_vectors(df, "embedding", SIZE)


def brute(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows if v is not None and len(v) == SIZE and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [x for _, x in order[:k]]

    def assign():
        out = []
        for i, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, m, strict=True)) for m in means]
            out.append((i, x, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        now = assign()
        for c in range(len(means)):
            mine = [x for _, x, o, _ in now if o == c]
            if mine:
                means[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((i is None, i or 0, c, d) for i, _, c, d in assign()), means


def run(spark, rows, k, rounds):
    out, means = centroids.cluster(vectors(spark, rows), SIZE, k, rounds, place())
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in out.collect()), means


def clumps(n, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (7, SIZE))
    return [(i, (scale * (middles[rng.integers(7)] + rng.normal(0, 0.3, SIZE))).tolist()) for i in range(n)]


@pytest.mark.parametrize("k,rounds", [(5, 4), (16, 3), (1, 2)])
def test_against_plain_rounds(spark, k, rounds):
    rows = clumps(700, k)
    assert run(spark, rows, k, rounds) == brute(rows, k, rounds)


def test_ties_copies_and_values_of_any_size(spark):
    grid = [(i, [float(i % 3), float(i % 2), 0.0, 0.0, 0.0, 0.0]) for i in range(300)]  # many exact ties, two thirds copies
    rows = grid + [(i % 5, grid[0][1]) for i in range(250)]
    assert run(spark, rows, 8, 5) == brute(rows, 8, 5)
    far = clumps(80, 3, 1e7)
    assert run(spark, far, 4, 3) == brute(far, 4, 3)
    vast = [(i, [c * 1e30 for c in v]) for i, v in clumps(30, 4)]
    got, _ = run(spark, vast, 3, 2)
    assert [(r[0], r[1], r[2], min(r[3], 2**63 - 1)) for r in brute(vast, 3, 2)[0]] == got


def test_vectors_that_take_no_part(spark):
    rows = clumps(20, 9)
    bad = [(50, None), (51, [1.0] * (SIZE - 1)), (52, [None] + [1.0] * (SIZE - 1)), (53, [float("nan")] * SIZE), (54, [float("inf")] + [0.0] * (SIZE - 1)), (55, []), (None, rows[3][1]), (7, rows[7][1])]
    got, means = run(spark, rows + bad, 4, 3)
    assert (got, means) == brute(rows + bad, 4, 3)
    assert len(got) == 22
    few, means = run(spark, rows[:3], 16, 3)
    assert len(means) == 3 and [r[3] for r in few] == [0, 0, 0]
    assert run(spark, rows[:0], 16, 3) == ([], [])
    empty = centroids.with_inertia(*centroids.cluster(vectors(spark, []), SIZE, 4, 3, place()))
    assert empty.count() == 0 and len(empty.columns) == 6


def test_only_expired_gaps_are_measured_again():
    x = np.concatenate([np.tile([[0, 0], [1, 1]], (200, 1)), np.tile([[1000, 1000], [990, 1001]], (200, 1)), [[495, 495]]]).astype(float)
    block = centroids.Block(list(range(len(x))), x.ravel(), 2, False)
    first, second = np.array([[0, 0], [1000, 1000]]), np.array([[5, 5], [960, 1000]])
    block.scan(first, np.zeros(2))
    assert block.owners.tolist() == [0] * 400 + [1] * 400 + [0]
    block.advance(second, centroids._drifts(first, second))
    assert block.rescanned.tolist() == [800]  # the one between the two; the heaps' other tops have not expired
    sums, counts = block.changes()
    assert counts.tolist() == [-1, 1] and sums.tolist() == [[-495, -495], [495, 495]]
    again = centroids.Block.read(dict(zip(("ids", "vectors", "owners", "keys", "members", "ends"), block.row()[:6], strict=True)), 2, False)
    assert again.heaps == block.heaps and (again.x == block.x).all()
