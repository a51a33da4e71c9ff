"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one class, named by the smallest ids of its rows: no list of answers can need more of them. Classes are dealt to
shards by a hash of the vector. A shard's graph grows in batches: a beam search from the shard's central vector proposes what it visited
as neighbours, and pruning in the order of distance keeps one unless a kept one is nearer to it by the factor ``relax``, so edges point
in diverse directions. Kept neighbours get the edge back, and are pruned again when they have too many. Whatever the start cannot
reach in the end is tied to its nearest vector that it can. A query is answered by a beam search in every shard of its vector's length; the
nearest of all shards are ranked on the original vectors in double precision.

Work and rows sent are queries times shards: ``shard_rows`` should grow with the executors' memory (a row takes some 1 KB of it).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.shared import materialize, release

SHARD_ROWS, QUERY_ROWS = 16384, 4096
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 64, 128, 1.2
#: Edges beyond the degree that a vector may take back before it is pruned again, and those that tie unreachable vectors.
LOOSE, SPARE = 16, 16
GROUP = 256


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Node numbers and squared distances of the ``beam`` nearest found of each query, nearest first (-1 and infinite where there are
    fewer), from node 0, and what was visited step by step."""
    b = len(queries)
    seen = np.zeros((b, len(x)), bool)
    ids, far, done = np.full((b, beam), -1, np.int32), np.full((b, beam), np.inf, np.float32), np.ones((b, beam), bool)
    ids[:, 0], done[:, 0], seen[:, 0] = 0, False, True
    far[:, 0] = ((queries - x[0]) ** 2).sum(axis=1)
    visited = []
    while True:
        waiting = np.where(done, np.inf, far)
        at = waiting.argmin(axis=1)
        rows = np.flatnonzero(waiting[np.arange(b), at] < np.inf)
        if not len(rows):
            break
        at = at[rows]
        now = ids[rows, at]
        done[rows, at] = True
        visited.append((rows, now, far[rows, at]))
        near = edges[now]
        new = (near >= 0) & ~seen[rows[:, None], near]
        i, j = np.nonzero(new)
        seen[rows[i], near[i, j]] = True
        dist = np.full(near.shape, np.inf, np.float32)
        apart = x[near[i, j]] - queries[rows[i]]
        dist[i, j] = np.einsum("ij,ij->i", apart, apart)
        all_far = np.concatenate([far[rows], dist], axis=1)
        top = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[rows] = np.take_along_axis(all_far, top, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), top, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~new], axis=1), top, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, axis=1)
    return np.where(np.isinf(far), -1, np.take_along_axis(ids, order, axis=1)), far, visited


def robust_prune(x: np.ndarray, candidates: np.ndarray, far: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Neighbours kept of each row of candidates (-1: none), ``degree`` at most: the nearest first, each unless a kept one is nearer to
    it than the point is, by the factor ``relax``."""
    order = np.argsort(far, axis=1, kind="stable")
    far, candidates = np.take_along_axis(far, order, axis=1), np.take_along_axis(candidates, order, axis=1)
    v = x[candidates]
    squares = np.einsum("bij,bij->bi", v, v)
    between = squares[:, :, None] + squares[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    between *= relax * relax
    alive = np.isfinite(far)
    kept, count = np.zeros(far.shape, bool), np.zeros(len(far), np.int32)
    for c in range(far.shape[1]):
        take = alive[:, c] & (count < degree)
        if take.any():
            kept[:, c] = take
            count += take
            alive &= ~(take[:, None] & (between[:, c] <= far))
    first = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
    return np.where(np.take_along_axis(kept, first, axis=1), np.take_along_axis(candidates, first, axis=1), -1)


def _padded(owners: np.ndarray, values: np.ndarray, far: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as ``n`` rows of candidates, the nearest ``width`` of each owner."""
    order = np.lexsort((far, owners))
    owners, values, far = owners[order], values[order], far[order]
    place = np.arange(len(owners)) - np.searchsorted(owners, owners)
    some = place < width
    width = int(place[some].max(initial=0)) + 1
    ids, dist = np.zeros((n, width), np.int32), np.full((n, width), np.inf, np.float32)
    ids[owners[some], place[some]], dist[owners[some], place[some]] = values[some], far[some]
    return ids, dist


def _squared(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = x[a] - x[b]
    return np.einsum("ij,ij->i", apart, apart)


def _link_back(x: np.ndarray, edges: np.ndarray, points: np.ndarray, kept: np.ndarray, degree: int, relax: float) -> None:
    """The edges back from kept neighbours; those with too many are pruned again."""
    i, j = np.nonzero(kept >= 0)
    to, source = kept[i, j], points[i].astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    nodes, first, incoming = np.unique(to, return_index=True, return_counts=True)
    room = degree + LOOSE
    has = (edges[nodes, :room] >= 0).sum(axis=1)
    fits = has + incoming <= room
    place = np.repeat(has - first, incoming) + np.arange(len(to))
    easy = np.repeat(fits, incoming)
    edges[to[easy], place[easy]] = source[easy]
    full = nodes[~fits]
    for at in range(0, len(full), GROUP):
        some = full[at : at + GROUP]
        old = edges[some, :room]
        r, c = np.nonzero(old >= 0)
        mine = np.isin(to, some)
        owners = np.concatenate([r, np.searchsorted(some, to[mine])])
        values = np.concatenate([old[r, c], source[mine]])
        ids, far = _padded(owners, values, _squared(x, values, some[owners]), len(some), 3 * degree)
        kept = robust_prune(x, ids, far, degree, relax)
        edges[some, :room] = -1
        edges[some, : kept.shape[1]] = kept


def _reached(edges: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(edges), bool)
    seen[0] = True
    front = np.array([0])
    while len(front):
        front = np.unique(edges[front])
        front = front[(front >= 0) & ~seen[np.maximum(front, 0)]]
        seen[front] = True
    return seen


def _tie(x: np.ndarray, edges: np.ndarray, degree: int, beam: int) -> np.ndarray:
    """Edges to what node 0 cannot reach yet, from the nearest that it can; in spare columns, or more of them where they are taken."""
    tied = degree + LOOSE
    while True:
        seen = _reached(edges)
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return edges
        for at in range(0, len(lost), GROUP):
            some = lost[at : at + GROUP]
            near, _, _ = beam_search(x, edges, x[some], beam)
            for node, by in zip(some.tolist(), near.tolist(), strict=True):
                room = next((p for p in by if p >= 0 and edges[p, -1] < 0), None)
                if room is None:
                    edges = np.concatenate([edges, np.full((len(edges), SPARE), -1, np.int32)], axis=1)
                    room = by[0]
                edges[room, tied + int((edges[room, tied:] >= 0).sum())] = node


def grow(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> np.ndarray:
    """The graph of a shard: neighbours of each vector, -1 where there are fewer. Node 0 is where searches start."""
    n = len(x)
    edges = np.full((n, degree + LOOSE + SPARE), -1, np.int32)
    order = np.concatenate([[0], 1 + np.random.default_rng(n).permutation(n - 1)]).astype(np.int64)
    at, most = 1, max(1, min(GROUP, n // 32))
    while at < n:
        points = order[at : at + min(at, most)]
        at += len(points)
        _, _, visited = beam_search(x, edges, x[points], beam)
        owners = np.concatenate([r for r, _, _ in visited])
        values = np.concatenate([v for _, v, _ in visited])
        far = np.concatenate([f for _, _, f in visited])
        kept = robust_prune(x, *_padded(owners, values, far, len(points), 2 * beam), degree, relax)
        edges[points, : kept.shape[1]] = kept
        _link_back(x, edges, points, kept, degree, relax)
    return _tie(x, edges, degree, beam)


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def _scaled(x: np.ndarray, most: float) -> np.ndarray:
    return (x / most).astype(np.float32)


def _build(degree: int, beam: int, relax: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        size = key[0].as_py()
        x = _matrix(table.column("vector"), size)
        order = np.lexsort(x.T[::-1])  # whatever order the shuffle brought
        x = x[order]
        most = float(np.abs(x).max())
        small = _scaled(x, most)
        middle = int(((small - small.mean(axis=0)) ** 2).sum(axis=1).argmin())
        turn = np.r_[middle, np.delete(np.arange(len(x)), middle)]
        edges = grow(small[turn], degree, beam, relax)
        lists = pa.array([e[e >= 0] for e in edges], pa.list_(pa.int32()))
        table = table.take(pa.array(order[turn]))
        return pa.table({"size": table.column("size"), "shard": table.column("shard"), "node": pa.array(np.arange(len(x), dtype=np.int32)), "vector": table.column("vector"), "ids": table.column("ids"), "edges": lists})

    return run


def vector_rows(df: DataFrame, vector: str) -> DataFrame:
    """``(vec_id, vector)`` of distinct rows whose vector is not null, empty or zero and has finite components only. Rows without an
    id cannot be named as an answer and take no part; repeated rows are one."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    return df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).where(fine).select("vec_id", v.alias("vector")).distinct()


def build_graph(rows: DataFrame, answers: int, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> DataFrame:
    """``(size, shard, node, vector, ids, edges)``: every class of equal vectors of :func:`vector_rows` as a node of its shard's
    graph, with its ``answers`` smallest ids. Written to the shared folder. An empty table gives an empty one."""
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_place") <= answers)
    classes = ranked.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # so many ids at most
    classes = materialize(classes.withColumn("size", F.size("vector")), "classes")
    shards = max(1, math.ceil(classes.count() / shard_rows))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    schema = "size int, shard int, node int, vector array<double>, ids array<long>, edges array<int>"
    graph = materialize(dealt.groupBy("size", "shard").applyInArrow(_build(degree, beam, relax), schema), "graph")
    release(classes)
    return graph


def _answer(k: int, beam: int):
    def run(key: tuple, graph: pa.Table, asked: pa.Table) -> pa.Table:
        size, found = key[0].as_py(), ([], [], [], [])
        if graph.num_rows and asked.num_rows:
            graph = graph.sort_by("node")
            x, queries = _matrix(graph.column("vector"), size), _matrix(asked.column("vector"), size)
            most = max(float(np.abs(x).max()), float(np.abs(queries).max()))
            small, ids = _scaled(x, most), graph.column("ids").to_pylist()
            lists = graph.column("edges").combine_chunks()
            ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            edges = np.full((len(x), int(np.diff(ends).max(initial=1))), -1, np.int32)
            owners = np.repeat(np.arange(len(x)), np.diff(ends))
            edges[owners, np.arange(len(flat)) - (ends[owners] - ends[0])] = flat
            names = asked.column("query_id").to_pylist()
            for at in range(0, len(queries), GROUP):
                some = queries[at : at + GROUP]
                near, _, _ = beam_search(small, edges, _scaled(some, most), max(beam, 2 * k))
                for i, nodes in enumerate(near):
                    nodes = nodes[nodes >= 0]
                    with np.errstate(over="ignore"):
                        score = np.sqrt(((x[nodes] - some[i]) ** 2).sum(axis=1))
                    enough = score <= np.partition(score, min(k, len(score) - 1))[min(k, len(score) - 1)]  # the query's own class is one
                    name, best = names[at + i], []
                    for s, node in zip(score[enough].tolist(), nodes[enough].tolist(), strict=True):
                        best += [(s, v) for v in ids[node] if v != name]
                    for s, v in sorted(best)[:k]:
                        for column, value in zip(found, (name, at + i, v, s), strict=True):
                            column.append(value)
        rows = asked.column("query").take(pa.array(found[1], pa.int64())) if found[0] else pa.array([], pa.int64())
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "query": rows, "vec_id": pa.array(found[2], pa.int64()), "score": pa.array(found[3], pa.float64())})

    return run


def search(graph: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row ``(vec_id, vector)`` of queries, by Euclidean distance,
    ties to the smaller id; never a row of the query's own id. A query with several vectors is answered for each. Fewer candidates
    give fewer answers; vectors of another length are none."""
    queries = queries.select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("size"), F.xxhash64("vec_id", "vector").alias("query"))
    blocks = max(1, math.ceil(queries.count() / query_rows))
    queries = queries.withColumn("block", F.pmod("query", F.lit(blocks)).cast("int"))
    shards = graph.groupBy(*(F.col(c).alias(c) for c in ("size", "shard"))).agg(F.count(F.lit(1)).alias("_nodes")).drop("_nodes")
    asked = queries.join(shards, "size")  # every query is meant for every shard of its length
    offered = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["size", "shard", "block"]
    found = offered.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_answer(k, beam), "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
