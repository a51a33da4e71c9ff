"""Exact centroid clustering of integer vectors, with heap-ordered bounds.

Vectors lie in blocks of a few thousand, each a row of its own: the vectors, their clusters, and for every cluster a heap
of gaps. A vector's gap is its distance to the nearest other centroid less the one to its own, as last measured, plus the
drift that its cluster had accumulated by then. When centroids move, a cluster's drift grows by the way of its own centroid and
the longest way of another, so the gap can have closed only for vectors whose entry lies below the drift: those are popped from
the heap and measured against all centroids again; no other vector is looked at. Gaps are taken a little smaller than
measured, so rounding never hides a change, and ties are always measured anew and settled on integers.

A round reads the blocks where they lie, without a shuffle, and writes their new state to the shared folder. Sums of a cluster
change only by the vectors that moved; tasks add up those changes, and the driver sees one row per cluster.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.sources.shared import materialize, release

BLOCK = 4096
#: Components up to this size are kept as 64-bit integers: distances and sums of blocks then fit. Larger ones become Python integers.
NARROW = 2**25
LONGEST = 2**63 - 1
#: A gap counts as closed while it is within this share of the distances (rounding is near 1e-15).
SLACK = 1e-9
STATE = "ids array<long>, vectors array<double>, owners array<int>, keys array<double>, members array<int>, ends array<int>, moved int, sums array<string>, counts array<long>"


def integer_vectors(df: DataFrame, vector: str, size: int, scale: int = 64) -> DataFrame:
    """``(vec_id, x)``: vectors of exactly ``size`` components, none null, NaN or infinite, as floor(scale * component). The integers
    come as doubles, which hold them exactly."""
    x = F.col(vector).cast("array<double>")
    scaled = F.transform(x, lambda v: v * F.lit(float(scale)))
    finite = F.forall(scaled, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(scaled, lambda v: F.when(F.abs(v) < F.lit(2.0**52), F.floor(v).cast("double")).otherwise(v))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) == size)).where(finite).select("vec_id", whole.alias("x"))


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _keys(squares: np.ndarray, owners: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """How much farther the nearest other centroid is than the own one, at least, offset by the cluster's drift so far."""
    far = np.sqrt(squares.astype(float))
    rows = np.arange(len(owners))
    own = far[rows, owners].copy()
    far[rows, owners] = np.inf
    other = far.min(axis=1)
    gone = drift[owners]
    return np.where(np.isinf(other), np.inf, other - own + gone - SLACK * (1.0 + own + np.where(np.isinf(other), 0, other) + gone))


def nearest(squares: np.ndarray) -> np.ndarray:
    """The first of the smallest, row by row."""
    return np.argmin(squares, axis=1).astype(np.int32)


class Block:
    """Vectors with their clusters and, for each cluster, the heap of gaps."""

    def __init__(self, ids: list, flat: np.ndarray, size: int, wide: bool) -> None:
        self.ids, self.flat = ids, flat
        x = flat.reshape(-1, size)
        self.x = np.array([[int(v) for v in row] for row in x], object).reshape(-1, size) if wide else x.astype(np.int64)

    def scan(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Measures all vectors and builds the heaps."""
        squares = _squares(self.x, centroids)
        self.owners = nearest(squares)
        keys = _keys(squares, self.owners, drift)
        self.heaps: list[list] = [[] for _ in centroids]
        for i, (owner, key) in enumerate(zip(self.owners.tolist(), keys.tolist(), strict=True)):
            self.heaps[owner].append((key, i))
        for heap in self.heaps:
            heapq.heapify(heap)
        self.rescanned, self.before = np.arange(len(self.ids)), None

    def advance(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Pops the vectors whose gaps may have closed, measures those, and pushes them again."""
        popped = []
        for heap, gone in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= gone:
                popped.append(heapq.heappop(heap)[1])
        self.rescanned = np.array(sorted(popped), np.int64)
        self.before = self.owners[self.rescanned]
        if popped:
            squares = _squares(self.x[self.rescanned], centroids)
            owners = nearest(squares)
            keys = _keys(squares, owners, drift)
            self.owners[self.rescanned] = owners
            for i, owner, key in zip(self.rescanned.tolist(), owners.tolist(), keys.tolist(), strict=True):
                heapq.heappush(self.heaps[owner], (key, i))

    def changes(self) -> tuple[np.ndarray, np.ndarray]:
        """What the last step adds to each cluster's sum and count."""
        k, now = len(self.heaps), self.owners[self.rescanned]
        sums = np.zeros((k, self.x.shape[1]), self.x.dtype)
        counts = np.zeros(k, np.int64)
        steps = [(now, 1)] if self.before is None else [(now, 1), (self.before, -1)]
        for owners, sign in steps:
            for c in np.unique(owners):
                mine = self.rescanned[owners == c]
                sums[c] = sums[c] + sign * self.x[mine].sum(axis=0)
                counts[c] += sign * len(mine)
        return sums, counts

    def row(self) -> tuple:
        sums, counts = self.changes()
        keys = [key for heap in self.heaps for key, _ in heap]
        members = [i for heap in self.heaps for _, i in heap]
        ends = np.cumsum([len(h) for h in self.heaps])
        text = [str(v) for v in sums.ravel().tolist()] if counts.any() or sums.any() else []
        return self.ids, self.flat, self.owners, keys, members, ends, len(self.rescanned), text, counts

    @classmethod
    def read(cls, row: dict, size: int, wide: bool) -> Block:
        block = cls(row["ids"], np.asarray(row["vectors"], float), size, wide)
        block.owners = np.array(row["owners"], np.int32)
        pairs = list(zip(row["keys"], row["members"], strict=True))
        block.heaps = [pairs[a:b] for a, b in itertools.pairwise([0, *row["ends"]])]
        return block


_SCHEMA = pa.schema(
    [("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.float64())), ("owners", pa.list_(pa.int32())), ("keys", pa.list_(pa.float64())), ("members", pa.list_(pa.int32())),
     ("ends", pa.list_(pa.int32())), ("moved", pa.int32()), ("sums", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)


def _batch(block: Block) -> pa.RecordBatch:
    columns = [pa.array([v], f.type) for v, f in zip(block.row(), _SCHEMA, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _first(size: int, wide: bool, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
                block = Block(part.column("vec_id").to_pylist(), flat, size, wide)
                block.scan(centroids, np.zeros(len(centroids)))
                yield _batch(block)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], size: int, wide: bool) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block.read({c: batch.column(c)[i].values.to_pylist() if c == "ids" else batch.column(c)[i].values.to_numpy(zero_copy_only=False).tolist() for c in ("ids", "vectors", "owners", "keys", "members", "ends")}, size, wide)


def _next(size: int, wide: bool, centroids: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, size, wide):
            block.advance(centroids, drift)
            yield _batch(block)

    return run


def _last(size: int, wide: bool, centroids: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, size, wide):
            block.advance(centroids, drift)
            squares = ((block.x - centroids[block.owners]) ** 2).sum(axis=1)
            distance = [min(int(d), LONGEST) for d in squares]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids, pa.int64()), pa.array(block.owners, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    return run


def _added(k: int, size: int):
    """The changes of all blocks of a task, one row per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * size for _ in range(k)], [0] * k
        for batch in batches:
            for text, count in zip(batch.column("sums").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                for j, v in enumerate(text):
                    sums[j // size][j % size] += int(v)
                counts = [a + b for a, b in zip(counts, count, strict=True)]
        rows = [c for c in range(k) if counts[c] or any(sums[c])]
        columns = [pa.array(rows, pa.int32()), pa.array([[str(v) for v in sums[c]] for c in rows], pa.list_(pa.string())), pa.array([counts[c] for c in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "sums", "n"])

    return run


def _total(key: tuple, table: pa.Table) -> pa.Table:
    sums = [str(sum(map(int, column))) for column in zip(*table.column("sums").to_pylist(), strict=True)]
    return pa.table({"cluster": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums], pa.list_(pa.string())), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})


def _drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much each cluster's gaps may have shrunk: its centroid's way and the longest of the others'."""
    way = np.array([float(sum((int(a) - int(b)) ** 2 for a, b in zip(o, n, strict=True))) ** 0.5 for o, n in zip(old, new, strict=True)]) * (1 + SLACK)
    others = np.array([max(np.delete(way, c), default=0.0) for c in range(len(way))])
    return way + others


def first_centroids(vectors: DataFrame, k: int, order: Column) -> list[list[int]]:
    """The ``k`` vectors that come first in ``order``; equal places by their components."""
    return [[int(v) for v in r.x] for r in vectors.orderBy(order, "x").limit(k).collect()]


def cluster(vectors: DataFrame, size: int, k: int, rounds: int, order: Column) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)`` of every row of ``(vec_id, x)`` and the final centroids.

    Lloyd's rounds on integers: each assigns every vector to its nearest centroid (squared Euclidean distance, ties to the
    smaller number) and puts non-empty centroids at the floor of their vectors' mean; a last assignment follows. The start is
    :func:`first_centroids`. Repeated rows and ids count as often as they occur and a null id is an id; fewer than ``k`` vectors
    give fewer centroids; an empty table gives no rows. Distances beyond a long are the largest long.
    """
    start = first_centroids(vectors, k, order)
    if not start:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    largest = vectors.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    wide = largest > NARROW
    centroids = np.array(start, object if wide else np.int64)
    k = len(start)
    sums, counts, drift = [[0] * size for _ in range(k)], [0] * k, np.zeros(k)
    state = materialize(vectors.mapInArrow(_first(size, wide, centroids), STATE), "clusters")
    for at in range(rounds):
        parts = state.select("sums", "counts").mapInArrow(_added(k, size), "cluster int, sums array<string>, n long")
        for r in parts.groupBy("cluster").applyInArrow(_total, "cluster int, sums array<string>, n long").collect():  # k rows
            sums[r.cluster] = [a + int(b) for a, b in zip(sums[r.cluster], r.sums, strict=True)]
            counts[r.cluster] += r.n
        moved = [[v // n for v in s] if n else old for s, n, old in zip(sums, counts, centroids.tolist(), strict=True)]
        moved = np.array(moved, centroids.dtype)
        drift = drift + _drifts(centroids, moved)
        centroids = moved
        if at < rounds - 1:
            after = materialize(state.mapInArrow(_next(size, wide, centroids, drift), STATE), "clusters")
            release(state)
            state = after
    out = materialize(state.mapInArrow(_last(size, wide, centroids, drift), "vec_id long, cluster int, distance long"), "clustered")
    release(state)
    return out, centroids.tolist()


def with_inertia(clustered: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds each cluster's and the whole inertia, and a digest of the final centroid."""
    spark = clustered.sparkSession

    def long(c: Column) -> Column:
        return F.least(c, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")

    per = clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum"))
    whole = per.agg(F.sum("_sum").cast("decimal(38,0)").alias("_all"))
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, _text string")
    per = per.crossJoin(F.broadcast(whole)).join(F.broadcast(names), "cluster")  # one row; a row per centroid
    per = per.select("cluster", long(F.col("_sum").cast("decimal(38,0)")).alias("cluster_inertia"), long(F.col("_all")).alias("inertia"), F.sha2("_text", 256).alias("centroid_sha256"))
    return clustered.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
