"""Connected components over an edge table, by alternating large-star and small-star rounds.

Only equi-joins and grouped minima are used, so a hub with a third of all edges is a skewed join that adaptive
execution splits, never a collected group. Each round is written to the shared folder and its edges are counted; up to
``SMALL`` of them, the minima are broadcast and no edge is shuffled to meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sources.shared import materialize, release

#: The minima of so many edges at most (two nodes each, 2 MB of numbers) are broadcast.
SMALL = 1 << 16


def _few(table: DataFrame, edges: int) -> DataFrame:
    """``table``, of two rows for each of so many edges at most, marked to be broadcast if they are few."""
    return F.broadcast(table) if edges <= SMALL else table


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, with their number and a checksum. (An observation would save the second look, but a session
    that has observed can no longer serialise Spark ML's fitted models with their summaries.)"""
    table = materialize(edges, "edges")
    return table, tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table; the component is its smallest node.

    Nulls on either end and self loops give no edge; repeated edges count once. An empty table gives no rows.
    Raises if ``max_rounds`` do not reach the fixed point (rounds grow with the logarithm of the longest path).
    """
    stars = component_stars(edges, a, b, max_rounds)
    roots = stars.select(F.col("component").alias("node")).distinct()
    return stars.unionByName(roots.select("node", F.col("node").alias("component")))


def component_stars(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """The rows of :func:`connected_components` but those of the components' smallest nodes: written, one for each other
    node, and marked to be broadcast to joins if they are few."""
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, state = _written(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # edges that come several times here are dropped below, with those of the small star
        large = both.join(_few(low, state[0]), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_few(low, state[0]), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        after, seen = _written(small)
        release(now)
        now, done, state = after, seen == state, seen
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _few(now.select(F.col("u").alias("node"), F.col("v").alias("component")), state[0])
