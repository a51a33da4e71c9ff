"""Mixing sources to target weights by weighted fair queueing.

Each document is queued once per allowed epoch in its source's shuffled order. Its virtual finish time is the source's
cumulative size up to and with it, divided by the source's target. All queues are merged in the order of that time
(a global range sort) and the merged queue is cut where the total budget is used up.

Cumulative sums are two-level: the hash order is split into buckets, bucket sums are accumulated over the small
bucket table, and the sums inside a bucket are windows over a bucket's rows only, so a source that holds a third of
all rows is spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)``: ``share`` of all sizes dealt by repeating ``weights`` over the sources in
    code-point order (null last), no target above ``most`` times its source's size, the excess dealt again by weight.

    The fair level is closed form: sources reach their limit in the order of limit / weight. The source table has one
    row a source; it alone is ordered as a whole.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    k = (F.row_number().over(order) - 1) % len(weights)
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("double"))
    src = src.withColumn("lim", most * F.col("source_size"))
    rank = Window.orderBy(F.col("lim") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    below, above = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("lim").over(below), F.lit(0.0))
    src = src.withColumn("level", left / F.sum("w").over(above)).withColumn("full", F.col("level") * F.col("w") >= F.col("lim"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)  # the first source that is not full
    target = F.when(F.col("full") | level.isNull(), F.col("lim")).otherwise(level * F.col("w"))
    return src.select("source", "source_size", target.alias("target"))


def weighted_fair_mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix",
    buckets: int = 1024,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per row of ``docs``.

    ``taken`` counts the words the mix takes of the document over all epochs, at most ``epochs`` times its size. The
    row at the cut is taken in part, so the mix has exactly the budget (to a word). Null or empty texts have size 0 and
    take nothing; a null source is a source of its own, the last; a null ``doc_id`` and repeated rows are rows like
    others. Ties in the shuffled order are broken by size; equal rows are interchangeable, so reruns agree. An empty
    table gives no rows. Only ``doc_id``, ``source`` and ``text`` are read; other columns are ignored.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), key.alias("key"))
    sizes = materialize(sizes.withColumn("bucket", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % buckets), "sizes")
    targets = source_targets(sizes, weights, share, float(epochs))

    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["*"], "source_size", "target")
    s = starts.select(F.col("source").alias("src"), F.col("bucket").alias("b"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sizes.withColumn("cum", F.sum("size").over(inside))
    queued = queued.join(s, queued["source"].eqNullSafe(s["src"]) & (queued["bucket"] == s["b"]))
    row = ["doc_id", "source", "key", "size", "source_size", "target", "cum"]  # a row with words is its source's only one at cum
    queued = queued.withColumn("cum", F.col("cum") + F.col("start")).select(*row)
    # every copy of a document, with its virtual finish time; times beyond 1 lie past the source's target
    finish = F.explode(F.array(*[(F.col("cum") + e * F.col("source_size")) / F.col("target") for e in range(epochs)]))
    live = queued.where("size > 0 and target > 0").withColumn("finish", finish)
    live = live.withColumn("slot", F.floor(F.col("finish") / (1 + F.col("finish")) * 4 * buckets))
    slots = live.groupBy("slot").agg(F.sum("size").alias("held"))
    ahead = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("slot", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    budget = targets.agg(F.round(F.sum("target")).cast("long").alias("budget"))
    slots = slots.crossJoin(F.broadcast(budget))  # one row
    merged = Window.partitionBy("slot").orderBy("finish", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    live = live.withColumn("run", F.sum("size").over(merged)).join(slots, "slot")
    end = F.col("ahead") + F.col("run")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - end + F.col("size")))
    takes = live.select(*row, part.alias("taken")).groupBy(*row).agg(F.sum("taken").alias("taken"))
    none = queued.where("not (size > 0 and target > 0)").withColumn("taken", F.lit(0).cast("long"))
    return none.unionByName(takes).select("doc_id", "size", "source_size", "target", "taken")
