"""As-of joins: the latest right row of a key at or before each left row's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, days: int = 32) -> DataFrame:
    """JOIN14: ``left`` with ``value`` of the last right row (by ``time``, then value) at or before it; null where there is none.

    ``time`` is a date. Each key's days are dealt into stretches of ``days``, so no task orders all rows of a hot key: inside a
    stretch the last right row is carried forward, and a stretch without one before a row takes the last of the
    stretches before it. A null key or time meets nothing.
    """
    names = left.columns
    stretch = F.floor(F.unix_date(time) / days)
    r = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(value).alias(value))
    r = r.select(key, time, stretch.alias("_stretch"), F.struct(time, value).alias("_seen"), F.lit(0).alias("_side"))
    rows = left.select("*", stretch.alias("_stretch"), F.lit(None).cast(r.schema["_seen"].dataType).alias("_seen"), F.lit(1).alias("_side"))
    both = rows.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(key, "_stretch").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.max("_seen").over(inside)).where("_side = 1")
    # the last of each stretch, carried to the stretches after it: one row a key and stretch
    ends = r.groupBy(key, "_stretch").agg(F.max("_seen").alias("_end"))
    asked = left.select(key, stretch.alias("_stretch")).distinct().where(F.col("_stretch").isNotNull())
    steps = ends.unionByName(asked, allowMissingColumns=True).groupBy(key, "_stretch").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(key, "_stretch", F.max("_end").over(before).alias("_before"))
    out = both.join(steps, [key, "_stretch"], "left")
    found = F.when(F.col(key).isNotNull() & F.col(time).isNotNull(), F.coalesce("_last", "_before"))
    return out.select(*names, found[value].alias(value))
