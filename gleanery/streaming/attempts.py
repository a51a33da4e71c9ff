"""STR4: the attempts at each case and field as sessions, and the same rule on plain arrays."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = -(2**63)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """A query that starts inside keeps its state in the store that may outgrow memory."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def merge_runs(runs: list[tuple], gap: int) -> list[tuple]:
    """Runs of attempts ``(first, attempt, outcome, last, succeeded, n)`` joined where the next begins at most ``gap`` after one's end; in
    whatever order they came. Times are microseconds."""
    out: list[tuple] = []
    for r in sorted(runs):
        if out and r[0] - out[-1][3] <= gap:
            a = out[-1]
            out[-1] = (a[0], a[1], a[2], max(a[3], r[3]), max(a[4], r[4]), a[5] + r[5])
        else:
            out.append(r)
    return out


def runs_of(at: np.ndarray, attempt: np.ndarray, outcome: np.ndarray, gap: int) -> list[tuple]:
    """The runs of some attempts."""
    order = np.lexsort((attempt, at))
    at, attempt, outcome = at[order], attempt[order], outcome[order]
    cuts = [0, *(np.flatnonzero(np.diff(at) > gap) + 1).tolist(), len(at)]
    runs = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        good = at[a:b][outcome[a:b] == "ok"]
        runs.append((int(at[a]), int(attempt[a]), str(outcome[a]), int(at[b - 1]), int(good.max()) if len(good) else NEVER, b - a))
    return runs


def acquisition_runs(stream: DataFrame, gap_ms: int, late: str) -> DataFrame:
    """Closed runs of attempts per case and field: when they began and ended, how many, how the first one ended, and whether the field
    was ``recovered`` (a transient failure first, then success), ``obtained`` or ``failed``. Rows of the stream: ``case_id``, ``field``, ``ts``,
    ``attempt`` (order within an instant) and ``outcome`` (``ok``, ``transient``, ``failed``). A run is a session of its case and field: an attempt at
    most the gap after another belongs to the same, and it closes, and leaves the state, once the watermark is past its last attempt by the
    gap. Rows that lie behind the watermark by the gap or more are dropped. What is kept of a run does not grow with its attempts."""
    rows = stream.where("case_id is not null and field is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("case_id", "field", "ts", "attempt", F.coalesce("outcome", F.lit("failed")).alias("outcome"))
    runs = rows.groupBy("case_id", "field", F.session_window("ts", f"{gap_ms} milliseconds")).agg(
        F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.count(F.lit(1)).alias("attempts"),
        F.min_by("outcome", F.struct("ts", "attempt")).alias("first_outcome"), F.bool_or(F.col("outcome") == "ok").alias("_good"),
    )
    status = F.when(~F.col("_good"), "failed").when(F.col("first_outcome") == "transient", "recovered").otherwise("obtained")
    return runs.select("case_id", "field", "opened", "closed", "attempts", "first_outcome", status.alias("status"))
