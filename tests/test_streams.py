"""Streams with repeats, late rows, expiry, and a stop in the middle."""

import numpy as np
import pytest
from gleanery.sources.shared import new_path
from gleanery.streaming import attempts, keyed, ledger
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HOUR = 3600
#: A watermark begins at the epoch, and rows at it count as late.
START = 1000 * HOUR


def schema(text):
    return StructType.fromDDL(text)


def deliver(spark, folder, rows, names):
    spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds(F.col("ts") + START)).coalesce(1).write.mode("append").parquet(folder)


# --- attempts ---------------------------------------------------------------------------------------------------------


def follow(spark, folder, out, state):
    kind = schema("case_id long, field string, ts timestamp, attempt long, outcome string")
    runs = attempts.acquisition_runs(ledger.ledger_stream(spark, folder, kind, None), 2 * HOUR * 1000, "1 hour")
    with attempts.keyed_state(spark):
        runs.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(runs.schema).parquet(out).collect()
    return sorted((r.case_id, r.field, *((int(t.timestamp()) - START) // HOUR for t in (r.opened, r.closed)), r.attempts, r.first_outcome, r.status) for r in rows)


def test_attempts_over_batches_late_rows_expiry_and_restart(spark):
    folder, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    names = "case_id long, field string, ts long, attempt long, outcome string"
    deliver(spark, folder, [(1, "html", 0, 1, "transient"), (1, "url", 0, 2, "ok"), (2, "html", 0, 3, "failed"), (2, "html", HOUR, 4, "transient"), (None, "html", 0, 9, "ok")], names)
    assert follow(spark, folder, out, state) == []  # the watermark stands at 0 h: none is closed
    # the retry comes in the next batch, from the state; another case moves the watermark to 5 h
    deliver(spark, folder, [(1, "html", 2 * HOUR, 5, "ok"), (3, "url", 6 * HOUR, 6, "transient")], names)
    first = [(1, "html", 0, 2, 2, "transient", "recovered"), (1, "url", 0, 0, 1, "ok", "obtained"), (2, "html", 0, 1, 2, "failed", "failed")]
    assert follow(spark, folder, out, state) == first
    # behind the watermark, so dropped; an attempt long after the first run is a run of its own; null outcomes are failures
    deliver(spark, folder, [(1, "html", 3 * HOUR, 7, "ok"), (1, "html", 9 * HOUR, 8, None), (4, "url", 20 * HOUR, 9, "ok")], names)
    assert follow(spark, folder, out, state) == sorted([*first, (1, "html", 9, 9, 1, "failed", "failed"), (3, "url", 6, 6, 1, "transient", "failed")])
    assert follow(spark, folder, out, state)[-1] == (3, "url", 6, 6, 1, "transient", "failed")  # nothing new, nothing twice


@pytest.mark.parametrize("seed", range(3))
def test_runs_do_not_depend_on_the_order_of_arrival(seed):
    rng = np.random.default_rng(seed)
    at, outcome = rng.integers(0, 4000, 300), rng.choice(["ok", "transient", "failed"], 300)
    attempt = np.arange(300)
    whole = attempts.runs_of(at, attempt, outcome, 20)
    runs = []
    for part in np.array_split(rng.permutation(300), 7):
        runs = attempts.merge_runs(runs + attempts.runs_of(at[part], attempt[part], outcome[part], 20), 20)
    assert runs == whole and sum(r[5] for r in runs) == 300


# --- decisions --------------------------------------------------------------------------------------------------------

NAMES = "event_id long, arm string, repeat long, case_id long, verdict string, ts long"
KIND = "event_id long, arm string, repeat long, case_id long, verdict string, ts timestamp"
KEYS = ["arm", "repeat", "case_id"]


class Lost(Exception):
    pass


class LosesABatch(keyed.KeyedTable):
    """Fails after a batch's files are written and before they count."""

    lost = False

    def _commit(self, number, manifest):
        if self.lost:
            raise Lost
        super()._commit(number, manifest)


def decide(spark, folder, table, state):
    stream = ledger.decisions(ledger.ledger_stream(spark, folder, schema(KIND), None), KEYS)
    ledger.keep_decisions(stream, table, state, ["ts", "event_id"])
    return sorted((r.arm, r.repeat, r.case_id, r.event_id, r.verdict) for r in table.read().collect())


def test_decisions_once_each_though_the_run_is_killed(spark):
    folder, path, state = (new_path(spark, n) for n in ("in", "table", "state"))
    table = LosesABatch(spark, path, schema(KIND), KEYS, buckets=3)
    deliver(spark, folder, [(i, "a", 0, i, "benign", i * HOUR) for i in range(30)], NAMES)
    want = [("a", 0, i, i, "benign") for i in range(30)]
    assert decide(spark, folder, table, state) == want
    # the resumed run writes its last ones again, then goes on
    deliver(spark, folder, [(i, "a", 0, i, "benign", i * HOUR) for i in range(20, 40)], NAMES)
    table.lost = True
    with pytest.raises(Exception, match="Lost"):
        decide(spark, folder, table, state)
    assert sorted(r.case_id for r in table.read().collect()) == list(range(30))  # half a batch is not seen
    again = LosesABatch(spark, path, schema(KIND), KEYS, buckets=3)
    want = [("a", 0, i, i, "benign") for i in range(40)]
    assert decide(spark, folder, again, state) == want
    # behind the watermark: not even a new key comes in; within it, a key that the state has forgotten is kept as it was
    deliver(spark, folder, [(90, "a", 0, 90, "phishing", 0), (91, "a", 1, 5, "phishing", 60 * HOUR)], NAMES)
    assert decide(spark, folder, again, state) == [*want, ("a", 1, 5, 91, "phishing")]
    deliver(spark, folder, [(95, "a", 0, 39, "phishing", 61 * HOUR)], NAMES)
    assert decide(spark, folder, again, state) == [*want, ("a", 1, 5, 91, "phishing")]


def test_a_repeated_batch_counts_once_and_old_files_go(spark):
    kind = schema("k long, n long")
    path = new_path(spark, "table")
    table = keyed.KeyedTable(spark, path, kind, ["k"], bucket=F.col("k") % 2)
    one, two = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], kind), spark.createDataFrame([(1, 5), (5, 5)], kind)
    table.upsert(one, 0, keyed.latest())
    table.upsert(two, 1, keyed.latest())
    table.upsert(two, 1, keyed.latest())
    table.upsert(two.limit(0), 2, keyed.latest())
    assert sorted(map(tuple, table.read().collect())) == [(1, 5), (2, 1), (3, 1), (5, 5)]
    assert table.files.exists(table._at("version=0/bucket=1"))  # a reader of the manifest before may still be at it
    table.upsert(spark.createDataFrame([(2, 7)], kind), 3, keyed.latest())
    assert not table.files.exists(table._at("version=0/bucket=1")) and table._manifest()["versions"] == {"0": 3, "1": 1}
    assert sorted(map(tuple, table.read().collect())) == [(1, 5), (2, 7), (3, 1), (5, 5)]
    assert keyed.KeyedTable(spark, new_path(spark, "none"), kind, ["k"]).read().count() == 0


def test_attempts_are_sessions_that_touch_at_the_gap(spark):
    folder, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    names = "case_id long, field string, ts long, attempt long, outcome string"
    rows = [(1, "html", 0, 1, "failed"), (1, "html", 0, 0, "transient"), (1, "html", 2 * HOUR, 2, "ok"), (1, "html", 4 * HOUR + 1, 3, "transient"), (2, "url", 30 * HOUR, 4, "ok")]
    deliver(spark, folder, rows, names)
    runs = attempts.acquisition_runs(ledger.ledger_stream(spark, folder, schema("case_id long, field string, ts timestamp, attempt long, outcome string"), None), 2 * HOUR * 1000, "1 hour")
    assert "Python" not in runs._jdf.queryExecution().analyzed().toString() and "session_window" in runs._jdf.queryExecution().analyzed().toString()
    assert follow(spark, folder, out, state) == [(1, "html", 0, 2, 3, "transient", "recovered"), (1, "html", 4, 4, 1, "transient", "failed")]


def test_deliveries_follow_the_time_whatever_the_ids(spark):
    from gleanery.plans.streaming_queries import _by_time

    rows = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 37 % 100).alias("ts"))
    one, two, three = _by_time(rows, (0, 0.4, 0, 0), (0.4, 0.7, 0, 0), (0.7, 1, 0, 0.3))
    assert one.agg(F.max("ts")).first()[0] < two.agg(F.min("ts")).first()[0]
    assert (one.count(), two.count(), three.count()) == (80, 60, 120)
    assert [x.count() for x in _by_time(rows.limit(0), (0, 1, 0, 0))] == [0]
