"""Streaming queries over the events table: each drains what is there and returns the sink's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.plans.registry import query, rounded
from gleanery.sources.shared import new_path
from gleanery.sources.tables import read_table
from gleanery.streaming import attempts, ledger
from gleanery.streaming.keyed import KeyedTable


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = ledger.ledger_stream(spark, f"{sf_dir}/events.parquet*", read_table(spark, sf_dir, "events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _deliveries(rows: DataFrame, *parts: tuple[float, float, float, float]) -> list[DataFrame]:
    """Rows by the share of ``event_id`` at which they lie: each delivery has a stretch, and one that was delivered before."""
    last = rows.agg(F.max("event_id")).first()[0] or 0
    share = F.col("event_id") / (last + 1)
    return [rows.where(((share >= a) & (share < b)) | ((share >= c) & (share < d))) for a, b, c, d in parts]


def _by_time(rows: DataFrame, *parts: tuple[float, float, float, float]) -> list[DataFrame]:
    """The same by the share of the time, whatever the order of the ids."""
    at = F.unix_micros("ts")
    first, last = rows.agg(F.min(at), F.max(at)).first()
    share = (at - F.lit(first or 0)) / F.lit((last or 0) - (first or 0) + 1)
    return [rows.where(((share >= a) & (share < b)) | ((share >= c) & (share < d))) for a, b, c, d in parts]


@query("SELECT 'a' || (event_id % 3) AS arm, event_id // 3 % 2 AS repeat, event_id // 6 AS case_id, event_type AS verdict, ts FROM events WHERE event_type <> 'error'")
def str1_str2_exactly_once_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a run that was stopped twice and wrote its last ones again each time, and its first ones, long past, too: a row per arm,
    repeat and case. The query that follows them stops and starts with it."""
    e = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("event_type <> 'error'")
    arm, i = F.concat(F.lit("a"), F.col("event_id") % 3).alias("arm"), F.expr("event_id div 3")
    rows = e.select("event_id", arm, (i % 2).alias("repeat"), F.expr("event_id div 6").alias("case_id"), F.col("event_type").alias("verdict"), "ts")
    keys, folder, state = ["arm", "repeat", "case_id"], new_path(spark, "arrivals"), new_path(spark, "decisions-state")
    table = KeyedTable(spark, new_path(spark, "decisions"), rows.schema, keys)
    for part in _deliveries(rows, (0, 0.5, 0, 0), (0.5, 0.8, 0.4, 0.5), (0.8, 1, 0, 0.1)):
        part.write.mode("append").parquet(folder)
        stream = ledger.decisions(ledger.ledger_stream(spark, folder, rows.schema, None), keys)
        ledger.keep_decisions(stream, table, state, ["ts", "event_id"])
    return table.read().select(*keys, "verdict", "ts")


DAY_MS = 24 * 3600 * 1000


@query(
    """WITH a AS (SELECT user_id AS case_id, event_type AS field, ts, event_id AS attempt, ['transient', 'failed', 'ok'][floor(value)::INT % 3 + 1] AS outcome FROM events),
 g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY case_id, field ORDER BY ts, attempt) > INTERVAL 1 DAY AS cut FROM a),
 s AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY case_id, field ORDER BY ts, attempt) AS run FROM g),
 r AS (SELECT case_id, field, min(ts) AS opened, max(ts) AS closed, count(*) AS attempts, arg_min(outcome, attempt) AS first_outcome, bool_or(outcome = 'ok') AS good FROM s GROUP BY case_id, field, run)
 SELECT case_id, field, opened, closed, attempts, first_outcome, CASE WHEN NOT good THEN 'failed' WHEN first_outcome = 'transient' THEN 'recovered' ELSE 'obtained' END AS status
 FROM r WHERE closed + INTERVAL 1 DAY <= (SELECT max(ts) FROM a) - INTERVAL 1 DAY"""
)
def str4_recovered_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of attempts at each case and field, closed after a day without another, from three deliveries with a restart between them; the
    last one brings rows that are long too late."""
    e = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    outcome = F.element_at(F.array(*map(F.lit, ("transient", "failed", "ok"))), (F.floor("value") % 3 + 1).cast("int")).alias("outcome")
    rows = e.select("event_id", F.col("user_id").alias("case_id"), F.col("event_type").alias("field"), "ts", F.col("event_id").alias("attempt"), outcome)
    folder, out, state = new_path(spark, "arrivals"), new_path(spark, "runs"), new_path(spark, "runs-state")
    for part in _by_time(rows, (0, 0.4, 0, 0), (0.4, 0.7, 0, 0), (0.7, 1, 0, 0.3)):
        part.write.mode("append").parquet(folder)
        runs = attempts.acquisition_runs(ledger.ledger_stream(spark, folder, rows.schema, None), DAY_MS, "1 day")
        with attempts.keyed_state(spark):
            job = runs.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            job.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(runs.schema).parquet(out)


@query("SELECT CAST(ts AS DATE) AS day, 'a' || (event_id % 3) AS arm, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def str3_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger.drain(ledger.running_totals(_stream(spark, sf_dir)), "totals", "update", ["window", "arm"])
    return rounded(t.select(F.to_date("window.start").alias("day"), "arm", "n", "failures", "cost"), 4)
