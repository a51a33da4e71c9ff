"""The decision ledger as a stream: exactly-once decisions, de-duplication within a watermark, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.sources.shared import new_path
from gleanery.streaming.keyed import KeyedTable, first_by, latest


def ledger_stream(spark: SparkSession, path: str, schema: StructType, files: int | None = 4) -> DataFrame:
    """STR1: files of a folder as a stream, a few per batch, or all that are there."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def decisions(stream: DataFrame, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """STR1, STR2: of the rows of a key within the watermark only one, and none behind it. Repeats are rows written again by a resumed
    run, so which one stays does not matter here."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def keep_decisions(stream: DataFrame, table: KeyedTable, checkpoint: str, order: Sequence[str]) -> None:
    """Follow a stream of decisions into a table of one row per key, the first in ``order``, until all that is there is done. Run again, it
    goes on where it stopped; a batch that was lost half-way is merged again from the state before it."""
    job = stream.writeStream.foreachBatch(lambda df, n: table.upsert(df, n, first_by(*order)))
    job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_totals(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """STR3: events, failures and cost per system and window."""
    arm = F.concat(F.lit("a"), F.col("event_id") % 3).alias("arm")
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width), arm)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"), F.sum("value").alias("cost"))


def drain(stream: DataFrame, label: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder, and read it. In update mode the table has the last row of
    each of ``keys``."""
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")
    table = KeyedTable(spark, out, stream.schema, keys) if mode == "update" else None
    if table:
        job = stream.writeStream.foreachBatch(lambda df, n: table.upsert(df, n, latest()))
    else:
        job = stream.writeStream.format("parquet").option("path", out)
    job.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return table.read() if table else spark.read.schema(stream.schema).parquet(out)
