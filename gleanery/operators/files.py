"""SNK5, SNK6, SRC8: versions, checksums and listings of the files of a folder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, globs: Sequence[str] = ("*",)) -> DataFrame:
    """``(path, sha256, bytes)`` of the files that a glob names, below the folder; a file that several name is listed once. Files whose names
    begin with ``_`` or ``.`` are Spark's own and never listed, and its reader passes over empty files; a file may have 2 GB. A folder without such files gives no rows."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    at = files.makeQualified(root).toString().rstrip("/")
    some = [f"{at}/{g}" for g in globs if len(files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{g}")) or [])]
    if not some:
        return spark.createDataFrame([], "path string, sha256 string, bytes long")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(some)
    name = F.expr(f"substring(path, instr(path, '{_plain(at)}/') + {len(_plain(at)) + 1})")
    return rows.select(name.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).distinct()


def _plain(at: str) -> str:
    """A path without its scheme's slashes, as stores write them differently."""
    return "/" + at.split(":", 1)[-1].lstrip("/").replace("'", "\\'")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h, n = hashlib.sha256(), 0
    for batch in batches:
        for line in batch.column("line").to_pylist():
            h.update((("\n" if n else "") + line).encode())
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()[:16]]), pa.array([n], pa.int64())], ["version", "files"])


def version(files: DataFrame) -> DataFrame:
    """SNK5: one row ``(version, files)``: the first 16 hex digits of the hash of all ``sha256  path`` lines in the order of the paths. One
    hash of all lines is one stream by its nature: a task reads them sorted and holds the hash alone. No files give no row."""
    lines = files.select("path", F.concat_ws("  ", "sha256", "path").alias("line"))
    return lines.repartition(1).sortWithinPartitions("path").select("line").mapInArrow(_digest, "version string, files long")


def verify(stored: DataFrame, now: DataFrame) -> DataFrame:
    """SNK6: ``(path, state)``: ``same``, ``modified``, ``missing`` now, or ``added`` since."""
    j = stored.select("path", F.col("sha256").alias("_was")).join(now.select("path", F.col("sha256").alias("_now")), "path", "full_outer")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_was").isNull(), "added").when(F.col("_was") == F.col("_now"), "same").otherwise("modified")
    return j.select("path", state.alias("state"))


def complete(files: DataFrame, required: Sequence[str]) -> DataFrame:
    """SRC8: ``(folder)``: folders that hold all required names, files or folders."""
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("path", r"/?[^/]*$", "")
    every = files.select(folder.alias("folder"), name.alias("name"))
    above = every.where("folder <> ''").select(F.regexp_replace("folder", r"/?[^/]*$", "").alias("folder"), F.regexp_extract("folder", r"([^/]*)$", 1).alias("name"))
    g = every.unionByName(above).groupBy("folder").agg(*(F.bool_or(F.col("name") == r).alias(f"_{i}") for i, r in enumerate(required)))
    for i in range(len(required)):
        g = g.where(f"_{i}")
    return g.select("folder")
