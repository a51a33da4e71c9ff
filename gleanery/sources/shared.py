"""Tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. A table written there cuts lineage, outlives a lost
executor and is read again by any of them. Where the setting is absent, a session in one process (tests) gets one temporary
folder instead; on a cluster that would be seen by the driver alone, so it is an error there.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or this process's own one where none is set."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="gleanery-")
    return f"file://{_own}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gleanery/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that will not be read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`, once nothing will read it again."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gleanery")
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString() + "/"  # the setting may lack a scheme
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.replace("file:///", "file:/").startswith(base.replace("file:///", "file:/")):
            delete(spark, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files behind tables that are written by now.

    Its cleaner does so once the driver has collected the plans that made them, which otherwise happens at no set time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
