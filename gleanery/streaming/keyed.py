"""A table with one row per key, kept up by the batches of a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleanery.sources.shared import delete

#: The number of the batch that brought a row.
BATCH = "_batch"


class KeyedTable:
    """Rows lie in buckets; a batch writes the buckets that it touches anew, under its own number, and then names the version of
    every bucket in a manifest, which appears as a whole or not at all. A batch that is repeated after a loss starts from
    the manifest before it and overwrites its own files, so each batch counts once. Files of a version go when the batch after
    the one that replaced them is done.

    ``bucket`` should follow time where keys do, so that a batch touches few buckets; else keys are dealt by hash.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], bucket: Column | None = None, buckets: int = 16) -> None:
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.columns = schema.names
        self.schema = StructType([*schema.fields, StructField(BATCH, LongType())])
        self.bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string") if bucket is None else bucket.cast("string")
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifest(self, before: int | None = None) -> dict:
        """The last manifest, or the last one before a batch."""
        folder = self._at("manifests")
        names = [f.getPath().getName() for f in self.files.listStatus(folder)] if self.files.exists(folder) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        numbers = [n for n in numbers if before is None or n < before]
        if not numbers:
            return {"versions": {}, "replaced": []}
        lines = self.spark.read.text(f"{self.path}/manifests/{max(numbers)}.json", wholetext=True)
        return json.loads(lines.first()[0])

    def _commit(self, number: int, manifest: dict) -> None:
        draft, final = self._at(f"manifests/{number}.draft"), self._at(f"manifests/{number}.json")
        out = self.files.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        self.files.delete(final, False)
        if not self.files.rename(draft, final):
            raise OSError(f"could not commit batch {number} to {self.path}")

    def _rows(self, versions: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, number: int, choose: Callable[[Column], Column]) -> None:
        """Merge a batch: of the rows of a key, old and new, ``choose`` aggregates the struct of all columns to the one that stays."""
        rows = rows.select(*self.columns, F.lit(number).cast("long").alias(BATCH)).persist()
        touched = [r[0] for r in rows.select(self.bucket.alias("b")).distinct().collect()]  # buckets, not keys
        if touched:
            base = self._manifest(number)
            old = self._rows({b: v for b, v in base["versions"].items() if b in touched})
            whole = F.struct(*self.schema.names)
            merged = old.unionByName(rows).groupBy(*self.keys).agg(choose(whole).alias("_row")).select("_row.*")
            merged = merged.withColumn("bucket", self.bucket).hint("rebalance", F.col("bucket"))
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={number}")
            replaced = [[b, base["versions"][b]] for b in touched if b in base["versions"]]
            self._commit(number, {"versions": {**base["versions"], **dict.fromkeys(touched, number)}, "replaced": replaced})
            for b, v in base["replaced"]:
                delete(self.spark, f"{self.path}/version={v}/bucket={b}")
        rows.unpersist()

    def read(self) -> DataFrame:
        return self._rows(self._manifest()["versions"]).select(*self.columns)


def first_by(*order: str) -> Callable[[Column], Column]:
    """The row that comes first in an order stays."""
    return lambda row: F.min_by(row, F.struct(*order))


def latest() -> Callable[[Column], Column]:
    """The row of the last batch stays."""
    return lambda row: F.max_by(row, F.col(BATCH))
