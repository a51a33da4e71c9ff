"""Queries on real files in the shared folder: checksums, versions and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import files
from gleanery.plans.registry import query
from gleanery.sources.shared import delete, materialize, new_path
from gleanery.sources.tables import read_table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    return read_table(spark, sf_dir, "documents").where("source is not null").select("source", (F.expr("doc_id div 16") % 4).alias("k"), line.alias("line"))


def _store(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder with a file for each source and quarter of the ids, but none for the last quarter of every third source."""
    path, d = new_path(spark, "files"), _lines(spark, sf_dir)
    d = d.where("not (k = 3 and pmod(cast(regexp_extract(source, '([0-9]+)$', 1) as int), 3) = 0)")
    d.repartition("source", "k").sortWithinPartitions("source", "k", "line").write.partitionBy("source", "k").text(path)
    return path, d


STORE_SQL = """d AS (SELECT source, doc_id // 16 % 4 AS k, doc_id || ':' || sha256(text) AS line FROM documents WHERE source IS NOT NULL AND NOT (doc_id // 16 % 4 = 3 AND coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 = 0, false))),
 s AS (SELECT source, k, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS sha256, sum(len(line) + 1)::BIGINT AS bytes FROM d GROUP BY source, k)"""


def _folder(df: DataFrame) -> DataFrame:
    """Spark names a file by chance, so its folder, which has one, stands for it."""
    return df.withColumn("path", F.regexp_replace("path", r"/[^/]*$", ""))


@query(f"WITH {STORE_SQL} SELECT 'source=' || source || '/k=' || k AS path, sha256, bytes, (SELECT substr(sha256(string_agg(sha256 || '  source=' || source || '/k=' || k, chr(10) ORDER BY 'source=' || source || '/k=' || k)), 1, 16) FROM s) AS version FROM s")
def snk5_src8_file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of all files of a folder, and the version that they make."""
    path, _ = _store(spark, sf_dir)
    found = materialize(_folder(files.listing(spark, path)), "listing")
    return found.crossJoin(F.broadcast(files.version(found).select("version")))  # one row


@query(
    f"""WITH {STORE_SQL}, f AS (SELECT min(source) AS one, max(source) AS two FROM s) SELECT 'source=' || source || '/k=' || k AS path, CASE WHEN source = one AND k = 0 THEN 'modified' WHEN source = two AND k = 1 THEN 'missing' ELSE 'same' END AS state FROM s, f
 UNION ALL SELECT 'source=new/k=0', 'added'"""
)
def snk6_file_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against checksums that were taken before one of them was changed, one removed and one added."""
    path, d = _store(spark, sf_dir)
    stored = materialize(_folder(files.listing(spark, path)), "listing")
    ends = d.agg(F.min("source").alias("one"), F.max("source").alias("two")).first()
    changed = d.where((F.col("source") == ends.one) & (F.col("k") == 0)).select(F.concat("line", F.lit("!")).alias("line")).coalesce(1)
    changed.write.mode("overwrite").text(f"{path}/source={ends.one}/k=0")
    delete(spark, f"{path}/source={ends.two}/k=1")
    changed.write.text(f"{path}/source=new/k=0")
    return files.verify(stored, _folder(files.listing(spark, path)))


@query(f"WITH {STORE_SQL} SELECT 'source=' || source AS folder FROM s GROUP BY source HAVING count(*) = 4")
def src8_complete_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with an entry for each quarter of the ids."""
    path, _ = _store(spark, sf_dir)
    return files.complete(files.listing(spark, path, ("source=*",)), [f"k={k}" for k in range(4)])
