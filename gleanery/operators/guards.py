"""Guards that refuse a job's input. Each looks for offending rows in Spark and raises with the first of them; the frame itself
is returned unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """The input breaks a rule that every later result relies on."""


def _refuse(bad: DataFrame, why: str) -> None:
    rows = bad.limit(3).collect()
    if rows:
        raise Refused(f"{why}: " + "; ".join(str(tuple(r)) for r in rows))


def parent_decisions(events: DataFrame) -> DataFrame:
    """FIL3: decisions on whole cases; those on child objects are never scored."""
    return events.where((F.col("kind") == "decision") & F.col("parent_object_id").isNull())


def require_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """FIL4: no value, null included, outside the vocabulary."""
    _refuse(df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(column), f"{column} outside its vocabulary")
    return df


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FIL4: one row a key; null keys are keys like others."""
    _refuse(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"repeated {', '.join(keys)}")
    return df


def require_one(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """FIL19: one value of each column a key, such as one model and one data version a run."""
    counts = df.groupBy(*keys).agg(*(F.count_distinct(c).alias(c) for c in columns))
    mixed = F.lit(False)
    for c in columns:
        mixed = mixed | (F.col(c) > 1)
    _refuse(counts.where(mixed), f"mixed {', '.join(columns)}")
    return df


def split_mismatches(df: DataFrame, manifest: DataFrame, split: str) -> DataFrame:
    """FIL6: rows whose case is not of the declared split by the manifest: ``(case_id, split)``, null where it is not listed."""
    listed = manifest.select("case_id", "split")
    found = df.select("case_id").distinct().join(listed, "case_id", "left")
    return found.where(~F.coalesce(F.col("split") == split, F.lit(False)))


def require_split(df: DataFrame, manifest: DataFrame, split: str) -> DataFrame:
    """FIL6: refuses rows that are not from the declared split."""
    _refuse(split_mismatches(df, manifest, split), f"not from {split}")
    return df


def unnamed_models(df: DataFrame, stand_ins: Sequence[str], column: str = "model_id") -> Column:
    """FIL5: whether a row's model is missing, unnamed or a stand-in; case and outer spaces do not matter."""
    name = F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))
    return (name == "") | name.isin(*(s.lower() for s in stand_ins))
