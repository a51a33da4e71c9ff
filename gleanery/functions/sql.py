"""Library functions for use from SQL, and the one text function that the JVM lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# UDF1: SQL functions; Catalyst inlines them, so they cost what their expression costs.
SQL_FUNCTIONS = {
    "token_estimate(t STRING) RETURNS BIGINT": "CAST(ceil(length(t) / 4) AS BIGINT)",
    "clipped_logit(p DOUBLE) RETURNS DOUBLE": "CASE WHEN p IS NOT NULL THEN ln(least(0.99D, greatest(0.01D, p)) / (1 - least(0.99D, greatest(0.01D, p)))) END",
    "short_hash(t STRING) RETURNS STRING": "substr(sha2(t, 256), 1, 20)",
    "f1_score(tp BIGINT, fp BIGINT, fn BIGINT) RETURNS DOUBLE": "try_divide(2.0D * tp, CAST(2 * tp + fp + fn AS DOUBLE))",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


@F.pandas_udf(StringType())
def fold_marks(text: pd.Series) -> pd.Series:
    """UDF2: letters without their marks (NFKD); null stays null. An Arrow batch at a time."""
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")
