"""Tables as delimited text: records by U+0001, fields by U+0002."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentscan.functions import text as T

OPTIONS = {"lineSep": T.RECORD, "sep": T.FIELD, "quote": "", "escape": "", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_delimited(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Separators within values become spaces, nulls empty fields."""
    clean = [T.without_separators(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns]
    df.select(*clean).write.mode(mode).options(**OPTIONS).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Empty records are dropped; blank fields are null."""
    df = spark.read.options(**OPTIONS, mode="PERMISSIVE").schema(schema).csv(path)
    blank = [T.blank_to_null(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema]
    return df.select(*blank).na.drop("all")


def with_legacy(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """The current table, or the text-only one of old if that is empty."""
    return legacy.select("text", F.lit(None).cast("string").alias("source_url"), "seq") if current.isEmpty() else current
