"""What several of the training-data operators need: paths, text keys and tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentscan.functions.text import unused
from commentscan.sources.scratch import remove, scratch
from commentscan.sources.tables import spread, table  # noqa: F401

#: The white space of all word and line rules here: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later stages start from files that outlive executors.

    The files go when the Python process ends, or with `drop`.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.scratch_path = path
    return read


def drop(table: DataFrame) -> None:
    """Remove a written table that nothing will read again."""
    remove(table.sparkSession, table.scratch_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. `lower` is the quick way for pure ASCII; elsewhere it would fold other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only for a counted size; past the limit Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: inside a lambda, Spark would compute a spelled-out one at each step."""
    return F.get(F.transform(F.array(value), body), 0)


def may_be_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows without most of those whose key (long) is not among keys: a filter before a join that would move them all.

    Keys are marked in a bitmap of 16 bits each, rounded up, in pieces of 4 KB; it is broadcast, and holds 32 MB at most. Past some
    hundred million keys it fills up and lets more pass.
    """
    bits = min(max(15, (16 * keys.count()).bit_length()), 28)
    slot = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    piece = unused("_piece", rows)
    bitmap = unused("_bitmap", rows)
    marked = keys.groupBy(F.shiftright(slot, 15).alias(piece)).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias(bitmap))
    at = slot.bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn(piece, F.shiftright(slot, 15)).join(F.broadcast(marked), piece)
    return found.filter(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).drop(piece, bitmap)
