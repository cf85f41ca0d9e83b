"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Splits of a table that is still small enough to be dealt anew.
FEW = 16


def spread(df: DataFrame) -> DataFrame:
    """A table of few file splits over all cores. Larger tables stay as they are, however many cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(FEW, cores // 2) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
