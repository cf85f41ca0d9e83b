"""Tables that only grow, of which the last rows count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentscan.operators.state import keep_last


class CappedLog:
    """Rows appended batch by batch under a path; a batch that is written again replaces itself. The cap counts on reading.

    Appending moves the new rows only. `compact` writes what counts as one batch and drops the rest, so a reader sees either.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, cap: int | None, order: str = "seq"):
        self.spark, self.path, self.schema, self.cap, self.order = spark, path, schema, cap, order

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def all(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], f"{self.schema}, batch int")
        return self.spark.read.schema(f"{self.schema}, batch int").parquet(self.path)

    def read(self) -> DataFrame:
        """The last `cap` rows by order."""
        return keep_last(self.all(), self.cap, order=self.order).drop("batch")

    def compact(self, path: str) -> CappedLog:
        """The log at a new path, holding its last rows alone."""
        log = CappedLog(self.spark, path, self.schema, self.cap, self.order)
        last = self.all().agg(F.max("batch")).first()[0]
        log.append(self.read(), last or 0)
        return log
