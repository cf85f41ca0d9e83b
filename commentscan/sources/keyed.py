"""Tables that grow batch by batch and are asked for a few keys at a time.

A batch adds one segment. Each FAN segments of a level are merged into one of the next, so there are few, and which ones exist
follows from the number of batches alone. A segment is a Parquet table with a folder for each range of hashes, and a Bloom filter
for each folder: a lookup opens only the folders that may hold its keys, however many batches came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentscan.sources.scratch import remove

#: Segments that are merged into one.
FAN = 10
#: Folders of a segment: of a batch's own, of those that are made of FAN of these, and of all larger ones.
FOLDERS = (1, 16, 256)
FILTER = "folder int, part long, bitmap binary, slots long"
#: Bits of a filter for each row, and the least and most of a folder (log2).
BITS_ROW, BITS_LEAST, BITS_MOST = 16, 15, 24


class KeyedTable:
    """Rows of `schema` (DDL) with a column `key` (string), under a path. newest: of rows with one key, the last batch's counts;
    otherwise all different rows do. A batch that is appended again replaces what it wrote, as long as no later one was appended."""

    def __init__(self, spark: SparkSession, path: str, schema: str, newest: bool = False):
        self.spark, self.path, self.schema, self.newest, self.opened = spark, path, f"{schema}, batch long", newest, 0

    # Segments are (level, last batch); one of level l holds FAN ** l batches.

    def _at(self, segment: tuple[int, int]) -> str:
        return f"{self.path}/level-{segment[0]}/{segment[1]}"

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _is_there(self, segment: tuple[int, int]) -> bool:
        files, path = self._files()
        return files.exists(path(f"{self._at(segment)}/filter/_SUCCESS"))

    def batches(self) -> int:
        """One more than the last batch's number."""
        files, path = self._files()
        if not files.exists(path(f"{self.path}/level-0")):
            return 0
        return 1 + max((int(s.getPath().getName()) for s in files.listStatus(path(f"{self.path}/level-0"))), default=-1)

    def segments(self, before: int | None = None) -> list[tuple[int, int]]:
        """Those that hold the batches before one, the largest first."""
        n, begin, out = self.batches() if before is None else before, 0, []
        for level in range(20, -1, -1):
            while begin + FAN**level <= n:
                begin += FAN**level
                out.append((level, begin - 1))
        return [s for s in out if self._is_there(s)]

    def _hashed(self, rows: DataFrame, folders: int) -> DataFrame:
        h = F.xxhash64("key")
        return rows.withColumn("_h", h).withColumn("folder", F.pmod("_h", F.lit(folders)).cast("int"))

    def _write(self, rows: DataFrame, segment: tuple[int, int]) -> None:
        folders = FOLDERS[min(segment[0], len(FOLDERS) - 1)]
        at, placed = self._at(segment), self._hashed(rows, folders)
        if folders > 1:
            placed = placed.repartition("folder")
        placed.drop("_h").sortWithinPartitions("folder", "key").write.mode("overwrite").partitionBy("folder").parquet(f"{at}/rows")
        written = self._hashed(self._rows(segment), folders)
        bits = min(max(BITS_LEAST, (BITS_ROW * written.count() // folders).bit_length()), BITS_MOST)
        slot = _slot(F.lit(1 << bits).cast("long"))
        filters = written.groupBy("folder", F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bitmap"))
        filters.withColumn("slots", F.lit(1 << bits).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{at}/filter")

    def _rows(self, segment: tuple[int, int], folders: list[int] | None = None) -> DataFrame:
        at = f"{self._at(segment)}/rows"
        read = self.spark.read.schema(f"{self.schema}, folder int").option("basePath", at)
        found = read.parquet(*[f"{at}/folder={n}" for n in folders]) if folders else read.parquet(at)
        return found.drop("folder")

    def append(self, rows: DataFrame, batch: int) -> None:
        # What the last batch merged is read no more once this one begins.
        for level in range(1, 20):
            if batch % FAN**level == 0 and batch:
                for k in range(FAN):
                    if (level - 1, batch - 1 - k * FAN ** (level - 1)) != (0, batch - 1):
                        remove(self.spark, self._at((level - 1, batch - 1 - k * FAN ** (level - 1))))
        self._write(rows.withColumn("batch", F.lit(batch).cast("long")), (0, batch))
        level = 1
        while (batch + 1) % FAN**level == 0:
            parts = [s for s in ((level - 1, batch - k * FAN ** (level - 1)) for k in range(FAN)) if self._is_there(s)]
            self._write(self._reduced([self._rows(s) for s in parts]), (level, batch))
            level += 1

    def _reduced(self, tables: list[DataFrame]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], self.schema)
        rows = tables[0]
        for table in tables[1:]:
            rows = rows.unionByName(table)
        others = [c for c in rows.columns if c not in ("key", "batch")]
        if self.newest:
            return rows.groupBy("key").agg(F.max_by(F.struct(*others, "batch"), "batch").alias("_last")).select("key", "_last.*")
        return rows.groupBy("key", *others).agg(F.max("batch").alias("batch"))

    def all(self, before: int | None = None) -> DataFrame:
        return self._reduced([self._rows(s) for s in self.segments(before)])

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of some keys (key). It counts in `opened` how many folders it reads."""
        segments, tables, self.opened = self.segments(before), [], 0
        asked = keys.select("key").distinct()
        filters = [self.spark.read.schema(FILTER).parquet(f"{self._at(s)}/filter").select(F.lit(k).alias("segment"), F.lit(FOLDERS[min(s[0], len(FOLDERS) - 1)]).alias("folders"), "*") for k, s in enumerate(segments)]
        if filters:
            each = filters[0]
            for table in filters[1:]:
                each = each.unionByName(table)
            spread = asked.select(F.xxhash64("key").alias("_h"), F.explode(F.array(*map(F.lit, FOLDERS))).alias("folders")).withColumn("folder", F.pmod("_h", "folders").cast("int"))
            slot = _slot(F.col("slots"))
            byte = F.conv(F.hex(F.substring("bitmap", (F.shiftright(slot.bitwiseAND(32767), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            held = (F.shiftright(slot, 15) == F.col("part")) & (F.getbit(byte, slot.bitwiseAND(7).cast("int")) == 1)
            # As many rows as there are folders, at most.
            for r in spread.join(each, ["folders", "folder"]).filter(held).groupBy("segment").agg(F.collect_set("folder").alias("some")).collect():
                tables.append(self._rows(segments[r["segment"]], sorted(r["some"])))
                self.opened += len(r["some"])
        return self._reduced([t.join(asked, "key", "left_semi") for t in tables])


def _slot(slots: Column) -> Column:
    """Of _h, whose lowest byte names the folder: a number below slots, a power of two."""
    return F.shiftrightunsigned(F.col("_h"), 8).bitwiseAND(slots - 1)
