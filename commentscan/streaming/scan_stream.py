"""The periodic scan and the moderation log as streams.

Each micro-batch is one scan: the lexicon and the known tables are read afresh at its start, results are written
under the batch id, and a batch that runs again after a failure replaces what it wrote before.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from commentscan.config import BATCH, CAPS, ScanConfig
from commentscan.functions import text as T
from commentscan.operators import scan as S
from commentscan.operators import state as M
from commentscan.sources.keyed import KeyedTable
from commentscan.sources.scratch import remove

LexiconReader = Callable[[], DataFrame]


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of batches; an empty one before the first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, batch_id int")
    return spark.read.schema(f"{schema}, batch_id int").parquet(path)


FLAGGED = "comment_id string, text string, source_url string, score float"
STATS = "part long, ts timestamp, total long, flagged long, asked long, errors long, new_flags long"
LAST = "seq long, comment_id string, text string"
COUNTS = ("total", "flagged", "asked", "errors", "new_flags")


def known_texts(spark: SparkSession, out: str) -> KeyedTable:
    """Which comments were flagged with a text, by its hash."""
    return KeyedTable(spark, f"{out}/known", "key string, comment_id string")


def item_states(spark: SparkSession, out: str) -> KeyedTable:
    """The state of each item after the last batch of actions that touched it."""
    return KeyedTable(spark, f"{out}/states", STATE, newest=True)


def flagged_or_hidden(spark: SparkSession, out: str, keys: DataFrame, before: int) -> DataFrame:
    """Of some texts' hashes (key), those that earlier batches flagged and that no one has deleted, corrected or cleared since.

    The moderation stream keeps the states in the same folder; a comment without one is as it was flagged. Both tables are
    asked for what the batch holds, not read.
    """
    flags = known_texts(spark, out).lookup(keys, before)
    items = item_states(spark, out).lookup(flags.select(F.col("comment_id").alias("key")))
    gone = M.named_states(items.withColumnRenamed("key", "item_id"), _clears(spark, out)).filter("state = 'none'").select(F.col("item_id").alias("comment_id"))
    return flags.join(gone, "comment_id", "left_anti").select("key").distinct()


def _numbered(rows: DataFrame, size: int, path: str) -> DataFrame:
    """rows with part: which of the scans of `size` comments each, in the order of seq, a row belongs to.

    Rows are dealt by ranges of seq, written under path and counted; then they are numbered within their ranges.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq").withColumn("_range", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(path)
    ranged = spark.read.parquet(path)
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("_range").count().collect()):  # a row for each range
        offsets.append((r["_range"], before))
        before += r["count"]
    offsets = spark.createDataFrame(offsets, "_range int, _before long")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("seq")) + F.col("_before") - 1
    return ranged.join(F.broadcast(offsets), "_range").withColumn("part", F.floor(nth / size).cast("long")).drop("_range", "_before")


def scan_batch(batch: DataFrame, batch_id: int, out: str, phrases: LexiconReader, config: ScanConfig, model=None, opinion=None, size: int | None = None, at: datetime | None = None) -> dict[str, int]:
    """Scan one batch of comments (comment_id, text, source_url, perhaps seq) into the tables under `out`; returns its statistics.

    Decisions are written once, and all else is read from there. Comments arrive in the order of seq, or without one in that of
    the batch. With a size, each so many of them are a scan of their own, with its row of statistics, and a text that an earlier one
    flagged is known to it; else the batch is one scan. A batch without comments, or without flags, has statistics too.
    """
    spark, at = batch.sparkSession, at or datetime.now(UTC)
    arrival = F.col("seq").cast("long") if "seq" in batch.columns else F.monotonically_increasing_id()
    slim = batch.select("comment_id", "text", "source_url", arrival.alias("seq"))
    path = f"{out}/decided/batch_id={batch_id}"
    S.decide(slim, phrases(), config, model, opinion).select("seq", "comment_id", "text", "source_url", "score", "flagged", "asked", "error").write.mode("overwrite").parquet(path)
    decided = spark.read.parquet(path)
    ranges = f"{out}/ranges/batch_id={batch_id}"
    decided = _numbered(decided, size, ranges) if size else decided.withColumn("part", F.lit(0).cast("long"))
    flagged = decided.filter("flagged").withColumn("key", S.text_key(F.col("text")))
    known = flagged_or_hidden(spark, out, flagged, batch_id)
    first = flagged.groupBy("key").agg(F.min("part").alias("part"))
    fresh = flagged.join(known, "key", "left_anti").join(first, ["key", "part"], "left_semi")
    _write_batch(fresh.select("comment_id", "text", "source_url", "score", "key", "part"), f"{out}/flagged", batch_id)
    written = spark.read.parquet(f"{out}/flagged/batch_id={batch_id}")
    known_texts(spark, out).append(written.select("key", "comment_id"), batch_id)
    counts = F.count("*").alias("total"), F.count_if("flagged").alias("flagged"), F.count_if("asked").alias("asked"), F.count("error").alias("errors")
    parts = decided.groupBy("part").agg(*counts) if size and not decided.isEmpty() else decided.agg(F.lit(0).cast("long").alias("part"), *counts)
    new = written.groupBy("part").agg(F.count("*").alias("new_flags"))
    stats = parts.join(new, "part", "left").na.fill(0, ["new_flags"]).select("part", F.lit(at).cast("timestamp").alias("ts"), *COUNTS)
    _write_batch(stats if size else stats.coalesce(1), f"{out}/stats", batch_id)
    last = decided.agg(F.max("part").alias("part"))
    kept = decided.join(F.broadcast(last), "part").orderBy(F.desc("seq")).limit(CAPS["last_comments"])  # one row
    _write_batch(kept.select("seq", "comment_id", T.without_separators(F.col("text"), both=False).alias("text")), f"{out}/last", batch_id)
    remove(spark, path)
    remove(spark, ranges)
    remove(spark, f"{out}/last/batch_id={batch_id - 1}")  # overwritten, by the batch that counts
    done = spark.read.parquet(f"{out}/stats/batch_id={batch_id}").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTS))
    return done.first().asDict()


def last_comments(spark: SparkSession, out: str) -> DataFrame:
    """The comments of the last batch, in the order of arrival, at most as many as the table holds."""
    table = read_table(spark, f"{out}/last", LAST)
    return table.join(F.broadcast(table.agg(F.max("batch_id").alias("batch_id"))), "batch_id").drop("batch_id").orderBy("seq")  # one row


def scan_history(spark: SparkSession, out: str, cap: int | None = CAPS["history"]) -> DataFrame:
    """(ts, batch_id, part, and COUNTS) of the last scans."""
    rows = read_table(spark, f"{out}/stats", STATS).withColumn("place", F.struct("batch_id", "part"))
    return M.keep_last(rows, cap, order="place").drop("place")


TOTALS = "total_processed long, scans long, latest struct<ts: timestamp, total: long, flagged: long>"


def start_totals(history: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Follow a stream of scans (ts, total, flagged): comments processed, scans, and the latest scan, in one row under `out`.

    The aggregate lives in the state store; a batch writes the row as it then is, and removes the one before.
    """
    scan = F.struct("ts", F.col("total").cast("long").alias("total"), F.col("flagged").cast("long").alias("flagged"))
    totals = history.groupBy().agg(F.sum(F.greatest("total", F.lit(0))).cast("long").alias("total_processed"), F.count("*").alias("scans"), F.max(scan).alias("latest"))

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch.coalesce(1), f"{out}/totals", batch_id)
        remove(batch.sparkSession, f"{out}/totals/batch_id={batch_id - 1}")

    trigger = {"availableNow": True} if once else {"processingTime": "1 minute"}
    return totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """The row of the last batch of start_totals; none before the first."""
    table = read_table(spark, f"{out}/totals", TOTALS)
    return table.join(F.broadcast(table.agg(F.max("batch_id").alias("batch_id"))), "batch_id").drop("batch_id")  # one row


PROGRESS = "run string, batch long, done long, total long, message string, ts timestamp"


class ScanProgress(StreamingQueryListener):
    """Keeps a table of how far a stream of scans is: a row as it starts, one for each batch, one as it ends."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.name, self.run, self.done, self.ended = spark, out, f"scan-{uuid.uuid4().hex}", None, 0, False

    def put(self, batch: int, message: str, total: int) -> None:
        rows = [(self.name, batch, self.done, total, message, datetime.now(UTC))]
        self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(f"{self.out}/progress")

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:  # told before the stream's start returns, so before all that follows
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.run and event.progress.numInputRows:
            self.done += event.progress.numInputRows
            self.put(event.progress.batchId, f"Classified {self.done}/{self.done}", self.done)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.put(-1, f"Failed: {event.exception}" if event.exception else "Done", self.done)
            self.ended = True

    def wait(self, seconds: float = 60) -> None:
        """Until the last row is written; the events of a stream come after it."""
        until = time.time() + seconds
        while not self.ended and time.time() < until:
            time.sleep(0.1)
        self.spark.streams.removeListener(self)


def scan_progress(spark: SparkSession, out: str) -> DataFrame:
    """What ScanProgress wrote."""
    return spark.read.schema(PROGRESS).parquet(f"{out}/progress")


def start_scan(comments: DataFrame, out: str, checkpoint: str, phrases: LexiconReader, config: ScanConfig | None = None, once: bool = False, model=None, opinion=None, size: int | None = None, progress: ScanProgress | None = None):
    """Run scans over a stream of comments: every interval, or once over all there is. progress follows the stream, where given."""
    config = (config or ScanConfig()).clamped()
    trigger = {"availableNow": True} if once else {"processingTime": f"{config.interval_minutes} minutes"}
    run = lambda batch, batch_id: scan_batch(batch, batch_id, out, phrases, config, model, opinion, size)
    writer = comments.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger)
    if progress:
        comments.sparkSession.streams.addListener(progress)
        progress.put(-1, "Starting scan", 0)
        writer = writer.queryName(progress.name)
    return writer.start()


def start_ordered_scan(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, phrases: LexiconReader, config: ScanConfig | None = None, size: int = BATCH, files: int | None = 1):
    """Scans of `size` comments each, one after the other, over the files of a folder: one file a trigger, or so many, the oldest
    first. Without a number, all files that have come since the last start are one batch; a large arrival may then be many."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false")
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    return start_scan(stream, out, checkpoint, phrases, config, once=True, size=size)


ACTIONS = "seq long, item_id string, action string"
STATE = "key string, state int, since long, at long"


def _clears(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """One row: the last clear of each table."""
    clears = read_table(spark, f"{out}/clears", CLEARS)
    earlier = clears if before is None else clears.filter(F.col("batch_id") < before)
    return earlier.agg(*(F.coalesce(F.max(n), F.lit(-1)).alias(n) for n in ("cleared_flagged", "cleared_hidden")))


def moderate_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Fold one batch of actions (seq, item_id, action) onto the states of the items that it touches, which alone are looked up.

    Actions must come in order of seq from batch to batch. Clears are a small table of their own, applied where states are read.
    """
    spark, table = batch.sparkSession, item_states(batch.sparkSession, out)
    _write_batch(M.last_clears(batch), f"{out}/clears", batch_id)
    # A batch knows its own clears only; those of earlier batches count for what an item was before it.
    known = _clears(spark, out, batch_id).select(F.col("cleared_flagged").alias("_f"), F.col("cleared_hidden").alias("_h"))
    done = M.folded(batch).crossJoin(F.broadcast(known))  # one row
    done = done.withColumn("cleared_flagged", F.greatest("cleared_flagged", "_f")).withColumn("cleared_hidden", F.greatest("cleared_hidden", "_h")).drop("_f", "_h")
    before = table.lookup(done.select(F.col("item_id").alias("key")), batch_id).withColumnRenamed("key", "item_id")
    table.append(M.onto(before, done).select(F.col("item_id").alias("key"), "state", "since", "at"), batch_id)


CLEARS = "cleared_flagged long, cleared_hidden long"


def start_moderation(actions: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Keep the states of items under `out`, batch by batch of the action log; a batch that runs again replaces what it wrote."""
    trigger = {"availableNow": True} if once else {"processingTime": "1 minute"}
    run = lambda batch, batch_id: moderate_batch(batch, batch_id, out)
    return actions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_state(spark: SparkSession, out: str) -> DataFrame:
    """(item_id, state, since) after all batches."""
    return M.named_states(item_states(spark, out).all().select(F.col("key").alias("item_id"), "state", "since", "at"), _clears(spark, out))


REQUESTS = "comment_id string, action string, epoch long, text string"


def emit_requests(requests: DataFrame, batch_id: int, out: str) -> DataFrame:
    """Of requests (comment_id, action, epoch, text), those that no earlier batch emitted, once each; written and returned.

    A request is the same if comment, action and epoch are: a later epoch (say, the seq that flagged the comment again) asks anew. A
    batch that runs again emits what it emitted before.
    """
    spark = requests.sparkSession
    outbox = KeyedTable(spark, f"{out}/outbox", "key string")
    keyed = requests.select("comment_id", "action", F.col("epoch").cast("long").alias("epoch"), "text").withColumn("key", F.to_json(F.struct("comment_id", "action", "epoch")))
    # Written, as the lookup and what follows read them several times.
    asked = f"{out}/asked/batch_id={batch_id}"
    keyed.groupBy("key").agg(F.min(F.struct("comment_id", "action", "epoch", "text")).alias("r")).write.mode("overwrite").parquet(asked)
    once = spark.read.parquet(asked)
    fresh = once.join(outbox.lookup(once, batch_id).select("key"), "key", "left_anti")
    _write_batch(fresh.select("key", "r.*"), f"{out}/requests", batch_id)
    written = spark.read.parquet(f"{out}/requests/batch_id={batch_id}")
    outbox.append(written.select("key"), batch_id)
    remove(spark, asked)
    return written.drop("key")
