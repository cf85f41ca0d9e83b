"""Tables that never hold more than a number of entries, replayed from the log of their changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commentscan.sources.scratch import scratch_table

#: Changes that one task replays.
REPLAY = 50_000
#: At one seq, what goes goes first.
_FIRST = {"clear": 0, "remove": 1, "add": 2}


def _replay(cap: int, repeats: bool):
    """Replays a stretch of a table's changes from what it held before. An add goes to the end, and the oldest leaves beyond cap;
    of a key that is there it changes nothing, unless repeats are kept. A remove takes the oldest entry of its key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(rank=rows["change"].map(_FIRST)).sort_values(["stretch_row", "seq", "rank", "key"])
        held: dict[tuple, int] = {}  # in the order of arrival; cap entries at most
        for n, (seq, key, change) in enumerate(zip(rows["seq"].tolist(), rows["key"].tolist(), rows["change"].tolist(), strict=True)):
            entry = (key, n) if repeats else (key,)
            if change == "add":
                if entry not in held:
                    held[entry] = seq
                    if len(held) > cap:
                        del held[next(iter(held))]
            elif change == "clear":
                held.clear()
            elif repeats:
                oldest = next((e for e in held if e[0] == key), None)
                held.pop(oldest, None)
            else:
                held.pop(entry, None)
        side, stretch = str(rows["side"].iloc[0]), int(rows["stretch"].iloc[0])
        columns = {"side": [side] * len(held), "stretch": [stretch] * len(held), "seq": list(held.values()), "key": [e[0] for e in held]}
        return pd.DataFrame({name: pd.Series(values, dtype=object if name in ("side", "key") else "int64") for name, values in columns.items()})

    return run


def _placed(changes: DataFrame) -> DataFrame:
    """changes with stretch, which numbers runs of REPLAY rows by (side, seq): rows are counted by ranges, and numbered within."""
    spark = changes.sparkSession
    order = ["side", "seq"]
    slim = scratch_table(changes.select("side", "seq", "key", "change"), "changes")
    if slim.count() <= REPLAY:
        return slim.withColumn("stretch", F.lit(0).cast("long"))
    ranged = slim.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = scratch_table(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("_range").count().collect()):  # a row for each range
        offsets.append((r["_range"], before))
        before += r["count"]
    offsets = spark.createDataFrame(offsets, "_range int, _before long")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before") - 1
    numbered = ranged.join(F.broadcast(offsets), "_range").withColumn("stretch", F.floor(nth / REPLAY))
    # Changes of one seq stay together.
    return scratch_table(numbered.withColumn("stretch", F.min("stretch").over(Window.partitionBy("side", "seq"))).select("side", "stretch", "seq", "key", "change"))


def capped_adds(changes: DataFrame, cap: int, repeats: bool = False) -> DataFrame:
    """changes (side, seq, key, change: add, remove or clear) to what each side holds at the end: (side, seq, key).

    Every add caps at once, so an entry that was pushed out and is added again goes to the end. That depends on all that
    came before; so stretches of REPLAY changes are replayed side by side, each from what the one before it left when last
    replayed, until nothing changes: mostly twice, as few adds bring back what an earlier stretch held. At worst, where
    hardly anything is pushed out and each stretch hangs on the last, there are as many rounds as stretches. With repeats,
    equal keys are entries of their own.
    """
    placed = _placed(changes)
    stretches = placed.select("side", "stretch").distinct()
    schema = "side string, stretch long, seq long, key string"
    if stretches.agg(F.max("stretch")).first()[0] == 0:
        return placed.withColumn("stretch_row", F.lit(1)).groupBy("side", "stretch").applyInPandas(_replay(cap, repeats), schema).drop("stretch")
    before = stretches.select("side", "stretch", F.lag("stretch").over(Window.partitionBy("side").orderBy("stretch")).alias("_before"))
    before = scratch_table(before.filter("_before is not null"))  # a row for each REPLAY changes
    rows = placed.withColumn("stretch_row", F.lit(1))
    single = before.isEmpty()
    state, mark = None, None
    while True:
        start = rows
        if state is not None:
            held = state.withColumnRenamed("stretch", "_before").join(before, ["side", "_before"]).select("side", "stretch", "seq", "key", F.lit("add").alias("change"), F.lit(0).alias("stretch_row"))
            start = rows.unionByName(held)
        state = scratch_table(start.groupBy("side", "stretch").applyInPandas(_replay(cap, repeats), schema))
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("side", "stretch", "seq", "key").cast("decimal(38,0)"))).first())
        if now == mark or single:
            break
        mark = now
    return state.join(stretches.groupBy("side").agg(F.max("stretch").alias("stretch")), ["side", "stretch"]).select("side", "seq", "key")
