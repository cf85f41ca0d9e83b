"""The moderation log with states in a state store.

Items are dealt to shards, and a shard's key in the store holds a map of its items, the last clear of each table and its
counters. A clear is global, so each goes to every shard, where it is one number that items are compared with
when they are next touched, or read; no clear visits the items. Nothing but the store holds states: the checkpoint keeps it, a
stream that starts again goes on from there, and results are read out of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from commentscan.functions import text as T
from commentscan.operators import state as M

#: Shards of a log, fixed for the life of a checkpoint; a clear is copied to each.
SHARDS = 64
CODES = (*M.MOVES, "clear_flagged", "clear_hidden", "report", "label_hate", "label_safe")
COUNTERS = ("hidden", "deleted", "false_positives", "safe", "reported", "trained_hate", "trained_safe")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_CODE = {name: k for k, name in enumerate(CODES)}
#: _NEXT[move][state] is the state after it.
_NEXT = np.tile(np.arange(3, dtype=np.int8), (len(M.MOVES), 1))
_NEXT[_CODE["flag"], M.NONE] = M.FLAGGED
_NEXT[_CODE["hide"], M.FLAGGED] = M.HIDDEN
_NEXT[_CODE["unhide"], M.HIDDEN] = M.FLAGGED
_NEXT[_CODE["delete"]] = M.NONE
_NEXT[_CODE["correct"], M.FLAGGED] = M.NONE


def last_before(clears: np.ndarray, earlier: int, seq: np.ndarray) -> np.ndarray:
    """For each seq the last of the sorted clears before it, or the one of earlier batches."""
    return np.r_[earlier, clears][np.searchsorted(clears, seq, "left")]


def fold(item: np.ndarray, seq: np.ndarray, move: np.ndarray, start: np.ndarray, at: np.ndarray, flagged: np.ndarray, hidden: np.ndarray):
    """Moves ordered by (item, seq), and for each the last clear of either table before it: (now, then) of each.

    now is an item's state just before the move, after clears, and then the one after it; start and at say, by item, where items
    were and since when. Each move maps three states to three. These maps are composed along each item's log by doubling,
    so a log of n moves takes log n passes over arrays, whether one item has them all or each its own.
    """
    n, rows = len(item), np.arange(len(item))
    head = np.r_[True, item[1:] != item[:-1]]
    before = np.where(head, at[item], np.r_[0, seq[:-1]])
    clear = np.tile(np.arange(3, dtype=np.int8), (n, 1))
    clear[flagged > before, M.FLAGGED] = M.NONE
    clear[hidden > before, M.HIDDEN] = M.NONE
    maps = np.take_along_axis(_NEXT[move], clear.astype(np.int64), 1)
    place = rows - np.maximum.accumulate(np.where(head, rows, 0))
    step, longest = 1, place.max(initial=0)
    while step <= longest:
        late = np.flatnonzero(place >= step)
        maps[late] = np.take_along_axis(maps[late], maps[late - step].astype(np.int64), 1)
        step *= 2
    then = maps[rows, start[item]]
    was = np.where(head, start[item], np.r_[np.int8(0), then[:-1]])
    return clear[rows, was], then


class Shard(StatefulProcessor):
    """Folds a batch's rows of a shard onto the items that they touch; emits those items."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item_id string", "state int, since long, at long")
        self.clears = handle.getValueState("clears", "cleared_flagged long, cleared_hidden long")
        self.counters = handle.getValueState("counters", ", ".join(f"{n} long" for n in COUNTERS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        log = pd.concat([r[["seq", "item_id", "code", "says"]] for r in rows], ignore_index=True).sort_values("seq", kind="stable")
        seq, code, says = log["seq"].to_numpy(np.int64), log["code"].to_numpy(np.int64), log["says"].to_numpy(bool)
        cleared = self.clears.get() if self.clears.exists() else (-1, -1)
        clears = [seq[code == _CODE[name]] for name in ("clear_flagged", "clear_hidden")]
        if any(map(len, clears)):
            self.clears.update(tuple(int(max([old, *new[-1:]])) for old, new in zip(cleared, clears, strict=True)))
        counts = dict(zip(COUNTERS, self.counters.get() if self.counters.exists() else (0,) * len(COUNTERS), strict=True))
        for name, label in (("reported", "report"), ("trained_hate", "label_hate"), ("trained_safe", "label_safe")):
            counts[name] += int(((code == _CODE[label]) & (says | (label == "report"))).sum())

        moves = np.flatnonzero((code < len(M.MOVES)) & log["item_id"].notna().to_numpy())
        item, names = pd.factorize(log["item_id"].to_numpy()[moves])
        moves, item = (x[np.argsort(item, kind="stable")] for x in (moves, item))  # by item, then seq
        old = [self.items.getValue((name,)) or (M.NONE, None, -1) for name in names]
        start, at = np.array([o[0] for o in old], np.int8), np.array([o[2] for o in old], np.int64)
        s, c = seq[moves], code[moves]
        now, then = fold(item, s, c, start, at, *(last_before(new, was, s) for new, was in zip(clears, cleared, strict=True)))
        corrected = (c == _CODE["correct"]) & (now == M.FLAGGED)
        counts["hidden"] += int(((c == _CODE["hide"]) & (now == M.FLAGGED)).sum())
        counts["deleted"] += int(((c == _CODE["delete"]) & (now != M.NONE)).sum())
        counts["false_positives"] += int(corrected.sum())
        counts["safe"] += int((corrected & says[moves]).sum())
        self.counters.update(tuple(counts[n] for n in COUNTERS))

        last = np.flatnonzero(np.r_[item[1:] != item[:-1], True]) if len(item) else item
        entered = pd.Series(np.where(now != then, np.arange(len(item)), -1)).groupby(item).max().to_numpy()
        states = []
        for k, end in enumerate(last):
            since = int(s[entered[k]]) if entered[k] >= 0 else old[k][1]
            states.append((names[k], int(then[end]), since if then[end] != M.NONE else None, int(s[end])))
            self.items.updateValue((names[k],), states[-1][1:])
        yield pd.DataFrame(states, columns=["item_id", "state", "since", "at"]).astype({"since": "Int64"})

    def close(self) -> None:
        pass


def start_keyed_moderation(actions: DataFrame, checkpoint: str, once: bool = False, sink=None, shards: int = SHARDS):
    """Keep the states of items in the store under `checkpoint`, over a stream of actions (seq, item_id, action, perhaps text).

    Each seq stands once, and seqs rise from batch to batch; within one they come in any order. Rows without a seq, moves without
    an item and other actions count for nothing. sink(changes, batch_id) is given the items that a batch touched: item_id, state,
    since, at. A task holds a shard's rows of one batch, whose size the source's limits set.
    """
    spark = actions.sparkSession
    says = F.coalesce(T.trim_all(F.col("text")) != "", F.lit(False)) if "text" in actions.columns else F.lit(True)
    code = F.array_position(F.array(*map(F.lit, CODES)), F.col("action")).cast("int") - 1
    rows = actions.select(F.col("seq").cast("long").alias("seq"), F.col("item_id").cast("string").alias("item_id"), code.alias("code"), says.alias("says"))
    rows = rows.filter("seq is not null and code >= 0")
    mine = F.array(F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int"))
    clear = F.col("code").isin(_CODE["clear_flagged"], _CODE["clear_hidden"])
    dealt = rows.select("*", F.explode(F.when(clear, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(mine)).alias("shard"))
    states = dealt.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=Shard(), outputStructType="item_id string, state int, since long, at long", outputMode="Update", timeMode="None"
    )
    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(sink) if sink else writer.format("noop")
    writer = writer.trigger(**({"availableNow": True} if once else {"processingTime": "1 minute"}))
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, STORE)  # a stream takes the setting over as it starts
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def _stored(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def stored_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(item_id, state, since) out of the store, as of its last batch."""
    clears = _stored(spark, checkpoint, "clears").agg(*(F.coalesce(F.max(f"value.{n}"), F.lit(-1)).alias(n) for n in ("cleared_flagged", "cleared_hidden")))
    items = _stored(spark, checkpoint, "items").select(F.col("user_map_key.item_id").alias("item_id"), "user_map_value.*")
    return M.named_states(items, clears)


def stored_metrics(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row: how often each counted action was taken, out of the store; as action_metrics has them."""
    counts = _stored(spark, checkpoint, "counters").agg(*(F.coalesce(F.sum(f"value.{n}"), F.lit(0)).alias(n) for n in COUNTERS))
    return counts.select("false_positives", "hidden", "deleted", "reported", "trained_hate", (F.col("trained_safe") + F.col("safe")).alias("trained_safe"))
