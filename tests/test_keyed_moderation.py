"""Moderation with states in the store: against the batch fold, over any split of the log and over restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from commentscan.operators import state as M
from commentscan.streaming import keyed_moderation as K
from commentscan.streaming import scan_stream as R

SCHEMA = "seq long, item_id string, action string, text string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.02)  # files are taken by age


def run(spark, folder, checkpoint, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    K.start_keyed_moderation(stream, checkpoint, once=True, **more).awaitTermination()


def equal(spark, folder, checkpoint):
    log = spark.read.schema(SCHEMA).parquet(folder)
    assert sorted(map(tuple, K.stored_states(spark, checkpoint).collect())) == sorted(map(tuple, M.moderation_state(log).collect()))
    assert K.stored_metrics(spark, checkpoint).first() == M.action_metrics(log).first()


def some_log(seed, n, items):
    rng, kinds = random.Random(seed), [*M.ACTIONS, "flag", "flag", "hide", "hide", "unhide", "other"]
    rows = []
    for k in range(n):
        action = rng.choice(kinds)
        if action.startswith("clear") and rng.random() < 0.7:
            action = "flag"
        item = None if action.startswith("clear") or rng.random() < 0.05 else f"i{min(rng.randrange(items), rng.randrange(items))}"
        rows.append((3 * k, item, action, rng.choice([None, " ", "x"])))
    return rows


@pytest.mark.parametrize(("seed", "cuts"), [(1, (0, 1, 40, 200)), (2, (150,))])
def test_store_equals_the_batch_fold_over_restarts(spark, tmp_path, seed, cuts):
    folder, checkpoint, rows = str(tmp_path / "in"), str(tmp_path / "state"), some_log(seed, 300, 9)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for low, high in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        part = rows[low:high]
        random.Random(0).shuffle(part)  # any order within a batch
        put(spark, folder, part)
        if high != 40:  # so two batches run in one go once
            run(spark, folder, checkpoint, shards=4)
    equal(spark, folder, checkpoint)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_a_clear_reaches_items_that_are_not_touched_again(spark, tmp_path):
    folder, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    sink = lambda df, batch: seen.append(sorted((r["item_id"], r["state"], r["since"]) for r in df.collect()))
    put(spark, folder, [(1, "a", "flag", None), (2, "b", "flag", None), (3, "b", "hide", None), (None, "c", "flag", None)])
    put(spark, folder, [(5, None, "clear_flagged", None)])
    put(spark, folder, [(6, "b", "unhide", None), (7, None, "flag", None)])
    run(spark, folder, checkpoint, sink=sink)
    assert seen == [[("a", 1, 1), ("b", 2, 3)], [], [("b", 1, 6)]]
    assert sorted(map(tuple, K.stored_states(spark, checkpoint).collect())) == [("a", "none", None), ("b", "flagged", 6)]


def test_one_item_with_a_long_log(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(k, "hot", ("flag", "hide", "unhide", "correct")[k * 7 % 4], "x") for k in range(20_000)]
    put(spark, folder, rows)
    run(spark, folder, checkpoint)
    equal(spark, folder, checkpoint)


def test_totals_follow_the_history(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts string, total string, flagged string"
    rows = [("1000", "5", "1"), ("bad", "7", "1"), ("3000", "-4", "0"), ("2000", "x", "2"), (None, None, None)]
    for k in range(0, len(rows), 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        R.start_totals(M.read_history(stream), out, f"{out}/_state", once=True).awaitTermination()
        history = M.read_history(spark.read.schema(schema).parquet(folder))
        got = R.latest_totals(spark, out)
        assert got.select("total_processed").collect() == M.total_processed(history).collect()
        assert got.select(*(F.col(f"latest.{n}").alias(n) for n in ("ts", "total", "flagged"))).collect() == M.latest_scan(history).collect()
    assert R.latest_totals(spark, str(tmp_path / "none")).count() == 0
