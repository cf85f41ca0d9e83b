"""Scans batch by batch: quiet ones, what they leave, tables that are asked by key, requests and progress."""

import random
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from commentscan.config import ScanConfig
from commentscan.functions import capped
from commentscan.operators import state as M
from commentscan.plans import moderation_queries
from commentscan.plans.scan_queries import phrase_row
from commentscan.sources import keyed
from commentscan.streaming import scan_stream as R

SF = "/root/testdata/sf0.001"
SCHEMA = "comment_id string, text string, source_url string"


def scan(spark, out, batch, rows, hate=(), **more):
    df = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)
    return R.scan_batch(df, batch, out, lambda: phrase_row(spark, hate, ()), ScanConfig(), **more)


@pytest.mark.parametrize("size", [None, 2])
def test_quiet_batches(spark, tmp_path, size):
    """Without flags, without comments, with known flags only; each has statistics."""
    out = str(tmp_path)
    none = dict.fromkeys(R.COUNTS, 0)
    assert scan(spark, out, 0, [("1", "hello"), ("2", None), (None, "blue")], size=size) == none | {"total": 3}
    assert scan(spark, out, 1, [], size=size) == none
    assert R.last_comments(spark, out).count() == 0
    assert scan(spark, out, 2, [("3", "go die")], size=size) == none | {"total": 1, "flagged": 1, "new_flags": 1}
    assert scan(spark, out, 3, [("4", "go die"), ("5", "go die")], size=size) == none | {"total": 2, "flagged": 2}
    assert scan(spark, out, 2, [("3", "go die")], size=size)["new_flags"] == 1  # runs again
    quiet = spark.createDataFrame([("1", "x", None)], SCHEMA)
    quiet.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{out}/in")
    R.start_scan(stream, f"{out}/stream", f"{out}/state", lambda: phrase_row(spark, (), ()), once=True, size=size).awaitTermination()
    assert [r["total"] for r in R.scan_history(spark, f"{out}/stream").collect()] == [1]


def test_last_comments_are_the_last_to_arrive(spark, tmp_path):
    out = str(tmp_path)
    rows = [(str(k), f"t{k}") for k in range(1200)]
    df = spark.createDataFrame([(i, t, None, int(i)) for i, t in rows], f"{SCHEMA}, seq long").repartition(5)
    R.scan_batch(df, 0, out, lambda: phrase_row(spark, (), ()), ScanConfig())
    assert [r["comment_id"] for r in R.last_comments(spark, out).collect()] == [i for i, _ in rows[-500:]]
    scan(spark, out, 1, [("z", "a"), ("b", "c"), ("a", "d")])  # in the order of the batch
    assert [r["comment_id"] for r in R.last_comments(spark, out).collect()] == ["z", "b", "a"]


def test_parts_of_a_batch_follow_each_other(spark, tmp_path):
    """A text that an earlier part flagged is known to a later one; repeats within a part are kept."""
    out = str(tmp_path)
    rows = [("1", "go die"), ("2", "go die"), ("3", "go die"), ("4", "hi"), ("5", "fuck you")]
    assert scan(spark, out, 0, rows, size=2)["new_flags"] == 3
    found = [(r["part"], r["total"], r["flagged"], r["new_flags"]) for r in R.scan_history(spark, out).orderBy("batch_id", "part").collect()]
    assert found == [(0, 2, 2, 2), (1, 2, 1, 0), (2, 1, 1, 1)]
    assert [r["comment_id"] for r in R.last_comments(spark, out).collect()] == ["5"]


def test_files_are_scanned_in_the_order_of_arrival(spark, tmp_path):
    out, order = str(tmp_path / "out"), [3, 1, 2]
    for k in order:
        spark.createDataFrame([(f"{k}", "go die" if k != 2 else "hi", None)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    R.start_ordered_scan(spark, str(tmp_path / "in"), SCHEMA, out, str(tmp_path / "state"), lambda: phrase_row(spark, (), ())).awaitTermination()
    rows = R.scan_history(spark, out).orderBy("batch_id").collect()
    assert [(r["total"], r["flagged"], r["new_flags"]) for r in rows] == [(1, 1, 1), (1, 1, 0), (1, 0, 0)]
    assert [r["comment_id"] for r in R.last_comments(spark, out).collect()] == ["2"]
    assert rows == sorted(rows, key=lambda r: r["ts"])


def test_no_task_gets_a_whole_load(spark, tmp_path, monkeypatch):
    """Loads are written and numbered in parts; scans still follow each other in the order of seq."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    numbered, seen, files = R._numbered, [], []

    def watched(rows, size, path):
        files.append(len(rows.inputFiles()))
        done = numbered(rows, size, path)
        seen.append([r["n"] for r in done.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return done

    monkeypatch.setattr(R, "_numbered", watched)
    monkeypatch.setattr(moderation_queries, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    rows = moderation_queries.ordered_scan(spark, str(tmp_path)).collect()
    n = docs.count()
    assert sum(r["total"] for r in rows) == n and {r["batch_id"] for r in rows} == {0, 1, 2}
    assert all(r["total"] == 50 for r in rows if (r["batch_id"], r["part"] + 1) in {(q["batch_id"], q["part"]) for q in rows})
    assert len(seen) == 3 and all(max(parts) < 0.6 * sum(parts) for parts in seen) and min(files) > 1


def test_parts_follow_seq_across_ranges(spark, tmp_path):
    rows = spark.createDataFrame([(k * 7919 % 1009, f"{k}") for k in range(1009)], "seq long, text string").repartition(3)
    assert all(r["part"] == r["seq"] // 10 for r in R._numbered(rows, 10, f"{tmp_path}/ranges").collect())
    assert R._numbered(rows.limit(0), 10, f"{tmp_path}/none").count() == 0


def test_requests_are_made_once(spark, tmp_path):
    """What asks for requests may be dear, and is not asked again to look them up and to write them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def asked(n):
        made.add(1)
        return f"c{n}"

    requests = spark.range(20).select(asked("id").alias("comment_id"), F.lit("hide").alias("action"), F.lit(1).alias("epoch"), F.lit("t").alias("text"))
    assert R.emit_requests(requests, 0, str(tmp_path)).count() == 20 and made.value == 20
    assert R.emit_requests(requests, 1, str(tmp_path)).count() == 0 and made.value == 40


def test_history_keeps_the_last_scans(spark, tmp_path):
    out = str(tmp_path)
    for k in range(3):
        scan(spark, out, k, [(str(k), "kill")] * (k + 1), at=datetime(2024, 1, 1 + k, tzinfo=UTC))
    history = R.scan_history(spark, out, 2).orderBy("batch_id").collect()
    assert [(r["ts"].day, r["total"], r["new_flags"]) for r in history] == [(2, 2, 0), (3, 3, 0)]
    assert M.total_processed(R.scan_history(spark, out, None)).first()[0] == 6


def test_progress(spark, tmp_path):
    """A row as it starts, one for each batch with comments, one as it ends; an empty folder has the first and the last."""
    for name, files in (("none", 0), ("two", 2)):
        folder, out = tmp_path / name, str(tmp_path / f"out-{name}")
        folder.mkdir()
        for k in range(files):
            spark.createDataFrame([(f"{k}{n}", "hi", None) for n in range(k + 2)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        progress = R.ScanProgress(spark, out)
        R.start_scan(stream, out, f"{out}-state", lambda: phrase_row(spark, (), ()), once=True, progress=progress).awaitTermination()
        progress.wait()
        rows = [(r["done"], r["total"], r["message"]) for r in R.scan_progress(spark, out).orderBy("ts").collect()]
        sent = [(2, 2, "Classified 2/2"), (5, 5, "Classified 5/5")]
        assert sorted(rows) == sorted([(0, 0, "Starting scan"), *sent[:files], (5 if files else 0, 5 if files else 0, "Done")])


@pytest.mark.parametrize("newest", [True, False])
def test_keyed_table_equals_a_dictionary(spark, tmp_path, monkeypatch, newest):
    """Over many batches, some of which run again, and merges on three levels."""
    monkeypatch.setattr(keyed, "FAN", 3)
    table = keyed.KeyedTable(spark, str(tmp_path), "key string, value long", newest)
    rng, want = random.Random(1), {}
    for batch in range(20):
        rows = [] if batch == 4 else [(f"k{rng.randrange(30)}", 100 * batch + n) for n in range(rng.randrange(1, 5))]
        rows = list(dict(rows).items()) if newest else rows + rows[:1]
        df = spark.createDataFrame(rows, "key string, value long")
        if batch % 5 == 3:
            table.append(df.limit(1), batch)  # before a failure
        table.append(df, batch)
        for k, v in rows:
            want[k] = {v} if newest else want.get(k, set()) | {v}
        if batch in (0, 7, 19):
            got = {}
            for r in table.all().collect():
                got.setdefault(r["key"], set()).add(r["value"])
            assert got == want
            asked = spark.createDataFrame([(f"k{n}",) for n in range(0, 40, 7)] + [(None,)], "key string")
            found = {(r["key"], r["value"]) for r in table.lookup(asked).collect()}
            assert found == {(k, v) for k, held in want.items() for v in held if int(k[1:]) % 7 == 0}
    assert table.lookup(asked.limit(0)).count() == 0 and table.opened == 0


def test_a_lookup_opens_few_folders_after_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FAN", 4)
    table = keyed.KeyedTable(spark, str(tmp_path), "key string, value long")
    opened = {}
    for batch in range(21):
        table.append(spark.createDataFrame([(f"{batch}-{n}", n) for n in range(40)], "key string, value long"), batch)
        if batch + 1 in (1, 5, 21):
            found = table.lookup(spark.createDataFrame([("0-7",), ("never",)], "key string")).collect()
            opened[batch + 1] = table.opened
            assert [(r["key"], r["value"]) for r in found] == [("0-7", 7)]
            assert len(table.segments()) <= 2 * 3 + 1
    assert max(opened.values()) <= 2


def test_requests_are_emitted_once(spark, tmp_path):
    out = str(tmp_path)
    ask = lambda *rows: spark.createDataFrame(rows, R.REQUESTS)
    emit = lambda batch, *rows: sorted((tuple(r)[:3] for r in R.emit_requests(ask(*rows), batch, out).collect()), key=repr)
    assert emit(0, ("a", "hide", 1, "x"), ("a", "hide", 1, "x"), ("b", "hide", 2, None)) == [("a", "hide", 1), ("b", "hide", 2)]
    again = (("a", "hide", 1, "x"), ("a", "delete", 1, "x"), ("a", "hide", 5, "x"), (None, "hide", 1, "x"))
    assert emit(1, *again) == emit(1, *again)
    assert emit(2, *again) == []
    assert R.read_table(spark, f"{out}/requests", R.REQUESTS).count() == 5


def test_labels_answer_one_occurrence_each(spark, monkeypatch):
    def queue(enqueued, labels, cap=None):
        e, x = (spark.createDataFrame(rows, "seq long, text string") for rows in (enqueued, labels))
        return [(r["seq"], r["text"]) for r in M.training_queue(e, x, cap).collect()]

    assert queue([(1, "a"), (2, "b"), (5, "a")], [(3, "a")]) == [(2, "b"), (5, "a")]
    assert queue([(1, "a"), (2, "a")], [(3, "a")]) == [(2, "a")]
    assert queue([(4, "a"), (5, None)], [(3, "a"), (6, None)]) == [(4, "a"), (5, None)]
    assert queue([(1, "a\x01"), (2, "c")], [(3, "a "), (4, "a "), (5, "z")], 5) == [(2, "c")]
    rng = random.Random(3)
    for cap in (None, None, 3, 7, 7):
        events = [(k, rng.choice("abc"), rng.random() < 0.6) for k in range(60)]
        waiting = []
        for k, t, enters in events:
            mine = [w for w in waiting if w[1] == t]
            if enters:
                waiting = [*waiting, (k, t)][-(cap or 99) :]
            elif mine:
                waiting.remove(mine[0])
        for replay in (50_000, 9):
            monkeypatch.setattr(capped, "REPLAY", replay)
            assert queue([e[:2] for e in events if e[2]], [e[:2] for e in events if not e[2]], cap) == waiting
