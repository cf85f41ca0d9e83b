"""The moderation log against a plain fold, capped tables and streams."""

import random

import pytest

from commentscan.functions import capped
from commentscan.functions import lexicon as L
from commentscan.operators import state as M
from commentscan.plans.scan_queries import phrase_row
from commentscan.sources.logs import CappedLog
from commentscan.sources import keyed
from commentscan.streaming import scan_stream as R


def plain_fold(log):
    state, since = {}, {}
    moves = {("flag", 0): 1, ("hide", 1): 2, ("unhide", 2): 1, ("delete", 1): 0, ("delete", 2): 0, ("correct", 1): 0}
    for seq, item, action in sorted(log):
        if action.startswith("clear"):
            for i in state:
                if state[i] == (1 if action == "clear_flagged" else 2):
                    state[i] = 0
            continue
        if item is None:
            continue
        if action in ("flag", "hide", "unhide", "delete", "correct"):
            old = state.setdefault(item, 0)
            new = moves.get((action, old), old)
            if new != old:
                state[item], since[item] = new, seq
    names = ("none", "flagged", "hidden")
    return {i: (names[s], since[i] if s else None) for i, s in state.items()}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_moderation_state(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    rng = random.Random(1)
    names = ["flag", "hide", "unhide", "delete", "correct", "report"] * 4 + ["clear_flagged", "clear_hidden"]
    log = [(k, f"i{rng.randrange(6)}", rng.choice(names)) for k in range(300)]
    log = [(k, None if a.startswith("clear") else i, a) for k, i, a in log]
    done = M.moderation_state(spark.createDataFrame(log, "seq long, item_id string, action string"))
    assert {r["item_id"]: (r["state"], r["since"]) for r in done.collect()} == plain_fold(log)


@pytest.mark.parametrize("chunk", [4, 1000])
def test_sparse_log_with_thousands_of_clears(spark, monkeypatch, chunk):
    """One item acts once in a long while, others often; no group holds more than CHUNK rows or BUCKET seqs."""
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "BUCKET", 50)
    rng = random.Random(5)
    log = []
    for k in range(0, 60_000, 7):
        draw = rng.random()
        if draw < 0.25:
            log.append((k, None, rng.choice(["clear_flagged", "clear_hidden"])))
        elif draw < 0.35:
            log.append((k, "rare" if k % 3 else "other", rng.choice(["flag", "flag", "hide", "hide", "unhide", "delete"])))
    log.append((60_001, "last", "flag"))
    done = M.moderation_state(spark.createDataFrame(log, "seq long, item_id string, action string"))
    assert {r["item_id"]: (r["state"], r["since"]) for r in done.collect()} == plain_fold(log)


def test_metrics_count_what_changed_something(spark):
    log = [(k, "i", a, "x") for k, a in enumerate(["hide", "correct", "flag", "hide"])] + [(9, "j", "flag", " "), (10, "j", "correct", " "), (11, None, "label_hate", " "), (12, None, "label_safe", "t"), (13, "i", "delete", "x"), (14, "i", "delete", "x")]
    row = M.action_metrics(spark.createDataFrame(log, "seq long, item_id string, action string, text string")).first().asDict()
    assert row == {"false_positives": 1, "hidden": 1, "deleted": 1, "reported": 0, "trained_hate": 0, "trained_safe": 1}
    assert M.action_metrics(spark.createDataFrame([], "seq long, item_id string, action string, text string")).first()["hidden"] == 0


@pytest.mark.parametrize("replay", [3, 50_000])
def test_capped_tables_replay_their_log(spark, monkeypatch, replay):
    monkeypatch.setattr(capped, "REPLAY", replay)
    rng = random.Random(6)
    log = [(k, rng.choice("ab"), f"k{rng.randrange(8)}", rng.choice(["add"] * 8 + ["remove", "clear"])) for k in range(160)]
    want = set()
    for side in "ab":
        held = {}
        for k, s, key, change in log:
            if s != side:
                continue
            if change == "add" and key not in held:
                held[key] = k
                while len(held) > 4:
                    held.pop(next(iter(held)))
            elif change == "remove":
                held.pop(key, None)
            elif change == "clear":
                held = {}
        want |= {(side, k, key) for key, k in held.items()}
    got = capped.capped_adds(spark.createDataFrame(log, "seq long, side string, key string, change string"), 4)
    assert {tuple(r) for r in got.collect()} == want


def test_evicted_urls_come_back_at_the_end(spark):
    log = [(k, f"u{k}", "add") for k in range(1, 102)] + [(200, "u1", "add")]
    held = {r["url"] for r in M.maintain_urls(spark.createDataFrame(log, "seq long, url string, change string")).collect()}
    assert "u1" in held and "u2" not in held and len(held) == 100


def test_queue_caps_before_labels(spark):
    rows = spark.createDataFrame([(k, f"t\x01{k}") for k in range(1, 7)], "seq long, text string")
    labels = spark.createDataFrame([(7, "t 5"), (8, "t\x016"), (9, "t 1")], "seq long, text string")
    assert [r["seq"] for r in M.training_queue(rows, labels, 4).collect()] == [3, 4]


def test_last_comments_and_review(spark):
    rows = spark.createDataFrame([(scan, 10 * scan + k, f"c\x01{k}") for scan in (1, 2) for k in range(4)], "scan_id long, seq long, text string")
    last = M.last_comments(rows, cap=3)
    assert sorted((r["seq"], r["text"]) for r in last.collect()) == [(21, "c 1"), (22, "c 2"), (23, "c 3")]
    clears = spark.createDataFrame([(1,)], "scan_id long")
    assert M.last_comments(rows, clears).count() == 4
    assert M.last_comments(rows, clears.selectExpr("scan_id + 1 as scan_id")).count() == 0
    flagged = spark.createDataFrame([(5, "x", "u")], "seq long, text string, source_url string")
    assert [tuple(r) for r in M.review(flagged, last).collect()] == [(5, "x", "u")]
    assert {r["source_url"] for r in M.review(flagged, last, everything=True).collect()} == {None}


def test_capped_log(spark, tmp_path):
    log = CappedLog(spark, str(tmp_path / "log"), "seq long, text string", 3)
    assert log.read().count() == 0
    for batch in (0, 1, 1):
        log.append(spark.createDataFrame([(10 * batch + k, "t") for k in range(2)], "seq long, text string"), batch)
    assert {r["seq"] for r in log.read().collect()} == {1, 10, 11}
    small = log.compact(str(tmp_path / "small"))
    assert {r["seq"] for r in small.read().collect()} == {1, 10, 11} and small.all().count() == 3
    assert {r["seq"] for r in CappedLog(spark, log.path, log.schema, None).read().collect()} == {0, 1, 10, 11}


def test_empty_log(spark):
    assert M.moderation_state(spark.createDataFrame([], "seq long, item_id string, action string")).count() == 0


def test_caps_upserts_and_queue(spark):
    rows = spark.createDataFrame([(k, f"t{k % 3}", f"c{k}") for k in range(9)], "seq long, text string, comment_id string")
    assert {r["seq"] for r in M.keep_last(rows, 2).collect()} == {7, 8}
    assert {(r["text"], r["comment_id"]) for r in M.upsert_comment_ids(rows).collect()} == {("t0", "c6"), ("t1", "c7"), ("t2", "c8")}
    labels = spark.createDataFrame([(9, "t1")], "seq long, text string")
    assert [r["seq"] for r in M.training_queue(rows, labels, 4).collect()] == [5, 6, 8]
    asked = M.moderation_requests(rows.filter("seq = 1").unionByName(rows.filter("seq = 2")).select("text"), M.upsert_comment_ids(rows, 1), "hide")
    assert [tuple(r) for r in asked.collect()] == [("c8", "hide", "t2")]


def test_history_and_log_tail(spark):
    raw = spark.createDataFrame([("1000", "5", "2"), ("bad", "1", "1"), ("2000", "x", "3")], "ts string, total string, flagged string")
    read = M.read_history(raw)
    assert sorted((r["total"], r["flagged"]) for r in read.collect()) == [(0, 3), (5, 2)]
    assert tuple(M.latest_scan(read).first())[1:] == (0, 3) and M.total_processed(read).first()[0] == 5
    lines = ["1:scan: old", "2:x", "3:scan: a", "4:y", "5:provider: b", "6:z"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    assert {r["message"] for r in M.log_tail(df).collect()} == {"scan: a", "provider: b"}


def test_urls(spark):
    log = [(1, " u1 ", "add"), (2, "u2", "add"), (3, "u1", "add"), (4, "u2", "remove"), (5, " ", "add"), (6, "u3", "add")]
    df = spark.createDataFrame(log, "seq long, url string, change string")
    assert {(r["url"], r["seq"]) for r in M.maintain_urls(df).collect()} == {("u1", 1), ("u3", 6)}
    assert {r["url"] for r in M.maintain_urls(df, 1).collect()} == {"u3"}
    cleared = df.union(spark.createDataFrame([(5, None, "clear")], df.schema))
    assert {r["url"] for r in M.maintain_urls(cleared).collect()} == {"u3"}


def test_correction_feeds_the_lexicon(spark):
    log = spark.createDataFrame([(1, "i", "flag", "Bad Day"), (2, "i", "correct", "Bad Day")], "seq long, item_id string, action string, text string")
    assert [(r["polarity"], r["phrase"]) for r in L.build_lexicon(M.corrections_as_labels(log)).collect()] == [("safe", "bad day")]
    assert M.action_metrics(log).first()["false_positives"] == 1


def test_stream_scan_is_idempotent(spark, tmp_path):
    for k, texts in enumerate((["fuck you", "hi"], ["fuck you", "go die"])):
        spark.createDataFrame([(f"{k}{n}", t, None) for n, t in enumerate(texts)], "comment_id string, text string, source_url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("comment_id string, text string, source_url string").parquet(str(tmp_path / "in"))
        R.start_scan(stream, str(tmp_path / "out"), str(tmp_path / "state"), lambda: phrase_row(spark, (), ()), once=True).awaitTermination()
    flagged = R.read_table(spark, str(tmp_path / "out/flagged"), R.FLAGGED)
    assert sorted(r["text"] for r in flagged.collect()) == ["fuck you", "go die"]
    batch = spark.createDataFrame([("12", "fuck you", None), ("13", "go die", None)], "comment_id string, text string, source_url string")
    R.scan_batch(batch, 1, str(tmp_path / "out"), lambda: phrase_row(spark, (), ()), R.ScanConfig())  # the second batch again
    assert R.read_table(spark, str(tmp_path / "out/flagged"), R.FLAGGED).count() == 2


@pytest.mark.parametrize("fan", [2, 10])
def test_stream_state_equals_the_fold_of_the_whole_log(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(keyed, "FAN", fan)
    rng = random.Random(7)
    names = ["flag", "flag", "hide", "unhide", "delete", "correct"] * 3 + ["clear_flagged", "clear_hidden"]
    log = [(k, f"i{rng.randrange(9)}", rng.choice(names)) for k in range(120)]
    log = [(k, None if a.startswith("clear") else i, a) for k, i, a in log]
    for batch, at in enumerate(range(0, 120, 24)):
        df = spark.createDataFrame(log[at : at + 24], "seq long, item_id string, action string")
        R.moderate_batch(df, batch, str(tmp_path))
        if batch == 2:
            R.moderate_batch(df, batch, str(tmp_path))  # runs again after a failure
    assert {r["item_id"]: (r["state"], r["since"]) for r in R.latest_state(spark, str(tmp_path)).collect()} == plain_fold(log)


def test_scans_read_the_lexicon_and_the_states_afresh(spark, tmp_path):
    out = str(tmp_path)
    batch = lambda *rows: spark.createDataFrame([(i, t, None) for i, t in rows], "comment_id string, text string, source_url string")
    lexicon = lambda *hate: lambda: phrase_row(spark, hate, ())
    assert R.scan_batch(batch(("1", "go die"), ("2", "blue")), 0, out, lexicon(), R.ScanConfig()) == {"total": 2, "flagged": 1, "asked": 0, "errors": 0, "new_flags": 1}
    assert R.scan_batch(batch(("3", "go die"), ("4", "blue")), 1, out, lexicon("blue"), R.ScanConfig())["new_flags"] == 1  # the phrase is new, "go die" is known
    actions = [(1, "1", "flag"), (2, "4", "flag"), (3, "4", "hide"), (4, "1", "delete")]
    R.moderate_batch(spark.createDataFrame(actions, "seq long, item_id string, action string"), 0, out)
    again = R.scan_batch(batch(("5", "go die"), ("6", "blue")), 2, out, lexicon("blue"), R.ScanConfig())
    assert (again["flagged"], again["new_flags"]) == (2, 1)  # deleted, so flagged again; hidden, so known
    assert {r["comment_id"] for r in R.last_comments(spark, out).collect()} == {"5", "6"}
