"""The moderation log, capped tables, history and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentscan.config import CAPS, ScanConfig
from commentscan.functions import lexicon as L
from commentscan.functions import text as T
from commentscan.operators import scan as S
from commentscan.operators import state as M
from commentscan.operators.scan import keyword_opinion
from commentscan.plans.scan_queries import DECIDED, KNOWN, LABELLED, OPINED, decided, documents, known_tables, labelled, phrase_row
from commentscan.sources import comments as C
from commentscan.sources.logs import CappedLog
from commentscan.sources.scratch import scratch, scratch_table
from commentscan.sources.tables import table
from commentscan.streaming import keyed_moderation as K
from commentscan.streaming import scan_stream as R

MAPPED = {"view": "flag", "click": "hide", "purchase": "unhide", "error": "delete", "signup": "report"}


def actions(spark, sf_dir):
    """The events as an action log: users are items, event types actions."""
    names = F.create_map(*(F.lit(x) for pair in MAPPED.items() for x in pair))
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("item_id"), names[F.col("event_type")].alias("action"), F.col("user_id").cast("string").alias("text"))


def settled(state):
    """-1 for no seq: results without nulls in whole numbers compare alike everywhere."""
    return state.withColumn("since", F.coalesce("since", F.lit(-1).cast("long")))


def moderation_state(spark, sf_dir):
    return settled(M.moderation_state(actions(spark, sf_dir)))


#: A state is coded as kind * 10^12 + seq; list_reduce wants one type for all.
FOLDED = """SELECT user_id, list_reduce(list_prepend(0::BIGINT, list(code * 1000000000000 + event_id ORDER BY event_id)), lambda acc, x:
    CASE WHEN x // 1000000000000 = 1 AND acc // 1000000000000 = 0 THEN 1000000000000 + x % 1000000000000
         WHEN x // 1000000000000 = 2 AND acc // 1000000000000 = 1 THEN 2000000000000 + x % 1000000000000
         WHEN x // 1000000000000 = 3 AND acc // 1000000000000 = 2 THEN 1000000000000 + x % 1000000000000
         WHEN x // 1000000000000 = 4 AND acc // 1000000000000 <> 0 THEN x % 1000000000000
         ELSE acc END) AS acc
  FROM (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END::BIGINT AS code FROM events)
  WHERE code IS NOT NULL GROUP BY user_id"""
STATE = f"""SELECT user_id::VARCHAR AS item_id, CASE acc // 1000000000000 WHEN 1 THEN 'flagged' WHEN 2 THEN 'hidden' ELSE 'none' END AS state,
  CASE WHEN acc >= 1000000000000 THEN acc % 1000000000000 ELSE -1 END AS since FROM ({FOLDED})"""


def full_actions(spark, sf_dir):
    """The events as a log with every action: errors delete or correct, sign-ups report or label, some events clear a table."""
    seq, kind = F.col("event_id"), F.col("event_type")
    action = F.when(seq % 97 == 0, "clear_flagged").when(seq % 101 == 0, "clear_hidden").when(kind == "view", "flag").when(kind == "click", "hide").when(kind == "purchase", "unhide")
    action = action.when(kind == "error", F.when(seq % 2 == 0, "delete").otherwise("correct"))
    action = action.when(kind == "signup", F.when(seq % 3 == 0, "report").when(seq % 3 == 1, "label_hate").otherwise("label_safe"))
    named = table(spark, sf_dir, "events").withColumn("action", action).withColumn("user", F.col("user_id").cast("string"))
    item = F.when(~F.col("action").startswith("clear"), F.col("user"))
    return named.select(seq.alias("seq"), item.alias("item_id"), "action", F.when(seq % 5 == 0, "  ").otherwise(F.col("user")).alias("text"))


def moderation_clears(spark, sf_dir):
    """The state of each item where corrections and global clears come in between."""
    return settled(M.moderation_state(full_actions(spark, sf_dir)))


def action_metrics(spark, sf_dir):
    """What the log did: moves count where they changed something."""
    return M.action_metrics(full_actions(spark, sf_dir))


#: One step at a time over each user's actions and all clears.
WALK = """WITH RECURSIVE acts AS (
  SELECT event_id AS seq, user_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'x' END AS says,
    CASE WHEN event_id % 97 = 0 THEN 'clear_flagged' WHEN event_id % 101 = 0 THEN 'clear_hidden' WHEN event_type = 'view' THEN 'flag' WHEN event_type = 'click' THEN 'hide'
         WHEN event_type = 'purchase' THEN 'unhide' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'delete' ELSE 'correct' END
         WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'label_hate' ELSE 'label_safe' END END AS action
  FROM events
), moves AS (
  SELECT seq, user_id, says, action FROM acts WHERE action IN ('flag', 'hide', 'unhide', 'delete', 'correct')
), users AS (
  SELECT DISTINCT user_id FROM moves
), steps AS (
  SELECT user_id, seq, says, action, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k
  FROM (SELECT user_id, seq, says, action FROM moves UNION ALL SELECT u.user_id, a.seq, a.says, a.action FROM users u CROSS JOIN acts a WHERE a.action LIKE 'clear%')
), fold AS (
  SELECT user_id, 0::BIGINT AS k, 'none' AS state, -1::BIGINT AS since, 0 AS hid, 0 AS del, 0 AS cor, 0 AS saf FROM users
  UNION ALL
  SELECT f.user_id, s.k,
    CASE WHEN s.action = 'flag' AND state = 'none' THEN 'flagged' WHEN s.action = 'hide' AND state = 'flagged' THEN 'hidden' WHEN s.action = 'unhide' AND state = 'hidden' THEN 'flagged'
         WHEN s.action = 'delete' OR s.action = 'correct' AND state = 'flagged' OR s.action = 'clear_flagged' AND state = 'flagged' OR s.action = 'clear_hidden' AND state = 'hidden' THEN 'none'
         ELSE state END,
    CASE WHEN s.action = 'flag' AND state = 'none' OR s.action = 'hide' AND state = 'flagged' OR s.action = 'unhide' AND state = 'hidden' THEN s.seq ELSE since END,
    hid + (s.action = 'hide' AND state = 'flagged')::INT, del + (s.action = 'delete' AND state <> 'none')::INT, cor + (s.action = 'correct' AND state = 'flagged')::INT,
    saf + (s.action = 'correct' AND state = 'flagged' AND s.says <> '')::INT
  FROM fold f JOIN steps s ON s.user_id = f.user_id AND s.k = f.k + 1
), done AS (
  SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1
)"""
METRICS = """SELECT sum(cor)::BIGINT AS false_positives, sum(hid)::BIGINT AS hidden, sum(del)::BIGINT AS deleted, (SELECT count(*) FROM acts WHERE action = 'report') AS reported,
  (SELECT count(*) FROM acts WHERE action = 'label_hate' AND says <> '') AS trained_hate, (SELECT count(*) FROM acts WHERE action = 'label_safe' AND says <> '') + sum(saf)::BIGINT AS trained_safe FROM done"""


def flagged_log(spark, sf_dir):
    return decided(spark, sf_dir).filter("flagged").select("text", F.col("comment_id").alias("seq"))


def keep_last_flagged(spark, sf_dir):
    return M.keep_last(flagged_log(spark, sf_dir), CAPS["flagged"]).select("seq")


def keep_last_per_source(spark, sf_dir):
    return M.keep_last(documents(spark, sf_dir).withColumnRenamed("comment_id", "seq"), 5, by="source").select("source", "seq")


def new_flag_log(spark, sf_dir):
    """What a scan enqueues: flags that no table holds yet; and, after it, comments that someone flags by hand."""
    fresh = S.not_known(decided(spark, sf_dir).filter("flagged"), *known_tables(spark, sf_dir)).select("text", F.col("comment_id").alias("seq"))
    by_hand = documents(spark, sf_dir).filter("comment_id % 50 = 0").select("text", (F.col("comment_id") + 10**9).alias("seq"))
    return fresh.unionByName(by_hand)


def answers(spark, sf_dir):
    """Labels after the scan, some of them once more after the flags by hand."""
    once = labelled(spark, sf_dir).select((F.col("seq") + 5 * 10**8).alias("seq"), "text")
    return once.unionByName(once.filter("seq % 3 = 0").withColumn("seq", F.col("seq") + 2 * 10**9))


def training_queue(spark, sf_dir):
    """A queue of 30, without what is answered; what is flagged by hand after its label is asked again."""
    return M.training_queue(new_flag_log(spark, sf_dir), answers(spark, sf_dir), 30).select("seq", F.md5("text").alias("text_md5"))


ENQUEUED = f"""SELECT comment_id AS seq, text FROM ({DECIDED}) WHERE flagged AND text NOT IN ({KNOWN})
  UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 50 = 0"""
#: Event by event, texts being numbered: an entry goes to the end of the last thirty, a label takes the oldest of its text.
WAITING = f"""SELECT unnest(list_reduce(list_prepend([]::BIGINT[], list([id * 10000000000 + seq, enters] ORDER BY seq, enters)), lambda acc, x:
    CASE WHEN x[2] = 1 THEN list_concat(acc, [x[1]])[-30:]
         WHEN list_position(list_transform(acc, lambda e: e // 10000000000), x[1] // 10000000000) IS NULL THEN acc
         ELSE list_concat(acc[:list_position(list_transform(acc, lambda e: e // 10000000000), x[1] // 10000000000) - 1],
                          acc[list_position(list_transform(acc, lambda e: e // 10000000000), x[1] // 10000000000) + 1:]) END)) % 10000000000 AS seq
  FROM (SELECT dense_rank() OVER (ORDER BY text) AS id, seq, enters
        FROM (SELECT text, seq, 1 AS enters FROM ({ENQUEUED}) UNION ALL SELECT text, seq + 500000000, 0 FROM ({LABELLED})
              UNION ALL SELECT text, seq + 2500000000, 0 FROM ({LABELLED}) WHERE (seq + 500000000) % 3 = 0))"""


def scanned(spark, sf_dir):
    """The documents as scans of fifty."""
    numbered = documents(spark, sf_dir).select((F.col("comment_id") + 1).alias("seq"), "text")
    return C.scan_batches(numbered).withColumnRenamed("batch_id", "scan_id")


def last_comments(spark, sf_dir):
    """What the last scan leaves, and what is left of it once a person clears the table after it."""
    rows = scanned(spark, sf_dir)
    clears = spark.range(1).select(F.lit(-1).cast("long").alias("scan_id"))
    kept = M.last_comments(rows, clears, 20).withColumn("cleared", F.lit(False))
    gone = M.last_comments(rows, rows.select("scan_id"), 20).withColumn("cleared", F.lit(True))
    return kept.unionByName(gone).select("seq", "cleared", F.md5("text").alias("text_md5"))


def review_view(spark, sf_dir):
    """Both views of the review: flagged items with their source, and all of the last scan, without."""
    flagged = decided(spark, sf_dir).filter("flagged").select(F.col("comment_id").alias("seq"), "text", F.concat(F.lit("https://h/"), "source").alias("source_url"))
    views = [M.review(flagged, M.last_comments(scanned(spark, sf_dir)), everything).withColumn("everything", F.lit(everything)) for everything in (False, True)]
    return views[0].unionByName(views[1]).select("everything", "seq", "source_url", F.md5("text").alias("text_md5"))


def append_then_cap(spark, sf_dir):
    """Flags appended in three batches, one of them twice, to a table that holds 20; what it holds in the end."""
    log = CappedLog(spark, scratch(spark, "flagged-log"), "seq long, text string", 20)
    flags = flagged_log(spark, sf_dir).select("seq", "text")
    for batch in (0, 1, 2, 1):
        log.append(flags.filter(F.col("seq") % 3 == batch), batch)
    return log.compact(scratch(spark, "flagged-log")).read().select("seq", F.md5("text").alias("text_md5"))


def lexicon_capped(spark, sf_dir):
    """Users as phrases, labelled again and again, in a lexicon of twenty a side: who is pushed out comes back at the end."""
    label = F.when(F.col("event_type").isin("view", "click"), "hate").otherwise("safe")
    labels = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit(" User "), F.col("user_id")).alias("text"), label.alias("label"))
    return L.build_lexicon(labels, 20)


#: A list of entries (key * 10^9 + seq): an add of a key that is there changes nothing, else it goes to the end and the oldest leaves; a remove (10^18 more) takes it out.
FIFO = """list_reduce(list_prepend([]::BIGINT[], list([code] ORDER BY seq)), lambda acc, x:
    CASE WHEN x[1] >= 1000000000000000000 THEN list_filter(acc, lambda e: e // 1000000000 <> (x[1] - 1000000000000000000) // 1000000000)
         WHEN len(list_filter(acc, lambda e: e // 1000000000 = x[1] // 1000000000)) > 0 THEN acc
         ELSE list_concat(acc, x)[-{cap}:] END)"""


def id_map(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text", F.concat(F.lit("c"), F.col("doc_id")).alias("comment_id"), F.col("doc_id").alias("seq"))


def comment_id_upsert(spark, sf_dir):
    return M.upsert_comment_ids(id_map(spark, sf_dir)).select(F.md5("text").alias("text_md5"), "comment_id", "seq")


def moderation_requests(spark, sf_dir):
    """Hide requests for flagged documents, by the last comment id of their text."""
    ids = M.upsert_comment_ids(id_map(spark, sf_dir), None)
    return M.moderation_requests(flagged_log(spark, sf_dir), ids, "hide").select("comment_id", "action", F.md5("text").alias("text_md5"))


def millis(column):
    """Of a wall-clock time, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def history_rows(spark, sf_dir):
    """A scan per hour of events, as text; in some hours the count is broken, in some the time."""
    hour = F.date_trunc("hour", "ts")
    per = table(spark, sf_dir, "events").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("v"))
    return per.select(
        F.when(F.hour("hour") == 3, "soon").otherwise(millis("hour").cast("string")).alias("ts"),
        F.when(F.hour("hour") == 5, "many").otherwise(F.col("n").cast("string")).alias("total"),
        F.col("v").cast("string").alias("flagged"),
    )


HISTORY = """SELECT hour AS ts, CASE WHEN hour(hour) = 5 THEN 0 ELSE n END::INT AS total, v::INT AS flagged
  FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY 1) WHERE hour(hour) <> 3"""


def plain(df):
    return df.withColumn("ts", F.unix_millis("ts"))


def scan_history(spark, sf_dir):
    return plain(M.keep_last(M.read_history(history_rows(spark, sf_dir)), CAPS["history"], order="ts"))


def latest_scan(spark, sf_dir):
    return plain(M.latest_scan(M.read_history(history_rows(spark, sf_dir))))


def total_processed(spark, sf_dir):
    return M.total_processed(M.read_history(history_rows(spark, sf_dir)))


def report_text(spark, sf_dir):
    url = F.when(F.col("lang") != "en", F.concat(F.lit("https://h/"), F.col("source")))
    return documents(spark, sf_dir).select("comment_id", F.md5(T.report_text(F.col("text"), url)).alias("report_md5"))


def log_rows(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "scan:").when(F.col("event_type") == "click", "provider:").otherwise("other:")
    line = T.log_line(millis("ts"), F.concat(kind, F.col("event_type"), F.lit("\n"), F.col("event_id")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), line.alias("line"))


def log_tail(spark, sf_dir):
    return M.log_tail(log_rows(spark, sf_dir), read=50, show=30)


def log_messages(spark, sf_dir):
    return log_rows(spark, sf_dir).select("seq", T.log_message(F.col("line")).alias("message"))


def text_functions(spark, sf_dir):
    """Trimming, blanks, separators, previews, clamps and ratios of every document."""
    text = F.concat(F.lit("\t "), F.col("text"), F.lit("\n"))
    total = F.col("comment_id") % 4
    return documents(spark, sf_dir).select(
        "comment_id",
        F.md5(T.trim_all(text)).alias("trimmed_md5"),
        T.blank_to_null(F.when(F.col("lang") == "fr", "  ").otherwise("x")).alias("not_blank"),
        T.without_separators(F.concat(F.lit("a\x01b\x02"), F.col("source"))).alias("clean"),
        T.preview(F.col("text"), 30).alias("preview"),
        F.round(T.clamp(F.char_length("text") / 1000, 0, 1).cast("double"), 4).alias("clamped"),
        T.progress(F.lit(2), total).cast("double").alias("progress"),
        F.coalesce(F.unix_millis(T.millis_to_timestamp(F.col("comment_id"))), F.lit(-1)).alias("millis"),
    )


def maintain_urls(spark, sf_dir):
    """Page visits as URL changes: views add a user's URL, errors remove it; forty are monitored at most."""
    change = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "error", "remove")
    changes = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit(" https://h/"), F.col("user_id")).alias("url"), change.alias("change"))
    return M.maintain_urls(changes.filter("change is not null"), 40)


def stream_scan(spark, sf_dir):
    """The scan as a stream over all documents; distinct flagged texts."""
    out = scratch(spark, "stream-scan")
    schema = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern: the table may be one file
    comments = docs.select(F.col("doc_id").cast("string").alias("comment_id"), "text", F.lit(None).cast("string").alias("source_url"))
    R.start_scan(comments, out, f"{out}/_state", lambda: phrase_row(spark), once=True).awaitTermination()
    return R.read_table(spark, f"{out}/flagged", R.FLAGGED).select(F.md5("text").alias("text_md5")).distinct()


def stream_stats(spark, sf_dir):
    """The statistics that the streamed scan writes, over its batches."""
    out = scratch(spark, "stream-stats")
    schema = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    comments = docs.select(F.col("doc_id").cast("string").alias("comment_id"), "text", F.lit(None).cast("string").alias("source_url"))
    config = ScanConfig(use_opinion=True)
    R.start_scan(comments, out, f"{out}/_state", lambda: phrase_row(spark), config, once=True, opinion=keyword_opinion).awaitTermination()
    return R.read_table(spark, f"{out}/stats", R.STATS).agg(*(F.sum(c).alias(c) for c in ("total", "flagged", "asked", "errors", "new_flags")))


def stream_moderation(spark, sf_dir):
    """The moderation log as a stream; the state after the last batch."""
    out = scratch(spark, "stream-moderation")
    schema = table(spark, sf_dir, "events").schema
    names = F.create_map(*(F.lit(x) for pair in MAPPED.items() for x in pair))
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    log = events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("item_id"), names[F.col("event_type")].alias("action"))
    R.start_moderation(log, out, f"{out}/_state", once=True).awaitTermination()
    return settled(R.latest_state(spark, out))


def keyed_log(spark, sf_dir, name):
    """The checkpoint of a stream over the log of every action, in three parts, with a start anew after each."""
    out, log = scratch(spark, name), full_actions(spark, sf_dir)
    edges = log.agg(F.min("seq"), F.max("seq")).first()
    low, high = (x or 0 for x in edges)
    third = (high - low) // 3 + 1
    for k in range(3):
        log.filter(F.floor((F.col("seq") - low) / third) == k).write.mode("append").parquet(f"{out}/in")
        K.start_keyed_moderation(spark.readStream.schema(log.schema).parquet(f"{out}/in"), f"{out}/_state", once=True).awaitTermination()
    return f"{out}/_state"


def stream_keyed_moderation(spark, sf_dir):
    """The state of each item with corrections and global clears in between, read out of the state store."""
    return settled(K.stored_states(spark, keyed_log(spark, sf_dir, "keyed-states")))


def stream_metrics(spark, sf_dir):
    """The counters of the streamed log, read out of the state store."""
    return K.stored_metrics(spark, keyed_log(spark, sf_dir, "keyed-counters"))


def stream_totals(spark, sf_dir):
    """Comments processed so far and the latest scan, as a streamed history of three files leaves them."""
    out, rows = scratch(spark, "totals"), history_rows(spark, sf_dir)
    for k in range(3):
        rows.filter(F.pmod(F.xxhash64("ts"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    R.start_totals(M.read_history(stream), out, f"{out}/_state", once=True).awaitTermination()
    return R.latest_totals(spark, out).select("total_processed", "scans", F.unix_millis("latest.ts").alias("ts"), "latest.total", "latest.flagged")


def scan_in_batches(spark, sf_dir, out):
    """All documents as three scans, one after the other."""
    docs = documents(spark, sf_dir).withColumn("source_url", F.lit(None).cast("string"))
    for k in range(3):
        batch = docs.filter(F.col("comment_id") % 3 == k).withColumn("seq", F.col("comment_id"))
        R.scan_batch(batch.withColumn("comment_id", F.col("comment_id").cast("string")), k, out, lambda: phrase_row(spark), ScanConfig())


def stream_history(spark, sf_dir):
    """The history that scans leave: what each held, flagged, and flagged anew."""
    out = scratch(spark, "history")
    scan_in_batches(spark, sf_dir, out)
    return R.scan_history(spark, out).select("batch_id", "total", "flagged", "new_flags")


def stream_last_comments(spark, sf_dir):
    """What the last of the scans leaves to review: its last comments by arrival, not by id."""
    out = scratch(spark, "last")
    scan_in_batches(spark, sf_dir, out)
    return R.last_comments(spark, out).select("seq", "comment_id", F.md5("text").alias("text_md5"))


def stream_progress(spark, sf_dir):
    """How far a streamed scan was when it ended."""
    out = scratch(spark, "progress")
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    comments = docs.select(F.col("doc_id").cast("string").alias("comment_id"), "text", F.lit(None).cast("string").alias("source_url"))
    progress = R.ScanProgress(spark, out)
    R.start_scan(comments, out, f"{out}/_state", lambda: phrase_row(spark), once=True, progress=progress).awaitTermination()
    progress.wait()
    rows = R.scan_progress(spark, out)
    return rows.groupBy("message").agg(F.max("done").alias("done"), F.max("total").alias("total")).filter("message = 'Done'")


def ordered_scan(spark, sf_dir):
    """All documents as three loads that arrive one after the other, scanned fifty at a time; the stream starts anew for each."""
    out = scratch(spark, "ordered")
    docs = documents(spark, sf_dir).select(F.col("comment_id").cast("string").alias("comment_id"), "text", F.lit(None).cast("string").alias("source_url"), F.col("comment_id").alias("seq"))
    for k in range(3):
        docs.filter(F.col("seq") % 3 == k).write.mode("append").parquet(f"{out}/in")
        R.start_ordered_scan(spark, f"{out}/in", "comment_id string, text string, source_url string, seq long", out, f"{out}/_state", lambda: phrase_row(spark), files=None).awaitTermination()
    return R.scan_history(spark, out, None).select("batch_id", "part", "total", "flagged", "new_flags")


def request_outbox(spark, sf_dir):
    """Hide and delete requests over three batches, the last of which runs twice: each is emitted once."""
    out = scratch(spark, "outbox")
    # All requests are of these texts, so documents are scanned and their ids looked up once; only ids of flagged texts are sought.
    flags = scratch_table(flagged_log(spark, sf_dir), "outbox-flags")
    mine = F.sha2(T.without_separators(F.col("text")), 256).alias("key")
    log = id_map(spark, sf_dir).withColumn("key", mine).join(flags.select(mine).distinct(), "key", "left_semi").drop("key")
    ids = scratch_table(M.upsert_comment_ids(log, None), "outbox-ids")
    ask = lambda action: M.moderation_requests(flags, ids, action).withColumn("epoch", F.lit(1))
    hide, delete = ask("hide"), ask("delete")
    for batch, requests in enumerate((hide, delete, hide.unionByName(delete))):
        R.emit_requests(requests, batch, out)
    R.emit_requests(hide.unionByName(delete).unionByName(hide.withColumn("epoch", F.lit(2))), 2, out)
    return R.read_table(spark, f"{out}/requests", R.REQUESTS).select("comment_id", "action", "epoch", F.md5("text").alias("text_md5"))


#: Each flag with the scan that made it: new unless an earlier scan flagged its text.
SCANNED = """WITH scans AS ({scans}), flags AS (SELECT text, min(scan) AS first FROM scans WHERE flagged GROUP BY text)
  SELECT {keys}, count(*) AS total, count(*) FILTER (flagged) AS flagged, count(*) FILTER (flagged AND scan = first) AS new_flags FROM scans LEFT JOIN flags USING (text) GROUP BY ALL"""
FLAGGED = f"SELECT comment_id AS seq, text FROM ({DECIDED}) WHERE flagged"
LINE = "CASE event_type WHEN 'view' THEN 'scan:' WHEN 'click' THEN 'provider:' ELSE 'other:' END || event_type || ' ' || event_id"

QUERIES = {
    "moderation_state": (moderation_state, STATE),
    "moderation_clears": (moderation_clears, f"{WALK} SELECT user_id::VARCHAR AS item_id, state, CASE WHEN state = 'none' THEN -1 ELSE since END AS since FROM done"),
    "action_metrics": (action_metrics, f"{WALK} {METRICS}"),
    "keep_last_flagged": (keep_last_flagged, f"SELECT seq FROM ({FLAGGED}) ORDER BY seq DESC LIMIT 500"),
    "keep_last_per_source": (keep_last_per_source, "SELECT source, doc_id AS seq FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 5"),
    "training_queue": (
        training_queue,
        f"SELECT seq, md5(text) AS text_md5 FROM ({ENQUEUED}) WHERE seq IN ({WAITING})",
    ),
    "last_comments": (
        last_comments,
        "SELECT doc_id + 1 AS seq, false AS cleared, md5(text) AS text_md5 FROM documents WHERE doc_id // 50 = (SELECT max(doc_id) // 50 FROM documents) ORDER BY doc_id DESC LIMIT 20",
    ),
    "review_view": (
        review_view,
        f"""SELECT false AS everything, comment_id AS seq, 'https://h/' || source AS source_url, md5(text) AS text_md5 FROM ({DECIDED}) WHERE flagged
            UNION ALL SELECT true, doc_id + 1, NULL, md5(text) FROM documents WHERE doc_id // 50 = (SELECT max(doc_id) // 50 FROM documents)""",
    ),
    "append_then_cap": (append_then_cap, f"SELECT seq, md5(text) AS text_md5 FROM ({FLAGGED}) ORDER BY seq DESC LIMIT 20"),
    "lexicon_capped": (
        lexicon_capped,
        f"""SELECT polarity, 'user ' || (e // 1000000000) AS phrase, e % 1000000000 AS seq FROM (
             SELECT polarity, unnest({FIFO.format(cap=20)}) AS e
             FROM (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'hate' ELSE 'safe' END AS polarity, event_id AS seq, (user_id * 1000000000 + event_id)::BIGINT AS code FROM events)
             GROUP BY polarity)""",
    ),
    "stream_stats": (
        stream_stats,
        f"""SELECT count(*) AS total, count(*) FILTER (flagged) AS flagged, count(*) FILTER (borderline) AS asked, 0::BIGINT AS errors, count(*) FILTER (flagged) AS new_flags FROM ({OPINED})""",
    ),
    "comment_id_upsert": (
        comment_id_upsert,
        "SELECT md5(text) AS text_md5, 'c' || max(doc_id) AS comment_id, max(doc_id) AS seq FROM documents GROUP BY text ORDER BY seq DESC LIMIT 1000",
    ),
    "moderation_requests": (
        moderation_requests,
        f"SELECT 'c' || m.id AS comment_id, 'hide' AS action, md5(f.text) AS text_md5 FROM ({FLAGGED}) f JOIN (SELECT text, max(doc_id) AS id FROM documents GROUP BY text) m ON f.text = m.text",
    ),
    "scan_history": (scan_history, f"SELECT epoch_ms(ts) AS ts, total, flagged FROM ({HISTORY}) ORDER BY ts DESC LIMIT 200"),
    "latest_scan": (latest_scan, f"SELECT epoch_ms(ts) AS ts, total, flagged FROM ({HISTORY}) ORDER BY ts DESC LIMIT 1"),
    "total_processed": (total_processed, f"SELECT sum(total)::BIGINT AS total_processed FROM ({HISTORY})"),
    "report_text": (
        report_text,
        "SELECT doc_id AS comment_id, md5('Hateful comment report' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Source: ' || CASE WHEN lang <> 'en' THEN 'https://h/' || source ELSE 'unknown' END) AS report_md5 FROM documents",
    ),
    "log_tail": (
        log_tail,
        f"SELECT seq, message FROM (SELECT event_id AS seq, {LINE} AS message FROM events ORDER BY event_id DESC LIMIT 50) WHERE message LIKE 'scan:%' OR message LIKE 'provider:%' ORDER BY seq DESC LIMIT 30",
    ),
    "log_messages": (log_messages, f"SELECT event_id AS seq, {LINE} AS message FROM events"),
    "text_functions": (
        text_functions,
        """SELECT doc_id AS comment_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS trimmed_md5, CASE WHEN lang <> 'fr' THEN 'x' END AS not_blank, 'a b ' || source AS clean,
           substr(text, 1, 30) AS preview, round(least(1, length(text) / 1000)::REAL::DOUBLE, 4) AS clamped,
           CASE WHEN doc_id % 4 > 0 THEN least(2, doc_id % 4) / (doc_id % 4) END AS progress, CASE WHEN doc_id <> 0 THEN doc_id ELSE -1 END AS millis FROM documents""",
    ),
    "maintain_urls": (
        maintain_urls,
        f"""SELECT 'https://h/' || (e // 1000000000) AS url, e % 1000000000 AS seq FROM (
             SELECT unnest({FIFO.format(cap=40)}) AS e
             FROM (SELECT event_id AS seq, (user_id * 1000000000 + event_id + CASE event_type WHEN 'error' THEN 1000000000000000000 ELSE 0 END)::BIGINT AS code
                   FROM events WHERE event_type IN ('view', 'error')))""",
    ),
    "stream_history": (stream_history, SCANNED.format(scans=f"SELECT *, comment_id % 3 AS scan FROM ({DECIDED})", keys="scan::INT AS batch_id")),
    "stream_last_comments": (
        stream_last_comments,
        "SELECT doc_id AS seq, doc_id::VARCHAR AS comment_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 3 = 2 ORDER BY doc_id DESC LIMIT 500",
    ),
    "stream_progress": (stream_progress, "SELECT 'Done' AS message, count(*) AS done, count(*) AS total FROM documents"),
    "ordered_scan": (
        ordered_scan,
        SCANNED.format(
            scans=f"SELECT *, b * 1000000 + part AS scan FROM (SELECT *, comment_id % 3 AS b, (row_number() OVER (PARTITION BY comment_id % 3 ORDER BY comment_id) - 1) // 50 AS part FROM ({DECIDED}))",
            keys="b::INT AS batch_id, part",
        ),
    ),
    "request_outbox": (
        request_outbox,
        f"""SELECT DISTINCT 'c' || m.id AS comment_id, action, epoch::BIGINT AS epoch, md5(f.text) AS text_md5
            FROM ({FLAGGED}) f JOIN (SELECT text, max(doc_id) AS id FROM documents GROUP BY text) m ON f.text = m.text, (VALUES ('hide', 1), ('delete', 1), ('hide', 2)) v(action, epoch)""",
    ),
    "stream_scan": (stream_scan, f"SELECT DISTINCT md5(text) AS text_md5 FROM ({FLAGGED})"),
    "stream_moderation": (stream_moderation, STATE),
    "stream_keyed_moderation": (stream_keyed_moderation, f"{WALK} SELECT user_id::VARCHAR AS item_id, state, CASE WHEN state = 'none' THEN -1 ELSE since END AS since FROM done"),
    "stream_metrics": (stream_metrics, f"{WALK} {METRICS}"),
    "stream_totals": (
        stream_totals,
        f"SELECT sum(total)::BIGINT AS total_processed, count(*) AS scans, max(epoch_ms(ts)) AS ts, arg_max(total, ts)::BIGINT AS total, arg_max(flagged, ts)::BIGINT AS flagged FROM ({HISTORY})",
    ),
}
