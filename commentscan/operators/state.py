"""Capped tables, and the moderation log folded into the state of each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentscan.config import CAPS
from commentscan.functions import text as T
from commentscan.functions.capped import capped_adds

ACTIONS = ("flag", "hide", "unhide", "delete", "correct", "report", "clear_flagged", "clear_hidden", "label_hate", "label_safe")
NONE, FLAGGED, HIDDEN = 0, 1, 2
MOVES = ("flag", "hide", "unhide", "delete", "correct")
#: Sequence numbers, and later chunks, that one group of an item spans at most; and sequence numbers of a bucket of clears.
CHUNK, BUCKET = 1000, 10_000


def keep_last(df: DataFrame, n: int | None, by: str | None = None, order: str = "seq") -> DataFrame:
    """The last n rows by order, of each value of `by` if given."""
    if n is None:
        return df
    if by is None:
        return df.orderBy(F.desc(order)).limit(n)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def _next(state: Column, action: Column) -> Column:
    """The state after an action; actions that do not apply change nothing."""
    return (
        F.when((action == "flag") & (state == NONE), FLAGGED)
        .when((action == "hide") & (state == FLAGGED), HIDDEN)
        .when((action == "unhide") & (state == HIDDEN), FLAGGED)
        .when((action == "delete") & (state != NONE), NONE)
        .when((action == "correct") & (state == FLAGGED), NONE)
        .otherwise(state)
    )


def with_last_clears(actions: DataFrame) -> DataFrame:
    """actions with cleared_flagged and cleared_hidden: the seq of the last such clear before each row, -1 for none.

    Running maxima in three steps, over buckets of buckets, buckets, and rows. As each seq stands once, no group but the
    first one (a row for each BUCKET * BUCKET seqs) grows with the log.
    """
    kinds = ("clear_flagged", "clear_hidden")
    placed = actions.withColumn("_bucket", F.floor(F.col("seq") / BUCKET)).withColumn("_top", F.floor(F.col("_bucket") / BUCKET))
    seqs = [F.when(F.col("action") == kind, F.col("seq")) for kind in kinds]
    per = placed.filter(F.col("action").isin(*kinds)).groupBy("_top", "_bucket").agg(*(F.max(s).alias(f"_{k}") for s, k in zip(seqs, kinds, strict=True)))
    tops = per.groupBy("_top").agg(*(F.max(f"_{k}").alias(f"_{k}") for k in kinds))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    every = lambda of, key: placed.select(*key).distinct().join(of, list(key), "left")
    high = every(tops, ("_top",)).select("_top", *(F.max(f"_{k}").over(until(Window.orderBy("_top"))).alias(f"_high_{k}") for k in kinds))
    within = until(Window.partitionBy("_top").orderBy("_bucket"))
    low = every(per, ("_top", "_bucket")).select("_top", "_bucket", *(F.max(f"_{k}").over(within).alias(f"_low_{k}") for k in kinds))
    both = low.join(high, "_top").select("_bucket", *(F.coalesce(f"_low_{k}", f"_high_{k}", F.lit(-1)).alias(f"_before_{k}") for k in kinds))
    inside = until(Window.partitionBy("_bucket").orderBy("seq"))
    rows = placed.join(both, "_bucket").select("*", *(F.max(s).over(inside).alias(f"_in_{k}") for s, k in zip(seqs, kinds, strict=True)))
    named = [F.coalesce(f"_in_{k}", f"_before_{k}").alias(n) for k, n in zip(kinds, ("cleared_flagged", "cleared_hidden"), strict=True)]
    return rows.select(*actions.columns, *named)


def _start(state: int) -> Column:
    none = F.lit(None).cast("long")
    return F.struct(F.lit(state).alias("state"), none.alias("since"), *(F.lit(0).cast("long").alias(n) for n in ("hides", "deletes", "corrects", "safe")))


def _cleared(state: Column, at: Column, then: Column) -> Column:
    """Whether a clear since `at` drops the state before `then`, which knows the last clears before it."""
    return ((state == FLAGGED) & (then["cleared_flagged"] > at)) | ((state == HIDDEN) & (then["cleared_hidden"] > at))


def _chunk_ends(steps: Column, state: int) -> Column:
    """Where the steps lead from a state: (state, since: null if it never changed, effective hides, deletes and corrections)."""

    def step(acc: Column, a: Column) -> Column:
        gone = _cleared(acc["end"]["state"], acc["at"], a)
        now = F.when(gone, NONE).otherwise(acc["end"]["state"])
        then = _next(now, a["action"])
        count = lambda name, which: (acc["end"][name] + F.when(which, 1).otherwise(0)).alias(name)
        corrects = (a["action"] == "correct") & (now == FLAGGED)
        end = F.struct(
            then.alias("state"),
            F.when(then != now, a["seq"]).otherwise(acc["end"]["since"]).alias("since"),
            count("hides", (a["action"] == "hide") & (now == FLAGGED)),
            count("deletes", (a["action"] == "delete") & (now != NONE)),
            count("corrects", corrects),
            count("safe", corrects & a["says"]),
        )
        return F.struct(end.alias("end"), a["seq"].alias("at"))

    return F.aggregate(steps, F.struct(_start(state).alias("end"), F.get(steps, 0)["seq"].alias("at")), step, lambda acc: acc["end"])


def _joined_ends(chunks: Column, state: int) -> Column:
    """As _chunk_ends, over chunks in order, each with its own ends from every state."""

    def step(acc: Column, c: Column) -> Column:
        now = F.when(_cleared(acc["end"]["state"], acc["at"], c), NONE).otherwise(acc["end"]["state"])
        to = F.when(now == NONE, c["from_0"]).when(now == FLAGGED, c["from_1"]).otherwise(c["from_2"])
        counts = [(acc["end"][n] + to[n]).alias(n) for n in ("hides", "deletes", "corrects", "safe")]
        return F.struct(F.struct(to["state"].alias("state"), F.coalesce(to["since"], acc["end"]["since"]).alias("since"), *counts).alias("end"), c["last"].alias("at"))

    return F.aggregate(chunks, F.struct(_start(state).alias("end"), F.get(chunks, 0)["first"].alias("at")), step, lambda acc: acc["end"])


_ENDS = ("first", "last", "cleared_flagged", "cleared_hidden", "from_0", "from_1", "from_2")


def folded(actions: DataFrame) -> DataFrame:
    """actions (seq, item_id, action, perhaps text) to one row an item: what its log does from each of the three states.

    (item_id, first, last, cleared_flagged, cleared_hidden, from_0, from_1, from_2): its first and last seq, the clears before
    the first one, and where it leads. Logs fold level by level: CHUNK seqs first, then CHUNK chunks at a time, so no
    group has more than CHUNK rows, however long an item's log is. Each seq must stand once.
    """
    says = F.coalesce(T.trim_all(F.col("text")) != "", F.lit(False)) if "text" in actions.columns else F.lit(True)
    # Clears are looked up over the rows that matter only.
    slim = actions.select("seq", "item_id", "action", says.alias("says")).filter(F.col("action").isin(*MOVES, "clear_flagged", "clear_hidden"))
    own = with_last_clears(slim).filter(F.col("item_id").isNotNull() & F.col("action").isin(*MOVES))
    step = F.struct("seq", "action", "says", "cleared_flagged", "cleared_hidden")
    chunks = own.groupBy("item_id", F.floor(F.col("seq") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    head = F.get("steps", 0)
    level = chunks.select(
        "item_id", "chunk", head["seq"].alias("first"), F.element_at("steps", -1)["seq"].alias("last"), head["cleared_flagged"].alias("cleared_flagged"), head["cleared_hidden"].alias("cleared_hidden"),
        *(_chunk_ends(F.col("steps"), s).alias(f"from_{s}") for s in (NONE, FLAGGED, HIDDEN)),
    )
    low, high = actions.agg(F.min("seq"), F.max("seq")).first()
    low, high = ((x or 0) // CHUNK for x in (low, high))
    while low != high:
        low, high = low // CHUNK, high // CHUNK
        groups = level.groupBy("item_id", F.floor(F.col("chunk") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(*_ENDS))).alias("log"))
        head = F.get("log", 0)
        level = groups.select(
            "item_id", "chunk", *(head[n].alias(n) for n in ("first", "cleared_flagged", "cleared_hidden")), F.element_at("log", -1)["last"].alias("last"),
            *(_joined_ends(F.col("log"), s).alias(f"from_{s}") for s in (NONE, FLAGGED, HIDDEN)),
        )
    return level.select("item_id", *_ENDS)


def onto(state: DataFrame, done: DataFrame) -> DataFrame:
    """(item_id, state, since, at): the items of `done`, a fold of later actions, from where `state` (same columns) had them."""
    both = done.join(state.select("item_id", F.col("state").alias("_was"), F.col("since").alias("_since"), F.col("at").alias("_at")), "item_id", "left")
    was = F.coalesce("_was", F.lit(NONE))
    gone = ((was == FLAGGED) & (F.col("cleared_flagged") > F.col("_at"))) | ((was == HIDDEN) & (F.col("cleared_hidden") > F.col("_at")))
    now = F.when(F.coalesce(gone, F.lit(False)), NONE).otherwise(was)
    to = F.when(now == NONE, F.col("from_0")).when(now == FLAGGED, F.col("from_1")).otherwise(F.col("from_2"))
    ended = both.select("item_id", to.alias("to"), "_since", F.col("last").alias("at"))
    return ended.select("item_id", F.col("to.state").alias("state"), F.when(F.col("to.state") != NONE, F.coalesce("to.since", "_since")).alias("since"), "at")


def last_clears(actions: DataFrame) -> DataFrame:
    """One row: the last clear of each table, -1 for none."""
    last = lambda kind: F.coalesce(F.max(F.when(F.col("action") == kind, F.col("seq"))), F.lit(-1))
    return actions.agg(last("clear_flagged").alias("cleared_flagged"), last("clear_hidden").alias("cleared_hidden"))


def named_states(ended: DataFrame, clears: DataFrame) -> DataFrame:
    """(item_id, state, since) with names for states, after the last clears (one row)."""
    state = F.when(F.coalesce(_cleared(F.col("state"), F.col("at"), {n: F.col(n) for n in ("cleared_flagged", "cleared_hidden")}), F.lit(False)), NONE).otherwise(F.col("state"))
    names = F.when(state == FLAGGED, "flagged").when(state == HIDDEN, "hidden").otherwise("none")
    return ended.crossJoin(F.broadcast(clears)).select("item_id", names.alias("state"), F.when(state != NONE, F.col("since")).alias("since"))


def moderation_state(actions: DataFrame) -> DataFrame:
    """actions (seq, item_id, action) to (item_id, state, since): none, flagged or hidden, and the seq that led there.

    Clears are global: they drop what entered the table before them. Rows without an item or with other actions count
    for nothing; an empty log gives no rows.
    """
    to = F.col("from_0")
    ended = folded(actions).select("item_id", to["state"].alias("state"), to["since"].alias("since"), F.col("last").alias("at"))
    return named_states(ended, last_clears(actions))


def action_metrics(actions: DataFrame) -> DataFrame:
    """One row: how often each counted action was taken. actions: seq, item_id, action, text.

    Hides, corrections and deletes count where they changed something; labels count unless their text is blank.
    """
    to, says = F.col("from_0"), T.trim_all(F.col("text")) != ""
    total = lambda name: F.coalesce(F.sum(to[name]), F.lit(0)).cast("long")
    moved = folded(actions).agg(total("corrects").alias("false_positives"), total("hides").alias("hidden"), total("deletes").alias("deleted"), total("safe").alias("_safe"))
    count = lambda name, which=F.lit(True): F.count_if((F.col("action") == name) & which)  # noqa: E731, B008
    raw = actions.agg(count("report").alias("reported"), count("label_hate", says).alias("trained_hate"), count("label_safe", says).alias("trained_safe"))
    both = moved.crossJoin(F.broadcast(raw))  # one row each
    return both.select("false_positives", "hidden", "deleted", "reported", "trained_hate", (F.col("trained_safe") + F.col("_safe")).alias("trained_safe"))


def corrections_as_labels(actions: DataFrame) -> DataFrame:
    """Labels (seq, text, label) that the log gives: explicit ones, and a safe one for each corrected false positive."""
    label = F.when(F.col("action") == "label_hate", "hate").when(F.col("action").isin("label_safe", "correct"), "safe")
    return actions.select("seq", "text", label.alias("label")).filter("label is not null")


def training_queue(enqueued: DataFrame, labels: DataFrame, cap: int | None = CAPS["queue"]) -> DataFrame:
    """enqueued (seq, text) to what waits after all labels (seq, text), oldest first: `cap` texts at most.

    A label answers the oldest occurrence of its text that waits; one that finds none answers nothing. So a text that is
    enqueued again after its label is asked again, and of two equal ones, one label leaves one. Each text that is enqueued
    pushes out the oldest beyond the cap, which no label can answer any more. Stored texts have record separators blanked, on
    both sides. At equal seqs labels come first; null texts are never answered.
    """
    text = T.without_separators(F.col("text"), both=False)
    key = F.coalesce(F.sha2(text, 256), F.lit(""))
    ins = enqueued.select("seq", key.alias("key"))
    outs = labels.filter("text is not null").select("seq", key.alias("key")).join(ins.select("key").distinct(), "key", "left_semi")
    numbered = enqueued.withColumn("key", key).withColumn("text", text)
    if cap is not None:
        changes = ins.withColumn("change", F.lit("add")).unionByName(outs.withColumn("change", F.lit("remove")))
        held = capped_adds(changes.select(F.lit("queue").alias("side"), "seq", "key", "change"), cap, repeats=True)
        return numbered.join(held.select("seq", "key"), ["seq", "key"], "left_semi").drop("key").orderBy("seq")
    # Without a cap, a text's balance rises with each entry and falls with each label. All labels but those that would have brought
    # it below 0 were spent, on the oldest entries.
    events = ins.withColumn("enters", F.lit(1)).unionByName(outs.withColumn("enters", F.lit(-1)))
    level = F.sum("enters").over(Window.partitionBy("key").orderBy("seq", "enters").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spent = events.withColumn("level", level).groupBy("key").agg((F.count_if(F.col("enters") < 0) + F.least(F.lit(0), F.min("level"))).alias("spent"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    return numbered.withColumn("nth", nth).join(spent, "key").filter("nth > spent").drop("nth", "spent", "key").orderBy("seq")


def last_comments(scanned: DataFrame, clears: DataFrame | None = None, cap: int | None = CAPS["last_comments"]) -> DataFrame:
    """scanned (scan_id, seq, text) to the last `cap` comments of the last scan, which overwrites those before it.

    clears (scan_id): the scans after which the table was cleared; nothing is left if the last one is among them.
    """
    last = scanned.agg(F.max("scan_id").alias("scan_id"))
    held = scanned.join(F.broadcast(last), "scan_id")  # one row
    if clears is not None:
        held = held.join(clears.select("scan_id").distinct(), "scan_id", "left_anti")
    return keep_last(held.withColumn("text", T.without_separators(F.col("text"), both=False)), cap)


def review(flagged: DataFrame, last: DataFrame, everything: bool = False) -> DataFrame:
    """(seq, text, source_url) to review: what is flagged, or all comments of the last scan, which have no URL."""
    return last.select("seq", "text", F.lit(None).cast("string").alias("source_url")) if everything else flagged.select("seq", "text", "source_url")


def upsert_comment_ids(log: DataFrame, cap: int | None = CAPS["id_map"]) -> DataFrame:
    """(text, comment_id, seq): the last id of each text."""
    clean = log.select(T.without_separators(F.col("text")).alias("text"), "comment_id", "seq")
    return keep_last(clean.groupBy("text").agg(F.max_by("comment_id", "seq").alias("comment_id"), F.max("seq").alias("seq")), cap)


def moderation_requests(flagged: DataFrame, id_map: DataFrame, action: str) -> DataFrame:
    """(comment_id, action, text) for flagged items with a known comment id."""
    clean = flagged.withColumn("text", T.without_separators(F.col("text")))
    return clean.join(id_map.select("text", "comment_id"), "text").select("comment_id", F.lit(action).alias("action"), "text")


def read_history(raw: DataFrame) -> DataFrame:
    """raw (ts, total, flagged as text): rows with a bad time are dropped, bad counts are 0."""
    millis = F.col("ts").try_cast("bigint")
    return raw.select(F.timestamp_millis(millis).alias("ts"), T.count_or_zero(F.col("total")).alias("total"), T.count_or_zero(F.col("flagged")).alias("flagged")).filter("ts is not null")


def total_processed(history: DataFrame) -> DataFrame:
    return history.agg(F.coalesce(F.sum(F.greatest("total", F.lit(0))), F.lit(0)).alias("total_processed"))


def latest_scan(history: DataFrame) -> DataFrame:
    return history.agg(F.max_by(F.struct("ts", "total", "flagged"), F.struct("ts", "total", "flagged")).alias("x")).select("x.*")


def maintain_urls(changes: DataFrame, cap: int | None = CAPS["urls"]) -> DataFrame:
    """changes (seq, url, change: add or remove; clear has no url) to (url, seq), with the place of each URL.

    A URL keeps its place until it is removed, cleared or, with each add, pushed out as the oldest of more than cap.
    """
    clean = changes.withColumn("url", T.trim_all(F.col("url"))).filter("change = 'clear' or url <> ''")
    if cap is not None:
        return capped_adds(clean.select(F.lit("url").alias("side"), "seq", F.col("url").alias("key"), "change"), cap).select(F.col("key").alias("url"), "seq")
    cleared = clean.filter("change = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cleared"))
    removed = clean.filter("change = 'remove'").groupBy("url").agg(F.max("seq").alias("removed"))
    added = clean.filter("change = 'add'").join(removed, "url", "left").crossJoin(F.broadcast(cleared))
    return added.filter("seq > coalesce(removed, -1) and seq > cleared").groupBy("url").agg(F.min("seq").alias("seq"))


def log_tail(lines: DataFrame, read: int = 5, show: int = 3) -> DataFrame:
    """lines (seq, line): of the last `read`, the scan and provider messages, the last `show`."""
    last = keep_last(lines, read).select("seq", T.log_message(F.col("line")).alias("message"))
    return keep_last(last.filter(F.col("message").startswith("scan:") | F.col("message").startswith("provider:")), show)
