"""Lexicon scores in single precision, and the phrases that users add."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentscan.config import CAPS
from commentscan.functions import text as T
from commentscan.functions.automaton import DEPTH, Automaton
from commentscan.functions.capped import capped_adds
from commentscan.sources.scratch import scratch_table

# Terms and weights of the base lexicon, in the order of summation, and what a user phrase adds or takes.
PHRASES = {
    "fuck you": 0.9, "kill yourself": 1.0, "go die": 0.95, "stupid bitch": 0.95,
    "you people": 0.6, "dirty": 0.5, "get out": 0.4, "go back": 0.5,
}
WORDS = {
    "awful": 0.5, "toxic": 0.6, "abuse": 0.7, "hate": 0.7, "kill": 0.9, "die": 0.8,
    "bitch": 0.8, "slur": 0.7, "idiot": 0.5, "dumb": 0.4, "stupid": 0.5, "trash": 0.4,
}
HATE_WEIGHT, SAFE_WEIGHT = 0.8, 0.4
#: Entries of a capped lexicon's side that may be broadcast; a larger one is joined by shuffle.
SMALL = 100_000


def single(value: float) -> Column:
    return F.lit(value).cast("float")


def _total(lowered: Column) -> Column:
    score = single(0)
    for term, weight in {**PHRASES, **WORDS}.items():
        score = score + F.when(lowered.contains(term), single(weight)).otherwise(single(0))
    return F.least(score, single(1))


def _occurring(lowered: Column, phrases: Column) -> Column:
    return F.filter(phrases, lambda p: F.contains(lowered, p) & ~p.rlike(r"(?U)^\s*$"))


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def base_score(text: Column) -> Column:
    """Each term that occurs counts once, wherever it stands; at most 1. Null texts score 0."""
    return T.let(lowered(text), _total)


def hits(text: Column, phrases: Column) -> Column:
    """The phrases of an array that occur in the text; blank ones never do."""
    return T.let(lowered(text), lambda t: _occurring(t, phrases))


def _with_hits(base: Column, n_hate: Column, n_safe: Column) -> Column:
    """The capped base score, plus and minus the weights of the phrases that occur, one by one; held to 0..1 at the end only."""
    raised = F.aggregate(n_hate, base, lambda s, _: (s + single(HATE_WEIGHT)).cast("float"))
    return T.clamp(F.aggregate(n_safe, raised, lambda s, _: (s - single(SAFE_WEIGHT)).cast("float")), 0, 1)


def hits_and_score(text: Column, hate: Column, safe: Column) -> Column:
    """struct(hate_hits, safe_hits, score): the phrases of two arrays that occur in the text, and the user score; the text is put
    in lower case once."""
    found = T.let(lowered(text), lambda t: F.struct(_occurring(t, hate).alias("hate_hits"), _occurring(t, safe).alias("safe_hits"), _total(t).alias("base")))
    return T.let(found, lambda f: F.struct(f["hate_hits"].alias("hate_hits"), f["safe_hits"].alias("safe_hits"), _with_hits(f["base"], f["hate_hits"], f["safe_hits"]).alias("score")))


def user_score(text: Column, hate: Column, safe: Column) -> Column:
    return hits_and_score(text, hate, safe)["score"]


def register_sql_functions(spark: SparkSession) -> None:
    """base_score(text) and user_score(text, hate phrases, safe phrases) for spark.sql, as long as the session lasts; written
    out of the same terms, in single precision."""
    quoted = lambda term: "'" + term.replace("'", "\\'") + "'"
    total = "CAST(0 AS FLOAT)"
    for term, weight in {**PHRASES, **WORDS}.items():
        total = f"({total} + CASE WHEN contains(t, {quoted(term)}) THEN {weight}F ELSE 0F END)"
    base = f"transform(array(lower(coalesce(text, ''))), t -> least({total}, 1F))[0]"
    hits = lambda side: f"filter({side}, p -> contains(lower(coalesce(text, '')), p) AND NOT p RLIKE r'(?U)^\\s*$')"
    raised = f"aggregate({hits('hate')}, {base}, (s, p) -> CAST(s + {HATE_WEIGHT}F AS FLOAT))"
    lowered_by = f"aggregate({hits('safe')}, {raised}, (s, p) -> CAST(s - {SAFE_WEIGHT}F AS FLOAT))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION base_score(text STRING) RETURNS FLOAT RETURN {base}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION user_score(text STRING, hate ARRAY<STRING>, safe ARRAY<STRING>) RETURNS FLOAT RETURN greatest(0F, least(1F, {lowered_by}))")


def _known(labels: DataFrame) -> DataFrame:
    phrase = F.lower(T.trim_all(F.col("text")))
    return labels.select(F.col("label").alias("polarity"), phrase.alias("phrase"), "seq").filter("phrase <> '' and polarity in ('hate', 'safe')")


def build_lexicon(labels: DataFrame, cap: int | None = CAPS["phrases"]) -> DataFrame:
    """labels (seq, text, label: hate or safe) to (polarity, phrase, seq): trimmed, lower case, at most `cap` a side.

    A phrase keeps its place while it is there; each label that adds one caps at once, so a phrase that was pushed out and is
    labelled again goes to the end. Without a cap, the first label of a phrase counts.
    """
    known = _known(labels)
    if cap is None:
        return known.groupBy("polarity", "phrase").agg(F.min("seq").alias("seq"))
    adds = known.select(F.col("polarity").alias("side"), "seq", F.sha2("phrase", 256).alias("key"), F.lit("add").alias("change"))
    held = capped_adds(adds, cap)
    places = held.select(F.col("side").alias("polarity"), "seq")
    if cap <= SMALL:
        places = F.broadcast(places)  # cap rows a side
    return known.join(places, ["polarity", "seq"]).select("polarity", "phrase", "seq")


def newest_phrases(labels: DataFrame, cap: int = CAPS["phrases"]) -> DataFrame:
    """labels as for build_lexicon to (polarity, phrase, seq): of all phrases ever labelled, each with the seq of its first label,
    the `cap` newest a side. Nothing is pushed out on the way, so a phrase that is labelled again stays where it was.

    Of one seq the phrases that sort first stay. Only hashes are grouped and ranked; texts are fetched for what stays.
    """
    known = _known(labels).withColumn("key", F.sha2("phrase", 256))
    first = known.groupBy("polarity", "key").agg(F.min("seq").alias("seq"))
    by_seq = Window.partitionBy("polarity").orderBy(F.desc("seq"))
    places = first.withColumn("place", F.rank().over(by_seq)).filter(F.col("place") <= cap).drop("place")  # and ties of the last
    if cap <= SMALL:
        places = F.broadcast(places)
    found = known.join(places, ["polarity", "key", "seq"]).groupBy("polarity", "key", "seq").agg(F.min("phrase").alias("phrase"))
    newest = Window.partitionBy("polarity").orderBy(F.desc("seq"), "phrase")
    return found.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= cap).select("polarity", "phrase", "seq")


def phrase_arrays(lexicon: DataFrame) -> DataFrame:
    """One row: hate and safe, arrays in order of seq. The lexicon is capped, so the row is small."""
    side = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("polarity") == name, F.struct("seq", "phrase")))), lambda x: x["phrase"])
    return lexicon.agg(side("hate").alias("hate"), side("safe").alias("safe"))


#: Bytes of phrases' heads, which bound the states of an automaton (a few hundred bytes each), and of whole phrases, that one
#: broadcast holds, on average; and broadcasts that one pass over the texts uses. A larger lexicon is split by phrase.
HEADS, WHOLE, TOGETHER = 400_000, 32_000_000, 4


def _matcher(spark: SparkSession, phrases: DataFrame) -> Callable[[str], Column] | None:
    """A function of a text in lower case: array(hate phrases, safe phrases) that occur in it. None if there are no phrases."""
    sides: dict[bytes, list[int]] = {}
    for r in phrases.collect():  # a part of the lexicon of bounded size
        sides.setdefault(r["phrase"].encode(), [0, 0])[r["polarity"] != "hate"] = 1
    if not sides:
        return None
    sent = spark.sparkContext.broadcast((Automaton(list(sides)), np.array(list(sides.values()), np.int64)))

    @F.arrow_udf("array<bigint>")
    def counts(texts: pa.Array) -> pa.Array:
        automaton, side = sent.value
        texts = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts
        cuts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        text, phrase = automaton.occurrences(np.frombuffer(texts.buffers()[2] or b"", np.uint8), cuts)
        each = np.stack([np.bincount(text, side[phrase, k], len(texts)) for k in (0, 1)], axis=1).astype(np.int64)
        return pa.FixedSizeListArray.from_arrays(pa.array(each.reshape(-1)), 2).cast(pa.list_(pa.int64()))

    return counts


def phrase_hits(comments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(comment_id, n_hate_hits, n_safe_hits), one row per comment, for lexicons too large for an array. comments: comment_id, text.

    How many different phrases of each side occur in the text in lower case, null texts being empty. lexicon: polarity (hate or
    safe), phrase; repeated rows count once, blank and null phrases never occur. An automaton of the phrases reads each text
    once; texts are neither moved nor cut up. The lexicon is counted first; one too large for a broadcast is split by phrase,
    and one too large for a task's memory is read in several passes, between which texts and counts are written.
    """
    spark = comments.sparkSession
    known = lexicon.select("polarity", F.col("phrase").cast("string").alias("phrase")).filter(F.col("polarity").isin("hate", "safe") & ~F.col("phrase").rlike(r"(?U)^\s*$")).distinct()
    size = F.octet_length("phrase")
    heads, whole = known.agg(F.sum(F.least(size, F.lit(DEPTH))), F.sum(size)).first()
    parts = max((heads or 0) // HEADS, (whole or 0) // WHOLE) + 1
    rows = comments.select("comment_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.lit(0).cast("long").alias("n_hate_hits"), F.lit(0).cast("long").alias("n_safe_hits"))
    for part in range(parts):
        found = _matcher(spark, known.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part))
        if found is not None:
            rows = rows.withColumn("found", found("text"))
            rows = rows.select("comment_id", "text", *((F.col(n) + F.get("found", k)).alias(n) for k, n in enumerate(("n_hate_hits", "n_safe_hits"))))
        if part % TOGETHER == TOGETHER - 1 and part + 1 < parts:
            rows = scratch_table(rows, "phrase-hits")
    return rows.drop("text")
