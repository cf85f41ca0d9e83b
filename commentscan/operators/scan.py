"""Score, second opinion, overrides, decisions, and what is new.

Columns that these functions add replace columns of that name; other columns of the comments pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentscan.config import BAND, ScanConfig
from commentscan.functions import lexicon as L
from commentscan.functions import text as T
from commentscan.operators.models import TableModel

#: Text to a score, or to a struct of score and error (see `guarded`); or a model of tables.
Model = Callable[[Column], Column] | TableModel
#: As a model; a null score is no opinion. A column function gets a null text in rows that are not asked, so a Python function skips those;
#: a model of tables gets the rows that are asked alone.
Opinion = Model
# The keyword opinion's words and scores.
OPINION_WORDS, OPINION_YES, OPINION_NO = ("fuck", "kill", "hate"), 0.85, 0.15


def no_model(text: Column) -> Column:
    return L.single(0)


def borderline(score: Column, threshold: float) -> Column:
    """Within BAND below the threshold, both ends included, in single precision."""
    top = L.single(threshold)
    return score.between((top - L.single(BAND)).cast("float"), top)


def keyword_label(text: Column) -> Column:
    return F.when(T.let(F.lower(text), lambda t: F.exists(F.array(*map(F.lit, OPINION_WORDS)), lambda w: F.contains(t, w))), "hate").otherwise("not_hate")


def keyword_opinion(text: Column) -> Column:
    said = F.when(keyword_label(text) == "hate", L.single(OPINION_YES)).otherwise(L.single(OPINION_NO))
    return F.when(text.isNotNull(), said)


def guarded(score: Callable[[str], float]) -> Model:
    """A Python function from a text to a score as a model or opinion; what it raises fails its own row only."""

    @F.pandas_udf("score float, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                return (None if text is None else float(score(text))), None
            except Exception as e:  # whatever a plugged-in function raises
                return None, str(e) or type(e).__name__

        return pd.DataFrame([one(t) for t in texts], columns=["score", "error"]).astype({"score": "float32", "error": object})

    return run


def _answered(df: DataFrame, by: Model, text: Column) -> DataFrame:
    """df with _score, which is null where the answer has none, and with error filled where it has one."""
    if isinstance(by, TableModel):
        return by.answers(df).withColumn("error", F.coalesce("error", "_error")).drop("_error")
    both = df.withColumn("_answer", by(text))
    if both.schema["_answer"].dataType.typeName() == "struct":
        both = both.withColumn("error", F.coalesce("error", "_answer.error")).withColumn("_score", F.col("_answer.score"))
    else:
        both = both.withColumn("_score", F.col("_answer"))
    return both.drop("_answer")


def _raised(score: str = "_score") -> Column:
    """The larger of the score and an answer; no answer, or none that is a number, counts 0."""
    return F.greatest("score", F.coalesce(T.clamp(F.col(score), 0, 1), L.single(0)))


def parse_opinion(json: Column) -> Column:
    """struct(label, score) of an opinion in JSON: unknown and 0 where missing or malformed; the score held to 0..1."""
    read = F.from_json(json, "label string, score string")
    score = T.clamp(F.coalesce(read["score"].try_cast("float"), L.single(0)), 0, 1)
    return F.struct(F.coalesce(read["label"], F.lit("unknown")).alias("label"), score.alias("score"))


def _with_phrases(comments: DataFrame, phrases: DataFrame) -> tuple[DataFrame, Column, Column]:
    """comments beside the one row of phrase_arrays, and its two arrays."""
    hate, safe = T.unused("_hate", comments), T.unused("_safe", comments)
    return comments.crossJoin(F.broadcast(phrases.select(F.col("hate").alias(hate), F.col("safe").alias(safe)))), F.col(hate), F.col(safe)


def with_rule_scores(comments: DataFrame, phrases: DataFrame, model: Model = no_model) -> DataFrame:
    """comments with hate_hits, safe_hits, error (of the model, else null) and score, the larger of lexicon and model. phrases: the one row of phrase_arrays.

    A model that fails on a row counts 0 there, as does one that has no score.
    """
    rest = comments.drop("hate_hits", "safe_hits", "error", "score")
    both, hate, safe = _with_phrases(rest, phrases)
    text = F.col("text")
    found = both.select(*(F.col(f"`{c}`") for c in rest.columns), L.hits_and_score(text, hate, safe).alias("score"))
    error = F.lit(None).cast("string").alias("error")
    ruled = found.select(*(F.col(f"`{c}`") for c in rest.columns), "score.hate_hits", "score.safe_hits", error, F.col("score.score").alias("score"))
    return ruled if model is no_model else _answered(ruled, model, text).withColumn("score", _raised()).drop("_score")


def with_second_opinion(scored: DataFrame, config: ScanConfig, opinion: Opinion | None) -> DataFrame:
    """Adds asked, and raises the score of borderline rows to the opinion's. Only their texts reach the opinion.

    A column function answers in the same pass. A model of tables gets the borderline rows dealt anew over all tasks, since
    an answer may take seconds; the others never leave the JVM.
    """
    on = bool(opinion and config.use_opinion)
    marked = scored.withColumn("asked", borderline(F.col("score"), config.threshold) & F.lit(on))
    if not on:
        return marked
    if isinstance(opinion, TableModel):
        # Filters that ask for a row number stay above it, so scores are worked out once a row and side, not once more to filter by them.
        row = T.unused("_row", marked)
        numbered = marked.withColumn(row, F.monotonically_increasing_id())
        either = lambda asked: numbered.filter(asked & (F.col(row) >= 0)).drop(row)
        band = either(F.col("asked")).repartition(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        said = _answered(band, opinion, F.col("text")).withColumn("score", _raised()).drop("_score")
        return either(~F.col("asked")).unionByName(said.select(*marked.columns))
    said = _answered(marked, opinion, F.when(F.col("asked"), F.col("text")))
    return said.withColumn("score", F.when(F.col("asked"), _raised()).otherwise(F.col("score"))).drop("_score")


def with_decision(scored: DataFrame, threshold: float) -> DataFrame:
    """Adds override and flagged: a hate phrase flags, else a safe phrase clears, else the threshold decides. No score, or a
    failure (a column of the comments, where there is one): not flagged."""
    override = F.when(F.size("hate_hits") > 0, "hate").when(F.size("safe_hits") > 0, "safe")
    flagged = F.when(override == "hate", True).when(override == "safe", False).otherwise(F.coalesce(F.col("score") >= L.single(threshold), F.lit(False)))
    failed = F.col("failure").isNotNull() if "failure" in scored.columns else F.lit(False)
    return scored.withColumn("override", override).withColumn("flagged", flagged & ~failed)


def decide(comments: DataFrame, phrases: DataFrame, config: ScanConfig | None = None, model: Model | None = None, opinion: Opinion | None = None) -> DataFrame:
    """comments (comment_id, text, ...) with score, asked, error, override and flagged.

    A null text scores 0; a null or repeated id is a row like others. A model or an opinion that fails on a row counts 0 there and
    leaves its message in error; rules and overrides decide all the same. A comment that its source could not read has a
    message in the column failure, if there is one: it is not flagged. No comments give no rows.
    """
    config = (config or ScanConfig()).clamped()
    scored = with_rule_scores(comments, phrases, model if model and config.use_model else no_model)
    return with_decision(with_second_opinion(scored, config, opinion), config.threshold)


def decision_log(decisions: DataFrame) -> DataFrame:
    """decisions with line, what the log says of each: the decision, with what failed on the way to it, or why there is none."""
    note = F.when(F.col("override").isNotNull(), F.concat(F.lit(" override="), F.col("override"))).otherwise("")
    missed = F.when(F.col("error").isNotNull(), F.concat(F.lit(" error="), F.col("error"))).otherwise("")
    shown = F.concat(F.lit(" text='"), T.preview(F.coalesce("text", F.lit(""))), F.lit("'"))
    line = F.concat(F.lit("scan:decision score="), T.two_places(F.col("score")), F.lit(" flagged="), F.col("flagged").cast("string"), note, missed, shown)
    if "failure" in decisions.columns:
        line = F.when(F.col("failure").isNull(), line).otherwise(F.concat(F.lit("scan:error "), "failure"))
    return decisions.withColumn("line", line)


def quick_check(comments: DataFrame, phrases: DataFrame) -> DataFrame:
    """comments with score, the user score, and verdict at a fixed cut, without model, opinion or overrides."""
    both, hate, safe = _with_phrases(comments, phrases)
    scored = both.withColumn("score", L.user_score(F.col("text"), hate, safe))
    judged = scored.withColumn("verdict", F.when(F.col("score") >= L.single(0.8), "Harmful").otherwise("Okay"))
    return judged.select(*(F.col(f"`{c}`") for c in comments.drop("score", "verdict").columns), "score", "verdict")


def text_key(text: Column) -> Column:
    """Stored texts have separators blanked, so both sides do; they meet by a 256-bit hash, and no text is moved to be compared."""
    return F.sha2(T.without_separators(text), 256)


def _known_keys(known: tuple[DataFrame, ...], name: str) -> DataFrame:
    keys = known[0].select(text_key(F.col("text")).alias(name))
    for table in known[1:]:
        keys = keys.unionByName(table.select(text_key(F.col("text")).alias(name)))
    return keys.distinct()


def not_known(found: DataFrame, *known: DataFrame) -> DataFrame:
    """Rows of `found` whose text no known table holds, repeats and null texts kept; one join over all known tables."""
    if not known:
        return found
    key = T.unused("_key", found)
    return found.withColumn(key, text_key(F.col("text"))).join(_known_keys(known, key), key, "left_anti").drop(key)


def with_fresh(decisions: DataFrame, *known: DataFrame) -> DataFrame:
    """decisions with fresh: flagged, and not held by a known table (null texts are held by none). One join, to which rows that
    are not flagged bring keys of their own, so that none of them meet in one task."""
    if not known:
        return decisions.withColumn("fresh", F.col("flagged"))
    key, held = T.unused("_key", decisions), T.unused("_held", decisions)
    mine = F.when(F.col("flagged") & F.col("text").isNotNull(), text_key(F.col("text"))).otherwise(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    both = decisions.withColumn(key, mine).join(_known_keys(known, key).withColumn(held, F.lit(True)), key, "left")
    return both.withColumn("fresh", F.col("flagged") & F.col(held).isNull()).drop(key, held)


def scan_stats(decisions: DataFrame, *by: str) -> DataFrame:
    return decisions.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("flagged").alias("flagged"), F.count_if("asked").alias("asked"))
