"""Column functions for text and numbers; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD, FIELD = "\x01", "\x02"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: spelled out inside a lambda, Spark would compute it at each step."""
    return F.get(F.transform(F.array(value), body), 0)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the tables has."""
    while any(name.lower() == c.lower() for df in frames for c in df.columns):
        name += "_"
    return name


def trim_all(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+$", "")  # a run inside the text is tried once, not at each of its blanks


def blank_to_null(text: Column) -> Column:
    return F.when(~text.rlike(r"(?U)^\s*$"), text)


def without_separators(text: Column, both: bool = True) -> Column:
    """Record separators, and field separators if both, become spaces."""
    return F.translate(text, RECORD + FIELD if both else RECORD, "  " if both else " ")


def contains_phrase(lowered: Column, phrase: Column | str) -> Column:
    return F.contains(lowered, phrase if isinstance(phrase, Column) else F.lit(phrase))


def clamp(value: Column, low: float, high: float) -> Column:
    """NaN counts as 0; null stays null, where `least` and `greatest` would skip it."""
    kind = "float"
    held = F.greatest(F.lit(low).cast(kind), F.least(F.lit(high).cast(kind), F.nanvl(value.cast(kind), F.lit(0.0).cast(kind))))
    return F.when(value.isNotNull(), held)


def json_unescape(text: Column) -> Column:
    r"""Resolve \" \n \r \t, then runs of \uXXXX as UTF-16. \\ and \/ stay. A run with a lone surrogate stays escaped."""
    plain = text
    for escape, char in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        plain = F.replace(plain, F.lit(escape), F.lit(char))
    run = r"((?:\\u[0-9a-fA-F]{4})+)"
    lone = r"(?i)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f])|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}"
    decoded = F.transform(
        F.regexp_extract_all(plain, F.lit(run), 1),
        lambda r: F.when(r.rlike(lone), r).otherwise(F.decode(F.unhex(F.regexp_replace(r, r"\\u", "")), "UTF-16BE")),
    )
    between = F.split(plain, run, -1)
    whole = F.array_join(F.zip_with(between, decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(plain.contains("\\u"), whole).otherwise(plain)


def preview(text: Column, n: int = 40) -> Column:
    return F.substring(text, 1, n)


def two_places(score: Column) -> Column:
    return F.format_string("%.2f", score.cast("double"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def length_feature(text: Column, longest: int = 512) -> Column:
    """Share of the longest length, at most 1."""
    return (F.least(utf16_length(text), F.lit(longest)) / longest).cast("float")


def count_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def log_line(millis: Column, message: Column) -> Column:
    return F.concat(millis.cast("string"), F.lit(":"), F.translate(message, "\n", " "))


def log_message(line: Column) -> Column:
    """What follows the first colon; the whole line if there is none."""
    after = F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)
    return trim_all(F.when(line.contains(":"), after).otherwise(line))


def millis_to_timestamp(millis: Column) -> Column:
    """Null, for never, where it is 0."""
    return F.when(millis != 0, F.timestamp_millis(millis))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(done, total) / total)


def report_text(comment: Column, source_url: Column) -> Column:
    return F.concat(F.lit("Hateful comment report\n\n"), comment, F.lit("\n\nSource: "), F.coalesce(source_url, F.lit("unknown")))


def shortcode(url: Column) -> Column:
    """The post's code in a post or reel URL; null for other URLs."""
    return F.nullif(F.regexp_extract(url, r"/(p|reel)/([A-Za-z0-9_-]+)/?", 2), F.lit(""))
