"""Mix sources to target weights, in words.

Every document gets a hash-random key. Keys are uniform, so equal key ranges hold equal shares of a source: rows are
dealt by (source, range), sorted by key inside, and prefix sums come in two steps, first over the ranges of a source
(a small table), then inside each range. No task needs a whole source, however large. The running sum is cut at the
source's exact budget; budgets beyond the source's size take whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights by the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times over.
MAX_EPOCHS = 3
#: Documents in a key range, on average; ranges whose sums are added up together; and rows of targets that are broadcast (past
#: it Spark joins by shuffle). Results do not depend on these.
RANGE_ROWS, TOP, BROADCAST_ROWS = 2_000, 1_000, 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_rows, target): all sizes dealt out by weight, none above max_epochs x its size.

    Sources are weighted by code point order, null last. What a capped source leaves goes to the others by weight,
    until none is above: sources in order of cap per weight, the first k capped, where k is the smallest number
    at which the next one stays within its cap. It works on one row per source, all of them in one task: three numbers and
    a name each, so that a million sources are well within its reach. Where all sizes are 0, targets are 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    ranked = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = ranked.withColumn("level", left / F.sum("weight").over(rest))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    water = F.first(fits, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(water * F.col("weight"), F.col("cap").cast("double"))
    return level.select("source", "source_size", "n_rows", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per row of docs: doc_id, text_key, source, size, source_size, target, taken.

    docs: doc_id, text, source; other columns are ignored. size counts words; taken is how many words the mix takes,
    over all epochs: each source's sum is its target rounded down, since the document at the cut gives a part of its
    words. The random key hashes doc_id (then by text), so reruns agree; rows that are equal in both take part each
    on its own, in any order. Null ids, texts and sources are values like others; texts without words take nothing. Texts
    may have any length. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = common.text_or_empty(docs)
    text_key = F.xxhash64(text)
    key = F.md5(F.concat_ws(":", F.lit("mix"), docs["doc_id"].cast("string")))
    sizes = common.written(
        docs.select(docs["doc_id"].alias("doc_id"), text_key.alias("text_key"), docs["source"].alias("source"), word_count(text).alias("size"), key.alias("key")),
        "sizes",
    )
    targets = common.written(source_targets(sizes, weights, max_epochs).withColumn("ranges", F.ceil(F.col("n_rows") / RANGE_ROWS)), "targets")
    per_source = common.broadcast_if_small(targets, targets.count(), BROADCAST_ROWS)
    share = F.expr("shiftrightunsigned(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * ranges, 32)")  # the range that the key falls in
    placed = sizes.join(per_source, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("range", share)
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    # Sums over the ranges of a source in two steps, so that no window holds more than a row for each RANGE_ROWS * TOP documents.
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("top", F.floor(F.col("range") / TOP))
    tops = sums.groupBy("source", "top").agg(F.sum("in_range").alias("in_top"))
    high = tops.select(F.col("source").alias("of"), F.col("top").alias("nth"), F.coalesce(F.sum("in_top").over(until(Window.partitionBy("source").orderBy("top"))), F.lit(0)).alias("high"))
    inner = until(Window.partitionBy("source", "top").orderBy("range"))
    low = sums.select("source", "range", "top", F.coalesce(F.sum("in_range").over(inner), F.lit(0)).alias("low"))
    both = low.join(high, low["source"].eqNullSafe(high["of"]) & (low["top"] == high["nth"]))
    starts = both.select("of", F.col("range").alias("at"), (F.col("low") + F.col("high")).alias("start"))
    # A row for each RANGE_ROWS documents; Spark decides by its size how to join.
    located = placed.join(starts, placed["source"].eqNullSafe(starts["of"]) & (placed["range"] == starts["at"]))
    dealt = located.repartitionByRange(common.partitions(spark), "source", "range")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least("size", rest - F.col("ahead")))
    done = dealt.withColumn("ahead", ahead).withColumn("epochs", epochs)
    return done.select("doc_id", "text_key", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: a row of docs for each epoch that takes it, with epoch (from 0) and n_words, the words to take.

    The last row of a source may take fewer words than its text has; rows that take none are left out. Columns of
    docs named epoch or n_words are replaced.
    """
    shares = mix(docs, weights, max_epochs).filter("taken > 0")
    named = F.coalesce("doc_id", F.lit(-(2**63))).alias("id_key"), "text_key"
    shares = shares.groupBy(*named).agg(F.sort_array(F.collect_list(F.struct("taken", "size"))).alias("shares"))
    rank = Window.partitionBy("id_key", "text_key").orderBy("text_key")
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(docs["doc_id"], F.lit(-(2**63))).alias("id_key"), F.xxhash64(common.text_or_empty(docs)).alias("text_key"))
    joined = packed.join(shares, ["id_key", "text_key"]).withColumn("nth", F.row_number().over(rank))  # of equal rows, each has one share
    each = joined.withColumn("share", F.get("shares", F.col("nth") - 1)).filter(F.col("share").isNotNull())
    rounds = each.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("share.taken") / F.col("share.size")).cast("int") - 1)))
    words = F.least(F.col("share.size"), F.col("share.taken") - F.col("epoch") * F.col("share.size"))
    return rounds.select("row.*", F.col("epoch").alias("_epoch"), words.alias("_n_words")).drop("epoch", "n_words").withColumnsRenamed({"_epoch": "epoch", "_n_words": "n_words"})


def op8_mix_sources(spark, sf_dir):
    done = mix(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return done.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix:' || doc_id) AS key FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3 AS cap FROM per
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM ranked
), level AS (
  SELECT *, ((SELECT sum(source_size) FROM levels) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM levels
), water AS (
  SELECT level AS water, k AS first FROM level WHERE level * weight <= cap ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN k >= first THEN water * weight ELSE cap::DOUBLE END AS target FROM level, water
), ahead AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - ahead)) END::BIGINT AS taken
FROM ahead
"""
