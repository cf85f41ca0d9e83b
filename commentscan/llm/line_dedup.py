"""Line dedup: keep each repeated line only in the first document that holds it.

Lines become 128-bit hashes, which are range-partitioned with a secondary sort by document and position; one
streaming pass over each range sees the first document of a line before all others. What comes back is a
run-length coded bitmap for each document that loses lines, never text.

A line that many documents share would fill one range. A frequent-items sketch names beforehand the lines that would make
up a quarter of a range or more; their first documents come from a map-side combined minimum and are broadcast instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_KEY = 10
#: A line is hot from 1/HOT_SHARE of a range's rows on, so there are HOT_SHARE hot lines a range at most. Sketches track
#: SKETCH_SHARE items for each of these, up to a bound on their memory; beyond it (16,384 ranges) the share of a range grows.
HOT_SHARE, SKETCH_SHARE, MAX_SKETCH = 4, 8, 1 << 19


def lines_of(text: Column) -> Column:
    """All lines of a text; an empty text is one empty line."""
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return common.ascii_lower(F.btrim(line, F.lit(common.WHITE)))


def _hashed(docs: DataFrame) -> DataFrame:
    text = common.text_or_empty(docs)
    lines = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= MIN_KEY)
    return keyed.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


def hot_keys(lines: DataFrame) -> list[int]:
    """Hashes that hold at least 1/HOT_SHARE of the rows of an even range, give or take half of that."""
    most = HOT_SHARE * max(64, common.partitions(lines.sparkSession))
    items = min(MAX_SKETCH, 1 << (most * SKETCH_SHARE - 1).bit_length())
    most = min(most, items // SKETCH_SHARE)
    row = lines.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {most}, {items})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] * most >= row["n"] and x["count"] > 1000]


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos) of each line whose hash an earlier document holds."""
    spark = lines.sparkSession
    n, hot = common.partitions(spark), hot_keys(lines)
    # Hashes are uniform, so ranges of equal width are even; no sampling pass is needed to find their bounds.
    part = F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(h1, 33) * {n}L, 31) as int)")
    cold = (lines.filter(~F.col("h1").isin(hot)) if hot else lines).withColumn("part", part).repartitionById(n, F.col("part"))
    order = Window.partitionBy("part", "h1", "h2").orderBy(F.asc_nulls_last("doc_id"), "text_key", "pos")
    first = F.first("doc_id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gone = cold.withColumn("first", first).filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text_key", "pos")
    if hot:
        mine = lines.filter(F.col("h1").isin(hot))
        firsts = mine.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        # HOT_SHARE rows a range at most.
        gone = gone.unionByName(mine.join(F.broadcast(firsts), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text_key", "pos"))
    return gone


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """One row for each document that loses lines: (doc_id, text_key, n_dropped, dropped_runs).

    docs: doc_id, text; other columns are ignored, whatever their names. dropped_runs codes the keep bitmap by its
    zeros: sorted runs of dropped line numbers (first, last), from 0; all other lines stay. A document without a
    row keeps all its lines. text_key is the hash of the text, since rows that share a doc_id may differ: such
    rows count as one document, so lines that only they share stay, and each row has a bitmap of its own. A null
    doc_id counts as the largest. A null text is empty, and an empty text is one empty line. Texts may have any number of
    lines. An empty table gives no rows.
    """
    gone = dropped_lines(common.written(_hashed(docs), "line-hashes"))
    at = gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    before = lambda x, i: F.get(F.col("at"), i - 1)
    after = lambda x, i: F.get(F.col("at"), i + 1)
    firsts = F.filter("at", lambda x, i: before(x, i).isNull() | (before(x, i) < x - 1))
    lasts = F.filter("at", lambda x, i: after(x, i).isNull() | (after(x, i) > x + 1))
    runs = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return at.select("doc_id", "text_key", F.size("at").cast("long").alias("n_dropped"), runs.alias("dropped_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs as struct `row`, with n_lines, n_dropped and kept_text."""
    text = common.text_or_empty(docs)
    packed = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), text.alias("body"), F.xxhash64(text).alias("body_key"))
    both = packed.join(bitmaps, packed["id"].eqNullSafe(bitmaps["doc_id"]) & (packed["body_key"] == bitmaps["text_key"]), "left")
    runs = F.coalesce("dropped_runs", F.expr("array()").cast(bitmaps.schema["dropped_runs"].dataType))
    lines = lines_of(F.col("body"))
    stays = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1)),
        F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size("lines"))),
        lambda a, b: F.slice("lines", a + 1, b - a),
    )
    kept = F.when(F.col("n_dropped").isNull(), F.col("body")).otherwise(F.array_join(F.flatten(stays), "\n"))
    return both.withColumn("lines", lines).select(
        "row", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept_text")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    return apply_bitmaps(docs, line_bitmaps(docs))


def op1_line_dedup(spark, sf_dir):
    done = dedup_lines(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents)
), firsts AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id > f.first, false) AS gone
  FROM lines l LEFT JOIN firsts f ON l.key = f.key AND length(l.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
