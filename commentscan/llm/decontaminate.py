"""Benchmark decontamination: short test items inside long documents, by MinHash containment search.

A MinHash of a whole document says nothing about a short item inside it, so the search is one-sided. Items are
partitioned by size, and each gets a bottom-m sketch: the m smallest hashes of its shingles, m being the number of
which a document that contains the threshold's share of the item must have one; nothing is lost. As that holds for any m of
them, hashes of shingles that many items share come last, by powers of two of their number: a passage that a whole benchmark
and a third of all documents hold makes no candidates of items that have shingles of their own. Sizes with one m are a
partition, with its own ceiling, the largest hash of its sketches. Of a document's hashes only those are looked up that
lie below the ceiling of some partition whose items can fit in it, and whose bit is set in a bitmap of all sketches. Where
one is found, shingles are counted exactly, as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 5
CONTAINMENT = 0.8
#: Sketch, candidate and shingle rows that may be broadcast; past it Spark joins by shuffle and splits hot shingles.
BROADCAST_ROWS = 500_000
#: log2 of the bits of the bitmap of sketches, 16 a row within these bounds; past the upper one a second bitmap is broadcast.
BITS, MORE_BITS = 18, 22
#: Partitions that have a ceiling of their own (larger ones share the last).
CEILINGS = 64


def words_of(text: Column) -> Column:
    """Words in ASCII lower case; none for an empty text."""
    none = F.array().cast("array<string>")
    return common.let(
        F.btrim(common.ascii_lower(text), F.lit(common.WHITE)), lambda t: F.when(t == "", none).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))
    )


def _each_shingle(words: Column, make) -> Column:
    """make(five elements) for each run of five; null for fewer."""

    def made(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WORDS)
        return F.when(F.size(w) >= WORDS, F.transform(starts, lambda i: make([F.get(w, i + k) for k in range(WORDS)])))

    return common.let(words, made)


def shingle_hashes(words: Column) -> Column:
    """Words are hashed once, and shingles by the hashes of their words."""
    return _each_shingle(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.xxhash64(*h))


def shingle_texts(words: Column) -> Column:
    return F.array_distinct(_each_shingle(words, lambda w: F.concat_ws(" ", *w)))


def item_sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """items: item_key, words. Returns (h, item_key, n_shingles, part), the bottom-m sketch of each item; part is m.

    The order is that of hashes among shingles that about as many items share, those of fewer items first.
    """
    hashes = F.array_distinct(shingle_hashes(F.col("words")))
    hashed = items.select("item_key", hashes.alias("hashes")).select("item_key", F.size("hashes").alias("n_shingles"), F.explode("hashes").alias("h"))
    shared = hashed.groupBy("h").agg(F.floor(F.log2(F.count("*"))).alias("shared"))
    m = (F.col("n_shingles") - F.ceil(F.col("n_shingles") * containment - 1e-9) + 1).cast("int")
    place = F.row_number().over(Window.partitionBy("item_key").orderBy("shared", "h"))
    ranked = hashed.join(shared, "h").select("h", "item_key", "n_shingles", m.alias("part"), place.alias("place"))
    return ranked.filter(F.col("place") <= F.col("part")).drop("place")


def _ceiling(sketches: DataFrame, n_words: Column, containment: float) -> Column:
    """The largest hash of a document of so many words that may be in a sketch of an item that fits in it."""
    parts = sketches.groupBy(F.least("part", F.lit(CEILINGS)).alias("part")).agg(F.min("n_shingles").alias("least"), F.max("h").alias("ceiling"))
    ceiling = F.lit(-(2**63)).cast("long")
    for r in parts.orderBy("part").collect():  # CEILINGS rows at most
        ceiling = F.greatest(ceiling, F.when(n_words - (WORDS - 1) >= r["least"] * containment - 1e-9, F.lit(r["ceiling"])))
    return ceiling


def _in_bitmap(sketches: DataFrame, h: Column, log_bits: int) -> Column:
    """Whether a hash may be in some sketch."""
    slot = lambda h: h.bitwiseAND((1 << log_bits) - 1)
    words = sketches.groupBy(F.shiftright(slot(F.col("h")), 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    bitmap = [0] * (1 << (log_bits - 6))
    for r in words.collect():  # a row for each word of the bitmap
        bitmap[r["at"]] = r["bits"]
    bits = F.from_json(F.lit(str(bitmap)), "array<bigint>")
    return F.getbit(F.get(bits, F.shiftright(slot(h), 6).cast("int")), h.bitwiseAND(63).cast("int")) == 1


def _looked_up(mine: DataFrame, sketches: DataFrame, containment: float, n_sketch: int) -> DataFrame:
    """(id_key, text_key, n_words, h): the documents' shingle hashes that may be in a sketch.

    Words are hashed once a document; the runs of five are put together, judged and mostly dropped in compiled code, row by
    row and without a copy of the document's hashes.
    """
    hashed = mine.select("id_key", "text_key", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    sized = hashed.select("*", F.size("hashes").alias("n_words")).withColumn("ceiling", _ceiling(sketches, F.col("n_words"), containment))
    starts = F.when(F.col("n_words") >= WORDS, F.sequence(F.lit(0), F.col("n_words") - WORDS))
    # Outer, as Spark would else work out the hashes once more, to ask beforehand whether there are any starts.
    each = sized.select("*", F.explode_outer(starts).alias("i")).filter("i is not null")
    runs = each.select("id_key", "text_key", "n_words", "ceiling", F.xxhash64(*(F.get("hashes", F.col("i") + k) for k in range(WORDS))).alias("h"))
    log_bits = min(max(BITS, (16 * n_sketch).bit_length()), MORE_BITS)
    found = runs.filter((F.col("h") <= F.col("ceiling")) & _in_bitmap(sketches, F.col("h"), log_bits)).drop("ceiling")
    return common.may_be_in(found, "h", sketches) if 16 * n_sketch > 1 << MORE_BITS else found


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of a document and an item of which it contains at least the given share of five-word shingles.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Returns doc_id, text_key, item_id,
    n_shingles (distinct, of the item), n_found and containment. Words are in ASCII lower case and parted by white
    space. Null and empty texts, and items of fewer than five words, have no shingles and match nothing; texts may be of
    any length. Equal rows of docs give one pair; rows that share a doc_id with different texts give one pair each; a null
    id of a document or an item is a value like others. Equal items count as one; items that share an item_id with
    different texts are judged each on its own. Without documents or items there are no pairs.
    """
    item_text = common.text_or_empty(benchmark)
    named = benchmark.select(benchmark["item_id"].alias("item_id"), item_text.alias("text"), F.xxhash64(benchmark["item_id"], item_text).alias("item_key"))
    items = common.written(named.dropDuplicates(["item_key"]).select("item_key", "item_id", words_of(F.col("text")).alias("words")), "benchmark-words")
    sketches = common.written(item_sketches(items, containment), "benchmark-sketches")
    n_sketch = sketches.count()
    text = common.text_or_empty(docs)
    mine = docs.select(F.coalesce(docs["doc_id"], F.lit(-(2**63))).alias("id_key"), docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    looked_up = _looked_up(mine, sketches, containment, n_sketch).join(common.broadcast_if_small(sketches, n_sketch, BROADCAST_ROWS), "h")
    fits = F.col("n_words") - (WORDS - 1) >= F.col("n_shingles") * containment - 1e-9
    candidates = common.written(looked_up.filter(fits).select("id_key", "text_key", "item_key").distinct(), "candidates")

    texts = common.written(items.select("item_key", F.explode(shingle_texts(F.col("words"))).alias("shingle")), "benchmark-shingles")
    sizes = texts.groupBy("item_key").agg(F.count("*").alias("n_shingles"))
    named = items.select("item_key", "item_id").join(sizes, "item_key")
    keys = common.written(candidates.select("id_key", "text_key").distinct(), "suspects")
    suspects = mine.join(common.broadcast_if_small(keys, keys.count(), BROADCAST_ROWS), ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"])
    held = suspects.select("id_key", "doc_id", "text_key", F.explode(shingle_texts(words_of(F.col("text")))).alias("shingle"))
    found = held.join(common.broadcast_if_small(texts, texts.count(), BROADCAST_ROWS), "shingle").groupBy("id_key", "doc_id", "text_key", "item_key").agg(F.count("*").alias("n_found"))
    judged = found.join(candidates, ["id_key", "text_key", "item_key"], "left_semi").join(named, "item_key").withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return judged.filter(F.col("containment") >= containment).select("doc_id", "text_key", "item_id", "n_shingles", "n_found", "containment")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs that contain no item."""
    pairs = contaminated(docs, benchmark, containment)
    gone = pairs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id_key"), "text_key").distinct()
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(docs["doc_id"], F.lit(-(2**63))).alias("id_key"), F.xxhash64(common.text_or_empty(docs)).alias("text_key"))
    return packed.join(gone, ["id_key", "text_key"], "left_anti").select("row.*")


def op5_decontaminate(spark, sf_dir):
    pairs = contaminated(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")), common.table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_shingles", "n_found", "containment")


OP5_SQL = """
WITH words AS (
  SELECT 'doc' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'item', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
), items AS (
  SELECT id AS item_id, shingle, count(*) OVER (PARTITION BY id) AS n_shingles FROM shingles WHERE kind = 'item'
)
SELECT *, n_found / n_shingles AS containment
FROM (SELECT d.id AS doc_id, i.item_id, i.n_shingles, count(*) AS n_found
      FROM shingles d JOIN items i ON d.shingle = i.shingle WHERE d.kind = 'doc' GROUP BY d.id, i.item_id, i.n_shingles)
WHERE n_found / n_shingles >= 0.8
"""
