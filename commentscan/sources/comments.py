"""Comments from pasted lists, HTML pages, JSON comment pages and registered sources.

All results have comment columns: source_url, page_no, pos, text. Order is explicit: (page_no, pos) within a URL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentscan.config import MONITORED_PER_URL, PER_URL
from commentscan.functions import text as T
from commentscan.sources.scratch import scratch_table

PAYLOAD = r"[\x01\n]"
LINES = r"\r\n|\n|\r"
PAGE_SCHEMA = """data struct<shortcode_media: struct<edge_media_to_parent_comment: struct<
  edges: array<struct<node: struct<text: string>>>, page_info: struct<has_next_page: boolean, end_cursor: string>>>>,
graphql struct<shortcode_media: struct<edge_media_to_parent_comment: struct<
  edges: array<struct<node: struct<text: string>>>, page_info: struct<has_next_page: boolean, end_cursor: string>>>>"""


def split_comments(df: DataFrame, column: str = "payload", separator: str = PAYLOAD) -> DataFrame:
    """df with pos and text: the trimmed, non-empty parts of a payload, in order, repeats included."""
    parts = df.select("*", F.posexplode(F.split(T.trim_all(F.col(column)) if separator == LINES else F.col(column), separator, -1)).alias("pos", "part"))
    return parts.withColumn("text", T.trim_all(F.col("part"))).filter("text <> ''").drop("part")


def first_per_url(df: DataFrame, limit: int | Column | None, *order: str) -> DataFrame:
    """The first `limit` rows of each source_url; all rows, unranked, if it is None."""
    if limit is None:
        return df
    rank = T.unused("_rank", df)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy("source_url").orderBy(*order))).filter(F.col(rank) <= limit).drop(rank)


def comments_from_html(pages: DataFrame, limit: int | None = PER_URL) -> DataFrame:
    """pages (url, html). Every quoted "text" value, up to the next quote, unescaped and trimmed; the first `limit` of a page."""
    found = F.regexp_extract_all("html", F.lit(r'(?s)"text":"(.*?)"'), 1)
    each = pages.select(F.col("url").alias("source_url"), F.lit(0).alias("page_no"), F.posexplode(found).alias("pos", "raw"))
    texts = each.select("source_url", "page_no", "pos", T.trim_all(T.json_unescape(F.col("raw"))).alias("text")).filter("text <> ''")
    return first_per_url(texts, limit, "page_no", "pos")


def parsed_pages(pages: DataFrame, shapes: tuple[str, ...] = ("data", "graphql")) -> DataFrame:
    """pages (shortcode, page_no or cursor, json) with ok, has_next, end_cursor and texts; malformed JSON, or of another shape, is not ok."""
    place = "page_no" if "page_no" in pages.columns else "cursor"
    read = pages.withColumn("_page", F.from_json("json", PAGE_SCHEMA))
    media = F.coalesce(*(F.col(f"_page.{shape}.shortcode_media") for shape in shapes))
    block = read.withColumn("_block", media["edge_media_to_parent_comment"])
    texts = F.filter(F.transform("_block.edges", lambda e: e["node"]["text"]), lambda t: t.isNotNull() & ~t.rlike(r"(?U)^\s*$"))
    return block.select(
        "shortcode",
        place,
        F.col("_block").isNotNull().alias("ok"),
        F.coalesce("_block.page_info.has_next_page", F.lit(False)).alias("has_next"),
        F.col("_block.page_info.end_cursor").alias("end_cursor"),
        F.coalesce(texts, F.expr("cast(array() as array<string>)")).alias("texts"),
    )


def comments_from_json(pages: DataFrame, limit: int | None = PER_URL) -> DataFrame:
    """All comments of JSON pages, in either shape; the first `limit` of a shortcode."""
    each = parsed_pages(pages).select(F.col("shortcode").alias("source_url"), "page_no", F.posexplode("texts").alias("pos", "text"))
    return first_per_url(each, limit, "page_no", "pos")


def stitch_comment_pages(pages: DataFrame, limit: int | None = PER_URL) -> DataFrame:
    """As comments_from_json, but only of the pages from the first on, by page_no, that are there, well-formed and linked by a
    next page. Pages that follow each other come in the data shape only."""
    order = Window.partitionBy("shortcode").orderBy("page_no")
    good = parsed_pages(pages, ("data",)).withColumn("_in_place", F.col("page_no") == F.row_number().over(order) - 1)
    linked = F.min(F.col("ok") & F.col("has_next") & F.col("_in_place")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    prefix = good.withColumn("_linked", F.coalesce(linked, F.lit(True))).filter(F.col("_linked") & F.col("ok") & F.col("_in_place"))
    each = prefix.select(F.col("shortcode").alias("source_url"), "page_no", F.posexplode("texts").alias("pos", "text"))
    return first_per_url(each, limit, "page_no", "pos")


def numbered_by_cursor(pages: DataFrame) -> DataFrame:
    """pages (shortcode, cursor, json) that the first page of their shortcode leads to, with page_no, ok and texts.

    cursor is what a page was asked for with: null, or empty, for the first one; a page with a next one names the cursor of that. Numbers
    come by list ranking: each round doubles how far every page looks ahead, and how many pages are numbered, so a chain
    of a million pages takes twenty rounds, and a hot shortcode is many small keys. Where cursors lead back, the chain ends
    before the page that it has had; of two pages with one cursor, the one with the smaller text counts. Pages that no chain reaches are left out.
    """
    places = ["shortcode", "cursor"]
    read = parsed_pages(pages.withColumn("cursor", F.coalesce("cursor", F.lit(""))).groupBy(*places).agg(F.min("json").alias("json")), ("data",))
    read = scratch_table(read, "pages")
    leads = F.col("ok") & F.col("has_next") & (F.col("end_cursor") != "")
    jump = scratch_table(read.filter(leads).select(*places, F.col("end_cursor").alias("to")), "jumps")
    found, n, ahead = scratch_table(read.filter("cursor = ''").select(*places, F.lit(0).cast("long").alias("page_no")), "found"), -1, 1
    while (now := found.count()) != n:
        n = now
        further = found.join(jump, places).select("shortcode", F.col("to").alias("cursor"), (F.col("page_no") + ahead).alias("page_no"))
        found = scratch_table(found.unionByName(further.join(read.select(*places), places, "left_semi")).groupBy(*places).agg(F.min("page_no").alias("page_no")), "found")
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.shortcode") == F.col("b.shortcode")) & (F.col("a.to") == F.col("b.cursor")))
        jump, ahead = scratch_table(twice.select("a.shortcode", "a.cursor", "b.to"), "jumps"), ahead * 2
    return found.join(read, places).select("shortcode", "page_no", "ok", "texts")


def stitch_by_cursor(pages: DataFrame, limit: int | None = PER_URL) -> DataFrame:
    """As stitch_comment_pages, of pages that know cursors instead of numbers."""
    each = numbered_by_cursor(pages).filter("ok").select(F.col("shortcode").alias("source_url"), F.col("page_no").cast("int").alias("page_no"), F.posexplode("texts").alias("pos", "text"))
    return first_per_url(each, limit, "page_no", "pos")


def comments_by_url(requests: DataFrame, html_pages: DataFrame, json_pages: DataFrame, limit: int | None = PER_URL) -> DataFrame:
    """requests (url): posts and reels are read from JSON pages by their shortcode, other URLs from HTML."""
    urls = requests.select(T.trim_all(F.col("url")).alias("url")).distinct().withColumn("shortcode", T.shortcode(F.col("url")))
    posts = urls.filter("shortcode is not null")
    stitched = stitch_comment_pages(json_pages.join(posts.select("shortcode").distinct(), "shortcode", "left_semi"), limit)
    from_posts = stitched.withColumnRenamed("source_url", "shortcode").join(posts, "shortcode").select(F.col("url").alias("source_url"), "page_no", "pos", "text")
    others = html_pages.join(urls.filter("shortcode is null").select("url"), "url", "left_semi")
    return from_posts.unionByName(comments_from_html(others, limit))


def monitored_comments(monitored: DataFrame, html_pages: DataFrame, json_pages: DataFrame) -> DataFrame:
    """Comments of the monitored URLs, at the fixed limit; URLs without pages give none."""
    return comments_by_url(monitored, html_pages, json_pages, MONITORED_PER_URL)


def distinct_comments(df: DataFrame, *keep: str) -> DataFrame:
    """One row per text, the one with the smallest seq."""
    first = F.min_by(F.struct("seq", *keep), "seq").alias("first")
    return df.groupBy("text").agg(first).select("text", "first.*")


def scan_batches(comments: DataFrame, size: int = 50) -> DataFrame:
    """comments with batch_id: runs of `size` by seq, counted from 1."""
    return comments.withColumn("batch_id", F.floor((F.col("seq") - 1) / size))


class Sources:
    """Named sources of recent comments; the first that is switched on is read, else the default."""

    def __init__(self, default: str):
        self.default = default
        self.readers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, reader: Callable[[SparkSession], DataFrame]) -> Sources:
        self.readers[name] = reader
        return self

    def choose(self, switched_on: tuple[str, ...]) -> str:
        return next((name for name in self.readers if name in switched_on), self.default)

    def read(self, spark: SparkSession, switched_on: tuple[str, ...] = ()) -> DataFrame:
        return self.readers[self.choose(switched_on)](spark)


def table_source(path: str, fmt: str = "parquet", column: str = "text", **options: str) -> Callable[[SparkSession], DataFrame]:
    """A source over files of any format that Spark reads; its text column becomes `text`."""
    return lambda spark: spark.read.format(fmt).options(**options).load(path).withColumnRenamed(column, "text")


def comments_for_scan(explicit: DataFrame | None = None, from_url: DataFrame | None = None, provided: DataFrame | None = None, monitored: DataFrame | None = None) -> DataFrame:
    """Explicit comments if given, else those of one URL, else the provider's and the monitored URLs' without repeats."""
    if explicit is not None:
        return explicit
    if from_url is not None:
        return from_url
    return distinct_comments(provided if monitored is None else provided.unionByName(monitored, allowMissingColumns=True))
