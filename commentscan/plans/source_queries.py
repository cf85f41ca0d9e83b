"""Comments out of pasted lists, pages and files, built from the conversations table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from commentscan.functions import text as T
from commentscan.plans.scan_queries import DECIDED, decided
from commentscan.sources import comments as C
from commentscan.sources import delimited as D
from commentscan.sources.scratch import scratch
from commentscan.sources.tables import table


def turns(spark, sf_dir):
    """(conv_id, n, text): n counts a conversation's turns from 0."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(order) - 1).alias("n"), "text")


TURNS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, text FROM conversations"
TRIMMED = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


def html_pages(spark, sf_dir):
    """A page per conversation with its turns as quoted, escaped "text" values."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\\n")), F.lit("é"), F.lit("\\u00e9"))
    node = F.concat(F.lit('{"id":"'), F.col("n"), F.lit('","text":"'), escaped, F.lit('"}'))
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("n", node.alias("node")))), lambda x: x["node"])
    url = F.concat(F.lit("https://h/u/"), F.col("conv_id"))
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.concat(F.lit("<html>["), F.array_join(nodes, ","), F.lit("]</html>")).alias("html")).select(url.alias("url"), "html")


def json_pages(spark, sf_dir):
    """Pages of two turns per conversation; in some the second page is broken or its number is skipped."""
    page = turns(spark, sf_dir).withColumn("page_no", F.floor(F.col("n") / 2).cast("int"))
    last = Window.partitionBy("conv_id")
    nodes = page.withColumn("last", F.max("page_no").over(last)).groupBy("conv_id", "page_no", "last").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.struct(F.struct(x["text"].alias("text")).alias("node"))).alias("edges")
    )
    info = F.struct((F.col("page_no") < F.col("last")).alias("has_next_page"), F.col("page_no").cast("string").alias("end_cursor"))
    media = F.struct(F.struct(F.struct("edges", info.alias("page_info")).alias("edge_media_to_parent_comment")).alias("shortcode_media"))
    json = F.when(F.col("conv_id") % 5 == 0, F.to_json(F.struct(media.alias("graphql")))).otherwise(F.to_json(F.struct(media.alias("data"))))
    json = F.when((F.col("conv_id") % 7 == 3) & (F.col("page_no") == 1), '{"data": oops').otherwise(json)
    skipped = F.when((F.col("conv_id") % 11 == 4) & (F.col("page_no") >= 1), F.col("page_no") + 1).otherwise(F.col("page_no"))
    return nodes.select(F.concat(F.lit("c_"), F.col("conv_id")).alias("shortcode"), skipped.alias("page_no"), json.alias("json"))


def split_comments(spark, sf_dir):
    payload = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("payload"))
    return C.split_comments(payload).groupBy("conv_id", "turn").agg(F.count("*").alias("n_comments"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "|")).alias("texts_md5"))


def split_lines(spark, sf_dir):
    payload = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("payload"))
    return C.split_comments(payload, separator=C.LINES).groupBy("doc_id").agg(F.count("*").alias("n_comments"), F.sum(F.char_length("text")).alias("n_chars"))


def comments_from_html(spark, sf_dir):
    return C.comments_from_html(html_pages(spark, sf_dir), limit=None).select("source_url", "pos", F.md5("text").alias("text_md5"))


def comments_from_json(spark, sf_dir):
    """All comments of all pages that are well-formed, in either shape."""
    return C.comments_from_json(json_pages(spark, sf_dir), limit=None).select("source_url", "page_no", "pos", F.md5("text").alias("text_md5"))


def stitch_pages(spark, sf_dir):
    return C.stitch_comment_pages(json_pages(spark, sf_dir), limit=None).select("source_url", "page_no", "pos", F.md5("text").alias("text_md5"))


def stitch_by_cursor(spark, sf_dir):
    """The same pages without their numbers: each knows the cursor that it was asked for with, and names the next one."""
    cursor = F.when(F.col("page_no") > 0, (F.col("page_no") - 1).cast("string"))
    pages = json_pages(spark, sf_dir).select("shortcode", cursor.alias("cursor"), "json")
    return C.stitch_by_cursor(pages, limit=None).select("source_url", "page_no", "pos", F.md5("text").alias("text_md5"))


def first_per_url(spark, sf_dir):
    return C.comments_from_html(html_pages(spark, sf_dir), limit=3).groupBy("source_url").agg(F.count("*").alias("n_comments"))


def urls(spark, sf_dir):
    """Three URLs that stand for each page: a post, a reel and a profile."""
    kinds = F.array(F.lit("/p/Ab_-"), F.lit("/reel/"), F.lit("/u/"))
    page = table(spark, sf_dir, "pages").select("page_id", F.explode(kinds).alias("kind"))
    return page.select("page_id", "kind", F.concat(F.lit("https://h"), F.col("kind"), F.col("page_id"), F.lit("/?x")).alias("url"))


def url_shortcode(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", "kind", T.shortcode(F.col("url")).alias("shortcode"))


def requests(spark, sf_dir):
    """Each conversation is asked for as a post and as a plain page."""
    each = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    post, page = F.concat(F.lit(" https://h/p/c_"), F.col("conv_id"), F.lit("/ ")), F.concat(F.lit("https://h/u/"), F.col("conv_id"))
    return each.select("conv_id", F.explode(F.array(post, page)).alias("url"))


def route_by_url(spark, sf_dir):
    done = C.comments_by_url(requests(spark, sf_dir), html_pages(spark, sf_dir), json_pages(spark, sf_dir), limit=None)
    return done.groupBy("source_url").agg(F.count("*").alias("n_comments"), F.sum(F.char_length("text")).alias("n_chars"))


def monitored_scan(spark, sf_dir):
    """Conversations of four turns and more are monitored."""
    long = table(spark, sf_dir, "conversations").groupBy("conv_id").count().filter("count >= 4").select("conv_id")
    monitored = requests(spark, sf_dir).join(long, "conv_id")
    done = C.monitored_comments(monitored, html_pages(spark, sf_dir), json_pages(spark, sf_dir))
    return done.groupBy("source_url").agg(F.count("*").alias("n_comments"))


def scan_batches(spark, sf_dir):
    done = decided(spark, sf_dir).withColumn("seq", F.col("comment_id") + 1)
    return C.scan_batches(done).groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if("flagged").alias("flagged"))


def source_priority(spark, sf_dir):
    """Both sources switched on: the first registered is read."""
    sources = C.Sources("sample").register("graph", C.table_source(f"{sf_dir}/documents.parquet")).register("session", C.table_source(f"{sf_dir}/conversations.parquet"))
    sources.register("sample", lambda s: s.createDataFrame([("I disagree",)], "text string"))
    return sources.read(spark, ("session", "graph")).groupBy("source").agg(F.count("*").alias("n_comments"))


def delimited_round_trip(spark, sf_dir):
    path = scratch(spark, "delimited")
    docs = table(spark, sf_dir, "documents")
    D.write_delimited(docs.select("text", F.when(F.col("lang") != "es", F.concat(F.lit("https://h/"), F.col("source"))).alias("source_url"), F.col("doc_id").alias("seq")), path)
    back = D.read_delimited(spark, path, "text string, source_url string, seq long")
    return back.select("seq", F.md5("text").alias("text_md5"), "source_url")


def legacy_fallback(spark, sf_dir):
    """Once the current table is empty, so the text-only one is read; once it holds rows, and that one counts for nothing."""
    legacy = table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("seq"))
    current = legacy.filter("seq % 3 = 0").select("text", F.lit("https://h/").alias("source_url"), "seq")
    both = [D.with_legacy(now, legacy).withColumn("empty", F.lit(empty)) for now, empty in ((current.limit(0), True), (current, False))]
    return both[0].unionByName(both[1]).select("empty", "seq", "source_url", F.md5("text").alias("text_md5"))


def scan_input(spark, sf_dir):
    """What a scan reads: explicit comments, else those of one URL, else the provider's and the monitored ones."""
    explicit, url, provided, monitored = (table(spark, sf_dir, "documents").filter(F.col("doc_id") % 4 == k).select("text", F.col("doc_id").alias("seq")) for k in range(4))
    chosen = {"explicit": C.comments_for_scan(explicit, url, provided, monitored), "url": C.comments_for_scan(None, url, provided, monitored), "monitored": C.comments_for_scan(None, None, provided, monitored)}
    chosen["provider"] = C.comments_for_scan(provided=provided)
    tagged = [df.select(F.lit(name).alias("input"), "seq", F.md5("text").alias("text_md5")) for name, df in chosen.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])


def json_unescape(spark, sf_dir):
    r"""Texts with quotes, tabs and é escaped, and an untouched \/ in front."""
    text = F.col("text")
    for plain, escape in (("\n", "\\n"), ("é", "\\u00e9"), ("ñ", "\\u00F1"), ("ü", "\\u00fc")):
        text = F.replace(text, F.lit(plain), F.lit(escape))
    done = table(spark, sf_dir, "documents").select("doc_id", T.json_unescape(F.concat(F.lit('\\/ \\"\\t'), text)).alias("t"))
    return done.select("doc_id", F.md5("t").alias("text_md5"))


PAGED = f"SELECT conv_id, n, n // 2 AS page, n % 2 AS pos, text, max(n // 2) OVER (PARTITION BY conv_id) AS last FROM ({TURNS}) WHERE {TRIMMED} <> ''"
WELL = f"SELECT *, CASE WHEN conv_id % 11 = 4 AND page >= 1 THEN page + 1 ELSE page END AS page_no FROM ({PAGED}) WHERE NOT (conv_id % 7 = 3 AND page = 1)"
STITCHED = f"SELECT * FROM ({WELL}) WHERE conv_id % 5 <> 0 AND (page = 0 OR (conv_id % 7 <> 3 AND conv_id % 11 <> 4))"
HTML = f"SELECT conv_id, n, {TRIMMED} AS text FROM ({TURNS}) WHERE {TRIMMED} <> ''"
ROUTED = f"SELECT 'https://h/p/c_' || conv_id || '/' AS source_url, conv_id, text FROM ({STITCHED}) UNION ALL SELECT 'https://h/u/' || conv_id, conv_id, text FROM ({HTML})"

QUERIES = {
    "split_comments": (
        split_comments,
        """SELECT conv_id, turn, count(*) AS n_comments, md5(string_agg(part, '|' ORDER BY i)) AS texts_md5
           FROM (SELECT conv_id, turn, i, trim(p[i + 1], ' ' || chr(9) || chr(13)) AS part
                 FROM (SELECT *, string_split(text, chr(10)) AS p, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations))
           WHERE part <> '' GROUP BY conv_id, turn""",
    ),
    "split_lines": (
        split_lines,
        """SELECT doc_id, count(*) AS n_comments, sum(length(part))::BIGINT AS n_chars
           FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS part FROM documents) WHERE part <> '' GROUP BY doc_id""",
    ),
    "comments_from_html": (comments_from_html, f"SELECT 'https://h/u/' || conv_id AS source_url, n::INT AS pos, md5(text) AS text_md5 FROM ({HTML})"),
    "comments_from_json": (comments_from_json, f"SELECT 'c_' || conv_id AS source_url, page_no::INT AS page_no, pos::INT AS pos, md5(text) AS text_md5 FROM ({WELL})"),
    "stitch_pages": (stitch_pages, f"SELECT 'c_' || conv_id AS source_url, page_no::INT AS page_no, pos::INT AS pos, md5(text) AS text_md5 FROM ({STITCHED})"),
    "stitch_by_cursor": (stitch_by_cursor, f"SELECT 'c_' || conv_id AS source_url, page_no::INT AS page_no, pos::INT AS pos, md5(text) AS text_md5 FROM ({STITCHED})"),
    "first_per_url": (first_per_url, f"SELECT 'https://h/u/' || conv_id AS source_url, least(3, count(*)) AS n_comments FROM ({HTML}) GROUP BY conv_id"),
    "url_shortcode": (
        url_shortcode,
        """SELECT page_id, kind, CASE kind WHEN '/p/Ab_-' THEN 'Ab_-' || page_id WHEN '/reel/' THEN page_id::VARCHAR END AS shortcode
           FROM (SELECT page_id, unnest(['/p/Ab_-', '/reel/', '/u/']) AS kind FROM pages)""",
    ),
    "route_by_url": (route_by_url, f"SELECT source_url, count(*) AS n_comments, sum(length(text))::BIGINT AS n_chars FROM ({ROUTED}) GROUP BY source_url"),
    "monitored_scan": (
        monitored_scan,
        f"SELECT source_url, least(200, count(*)) AS n_comments FROM ({ROUTED}) WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 4) GROUP BY source_url",
    ),
    "scan_batches": (scan_batches, f"SELECT comment_id // 50 AS batch_id, count(*) AS total, count(*) FILTER (flagged) AS flagged FROM ({DECIDED}) GROUP BY 1"),
    "source_priority": (source_priority, "SELECT source, count(*) AS n_comments FROM documents GROUP BY source"),
    "delimited_round_trip": (delimited_round_trip, "SELECT doc_id AS seq, md5(text) AS text_md5, CASE WHEN lang <> 'es' THEN 'https://h/' || source END AS source_url FROM documents"),
    "legacy_fallback": (legacy_fallback, """SELECT true AS empty, doc_id AS seq, NULL::VARCHAR AS source_url, md5(text) AS text_md5 FROM documents
        UNION ALL SELECT false, doc_id, 'https://h/', md5(text) FROM documents WHERE doc_id % 3 = 0"""),
    "scan_input": (
        scan_input,
        """SELECT CASE doc_id % 4 WHEN 0 THEN 'explicit' ELSE 'url' END AS input, doc_id AS seq, md5(text) AS text_md5 FROM documents WHERE doc_id % 4 < 2
           UNION ALL SELECT 'monitored', min(doc_id), md5(text) FROM documents WHERE doc_id % 4 >= 2 GROUP BY text
           UNION ALL SELECT 'provider', min(doc_id), md5(text) FROM documents WHERE doc_id % 4 = 2 GROUP BY text""",
    ),
    "json_unescape": (json_unescape, "SELECT doc_id, md5('\\/ \"' || chr(9) || text) AS text_md5 FROM documents"),
}

