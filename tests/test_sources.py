"""Comments out of payloads, pages and files."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from commentscan.functions import text as T
from commentscan.plans import source_queries
from commentscan.sources import comments as C
from commentscan.sources import delimited as D
from tests.test_queries import rows


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_split(spark):
    df = spark.createDataFrame([("a\x01 b \n\n c",)], "payload string")
    assert [r["text"] for r in C.split_comments(df).orderBy("pos").collect()] == ["a", "b", "c"]
    lines = spark.createDataFrame([(" a\r\nb\rc\x01d \n",)], "payload string")
    assert [r["text"] for r in C.split_comments(lines, separator=C.LINES).orderBy("pos").collect()] == ["a", "b", "c\x01d"]


def test_text_functions(spark):
    assert one(spark, "\t 　hi　", T.trim_all) == "hi"
    assert one(spark, "caf\\u00e9 \\ud83d\\ude00", T.json_unescape) == "café 😀"
    assert one(spark, "x \\\\n", T.json_unescape) == "x \\\n"
    assert one(spark, "\\/", T.json_unescape) == "\\/"
    assert one(spark, "a\\ud83db", T.json_unescape) == "a\\ud83db"
    assert one(spark, "😀", T.utf16_length) == 2
    assert one(spark, "17:scan: a:b", T.log_message) == "scan: a:b"
    assert one(spark, "plain", T.log_message) == "plain"
    assert one(spark, "  ", T.blank_to_null) is None
    for url, code in (("https://h/p/Ab_-1/?x", "Ab_-1"), ("https://h/reel/Z9", "Z9"), ("https://h/u/me", None)):
        assert one(spark, url, T.shortcode) == code


def test_html(spark):
    pages = spark.createDataFrame([("u", '{"text":"a"},{"text":" "},{"text":"b \\"q\\" c"}')], "url string, html string")
    assert [r["text"] for r in C.comments_from_html(pages).orderBy("pos").collect()] == ["a", "b \\"]


def page(texts, more, root="data"):
    edges = [{"node": {"text": t}} for t in texts]
    return json.dumps({root: {"shortcode_media": {"edge_media_to_parent_comment": {"edges": edges, "page_info": {"has_next_page": more, "end_cursor": "x"}}}}})


def stitched(spark, pages, limit=200):
    df = spark.createDataFrame([("s", n, j) for n, j in pages], "shortcode string, page_no int, json string")
    return [r["text"] for r in C.stitch_comment_pages(df, limit).orderBy("page_no", "pos").collect()]


def test_stitch(spark):
    a, b, c = page(["a", " "], True), page(["b"], False), page(["c"], False)
    assert stitched(spark, [(0, a), (1, b), (2, c)]) == ["a", "b"]
    assert stitched(spark, [(0, a), (2, c)]) == ["a"]
    assert stitched(spark, [(0, a), (1, '{"data": oops'), (2, c)]) == ["a"]
    assert stitched(spark, [(1, b)]) == []
    assert stitched(spark, [(0, page(["a"], True, "graphql")), (1, b)]) == []  # pages that follow each other come in the other shape
    many = [(0, page([f"a{k}" for k in range(50)], True)), (1, page([f"b{k}" for k in range(50)], False))]
    assert stitched(spark, many, 50) == [f"a{k}" for k in range(50)]


@pytest.fixture(scope="module")
def long_conversation(tmp_path_factory):
    """One conversation of 451 turns and one of 3, and the DuckDB connection that reads them."""
    path = str(tmp_path_factory.mktemp("long"))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT 1::BIGINT AS conv_id, i::INT AS turn, 'turn ' || i AS text FROM range(451) t(i) UNION ALL SELECT 2, i::INT, 'b' || i FROM range(3) t(i)")
    con.execute(f"COPY conversations TO '{path}/conversations.parquet' (FORMAT parquet)")
    return path, con


@pytest.mark.parametrize("name", ["comments_from_html", "comments_from_json", "stitch_pages", "route_by_url", "first_per_url", "monitored_scan"])
def test_long_conversations_are_whole(spark, long_conversation, name):
    path, con = long_conversation
    query, sql = source_queries.QUERIES[name]
    got, want = query(spark, path).toPandas(), con.execute(sql).df()
    assert rows(got) == rows(want)
    if name not in ("first_per_url", "monitored_scan"):
        assert (got["n_comments"].max() if name == "route_by_url" else len(got) - 3) == 451


def test_source_priority_and_union(spark):
    row = lambda t: lambda s: s.createDataFrame([(t, 1)], "text string, seq long")
    sources = C.Sources("sample").register("graph", row("g")).register("session", row("s")).register("sample", row("d"))
    assert [sources.choose(x) for x in ((), ("session",), ("session", "graph"))] == ["sample", "session", "graph"]
    both = C.comments_for_scan(provided=sources.read(spark), monitored=spark.createDataFrame([("d", 2), ("m", 3)], "text string, seq long"))
    assert sorted((r["text"], r["seq"]) for r in both.collect()) == [("d", 1), ("m", 3)]


def test_delimited(spark, tmp_path):
    rows = [("a\nb", None, 1), ("c\x01d\x02e", "https://h", 2), ('q"uo,te\\', "", 3)]
    D.write_delimited(spark.createDataFrame(rows, "text string, source_url string, seq long"), str(tmp_path / "t"))
    back = D.read_delimited(spark, str(tmp_path / "t"), "text string, source_url string, seq long").orderBy("seq")
    assert [tuple(r) for r in back.collect()] == [("a\nb", None, 1), ("c d e", "https://h", 2), ('q"uo,te\\', None, 3)]


def test_pages_by_cursor(spark):
    """Shuffled pages without numbers: chains, a long one, missing and broken pages, cycles, pages with one cursor, empty tables."""
    import json
    import random

    def paged(texts, to, root="data"):
        info = {"has_next_page": to is not None, "end_cursor": to}
        return json.dumps({root: {"shortcode_media": {"edge_media_to_parent_comment": {"edges": [{"node": {"text": t}} for t in texts], "page_info": info}}}})

    n = 3000
    rows = [("long", None if k == 0 else f"c{k}", paged([f"t{k}"], f"c{k + 1}" if k < n - 1 else None)) for k in range(n)]
    rows += [("cycle", None, paged(["a"], "x")), ("cycle", "x", paged(["b"], "y")), ("cycle", "y", paged(["c"], "x"))]
    rows += [("missing", "", paged(["a"], "x")), ("missing", "z", paged(["never"], None)), ("broken", None, paged(["a"], "x")), ("broken", "x", "{oops"), ("broken", "y", paged(["no"], None))]
    rows += [("fork", None, paged(["a"], "x")), ("fork", "x", paged(["b"], None)), ("fork", "x", paged(["c"], None)), ("other", None, paged(["a"], None, "graphql")), ("none", None, None), ("orphan", "q", paged(["a"], None))]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame(rows, "shortcode string, cursor string, json string")
    got = {}
    for r in sorted(C.stitch_by_cursor(pages, None).collect(), key=lambda r: (r["source_url"], r["page_no"], r["pos"])):
        got.setdefault(r["source_url"], []).append((r["page_no"], r["text"]))
    assert got.pop("long") == [(k, f"t{k}") for k in range(n)]
    assert got == {"cycle": [(0, "a"), (1, "b"), (2, "c")], "missing": [(0, "a")], "broken": [(0, "a")], "fork": [(0, "a"), (1, "b")]}
    assert C.stitch_by_cursor(pages.filter("shortcode = 'long'"), 50).count() == 50 and C.stitch_by_cursor(pages.limit(0)).count() == 0
