"""Secret scans through a trigram inverted index.

From each rule's regular expression follows a Boolean trigram query: what any match must contain, in lower case. The
index holds, for each trigram that some query asks for, the documents with it, in blocks of document ids. Queries
intersect and unite those postings; only the candidates' texts are searched for the rule. A rule that must contain no
trigram is searched for in every text. Texts stay where they are read: what joins are ids, hashes and spans.
"""

from __future__ import annotations

import re
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def either_case(word: str) -> str:
    """A pattern for the word in either case, letter by letter."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])

#: name -> (pattern, group whose length counts, its least length). The first three are the base kinds.
RULES = {
    "assign": (rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "code_host": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "payment": (r"sk_(live|test)_[A-Za-z0-9]+", 0, 24),
    "map_key": (r"AIza[0-9A-Za-z_-]+", 0, 39),
    "web_token": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "url_login": (r"[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/:@]+@", 0, 0),
}
_RUN = "[A-Za-z0-9_-]"
#: Patterns with the same long enough matches that look at a long run of letters once, not at each of them. The parts of
#: RULES are what queries derive from, and what SQL without lookbehind can run.
QUICK = {
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "url_login": r"(?<![a-z])" + RULES["url_login"][0],
    # A run is read from its begin to its first eyJ, where alone a match can start, and from there to its end.
    "web_token": rf"(?<!{_RUN})((?>{_RUN}*?(?=eyJ)))(eyJ{_RUN}++\.{_RUN}++\.{_RUN}++)",
}
#: Of quick patterns that read something before a match: the groups of that and of the match.
PARTS = {"web_token": (1, 2)}
BASE = ("assign", "access", "hex")
#: Candidates that are broadcast; past it Spark joins by shuffle what a bitmap of the candidates leaves.
BROADCAST_ROWS = 200_000
#: Matches whose places are added up at a time.
STEP = 256
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Document ids in a block of postings, at most.
BLOCK = 4096
MAX_EXACT = 16

Query = list[list[frozenset[str]]]  # and of (or of (and of trigrams))


def _trigrams(word: str) -> frozenset[str]:
    return frozenset(word[i : i + 3] for i in range(len(word) - 2))


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match contains: all clauses, of each one alternative with all its trigrams."""
    clauses: Query = []

    def close(words: set[str]) -> None:
        options = [_trigrams(w) for w in words]
        if options and all(options):
            clauses.append(options)

    def exact(node) -> set[str] | None:
        """All strings that a part can match, where they are few."""
        op, value = node
        if op is parser.LITERAL:
            return {chr(value).lower()}
        if op is parser.IN and value[0][0] is not parser.NEGATE and all(o is parser.LITERAL for o, _ in value):
            return {chr(v).lower() for _, v in value}
        if op is parser.SUBPATTERN:
            return sequence(value[3])
        if op is parser.BRANCH:
            found = [sequence(x) for x in value[1]]
            return None if None in found else set().union(*found)
        if op is parser.MAX_REPEAT and value[:2] == (0, 1) and (once := sequence(value[2])) is not None:
            return once | {""}
        return None

    def sequence(nodes) -> set[str] | None:
        words = {""}
        for node in nodes:
            more = exact(node)
            if more is None or len(words) * len(more) > MAX_EXACT:
                return None
            words = {a + b for a in words for b in more}
        return words

    def visit(nodes) -> None:
        words = {""}
        for node in nodes:
            more = exact(node)
            if more is not None and len(words) * len(more) <= MAX_EXACT:
                words = {a + b for a in words for b in more}
                continue
            close(words)
            words = {""}
            if more is not None and len(more) <= MAX_EXACT:
                words = more
            elif node[0] is parser.SUBPATTERN:
                visit(node[1][3])
        close(words)

    visit(parser.parse(pattern))
    return clauses


def vocabulary(queries: dict[str, Query]) -> list[str]:
    return sorted({t for q in queries.values() for clause in q for option in clause for t in option})


def _id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"], F.lit(-(2**63))).cast("long")


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block, trigram, ids): documents that hold a trigram, by blocks of at most BLOCK document ids."""
    lowered = common.ascii_lower(common.text_or_empty(docs))
    found = common.let(lowered, lambda text: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(text, t)))
    postings = docs.select(_id(docs).alias("id"), F.explode(found).alias("trigram")).withColumn("block", F.expr(f"floor(id / {BLOCK})"))
    return postings.groupBy("block", "trigram").agg(F.collect_set("id").alias("ids"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, rules): the documents that a rule's query leaves, for rules with a query."""
    none = F.expr("cast(array() as array<bigint>)")
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings"))

    def of(trigram: str) -> Column:
        return F.coalesce(F.get(F.map_values(F.map_filter("postings", lambda k, _: k == trigram)), 0), none)

    def combined(parts: list[Column], how) -> Column:
        got = parts[0]
        for part in parts[1:]:
            got = how(got, part)
        return got

    def hits(query: Query) -> Column:
        clauses = [combined([combined([of(t) for t in sorted(option)], F.array_intersect) for option in clause], F.array_union) for clause in query]
        return combined(clauses, F.array_intersect)

    named = [F.struct(F.lit(name).alias("rule"), hits(q).alias("ids")) for name, q in queries.items() if q]
    each = by_block.select(F.explode(F.array(*named)).alias("x")).select("x.rule", F.explode("x.ids").alias("id"))
    return each.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def _starts(lengths: Column) -> Column:
    """Where matches start, from the lengths of the gap before each and of the match: sums in two steps, so that the work
    does not grow with the square of their number."""

    def sums(parts: Column, length) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("befores"))
        return F.aggregate(parts, start, lambda acc, p: F.struct((acc["at"] + length(p)).alias("at"), F.concat(acc["befores"], F.array(acc["at"])).alias("befores")))

    firsts = F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(STEP))
    blocks = F.transform(firsts, lambda k: sums(F.slice(lengths, k + 1, STEP), lambda p: p["gap"] + p["long"]))

    def whole(b: Column) -> Column:
        return F.flatten(F.zip_with(b, sums(b, lambda x: x["at"])["befores"], lambda x, at: F.transform(x["befores"], lambda v: v + at)))

    return F.zip_with(common.let(blocks, whole), lengths, lambda at, p: at + p["gap"])


def spans_of(text: Column, rule: str) -> Column:
    """Spans (start, rank, end, kind) of a rule's leftmost non-overlapping matches that are long enough, in code points.

    What split leaves between the matches gives their places.
    """
    pattern, group, least = RULES[rule]
    pattern = QUICK.get(rule, pattern)
    skipped, whole = PARTS.get(rule, (None, 0))

    def placed(x: Column) -> Column:
        before = lambda p: F.coalesce(F.char_length(p["skip"]), F.lit(0))
        lengths = F.transform(
            F.arrays_zip(x["gaps"], x["all"], x["skip"]), lambda p: F.struct((F.char_length(p["gaps"]) + before(p)).alias("gap"), F.coalesce(F.char_length(p["all"]), F.lit(0)).alias("long"))
        )
        each = F.arrays_zip(common.let(lengths, _starts).alias("at"), x["all"].alias("all"), x["sized"].alias("sized"))
        good = F.filter(each, lambda p: F.char_length(p["sized"]) >= least)
        return F.transform(
            good,
            lambda p: F.struct(
                p["at"].alias("start"), F.lit(list(RULES).index(rule)).alias("rank"), (p["at"] + F.char_length(p["all"])).alias("end"), F.lit(rule).alias("kind")
            ),
        )

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), whole).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), group or whole).alias("sized"),
        (F.expr("cast(array() as array<string>)") if skipped is None else F.regexp_extract_all(text, F.lit(pattern), skipped)).alias("skip"),
    )
    return F.when(text.rlike(pattern), common.let(found, placed)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """One row per row of docs: doc_id, text_key and spans, an array of (start, rank, end, kind) sorted by start and rank.

    docs: doc_id, text; other columns are ignored. text_key is the hash of the text, null ones being empty. Spans count code
    points, the end excluded. Each rule's matches are its leftmost non-overlapping ones; those too short are dropped, not
    retried. Null and empty texts have no spans; texts may be of any length. Null and repeated ids are searched like
    others: the index may then name more candidates, never fewer. Repeated rows get equal spans; an empty table gives none.
    """
    queries = {r: trigram_query(RULES[r][0]) for r in rules}
    words = vocabulary(queries)
    text = common.text_or_empty(docs)
    mine = docs.select(docs["doc_id"].alias("doc_id"), _id(docs).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    nothing = F.expr(f"cast(array() as {SPANS})")
    everywhere = F.concat(nothing, *(spans_of(F.col("text"), r) for r in rules if not queries[r]))
    base = mine.select("doc_id", "id", "text_key", everywhere.alias("base"))
    if not words:
        return base.select("doc_id", "text_key", F.array_sort("base").alias("spans"))
    named = common.written(candidates(trigram_index(docs, words), queries), "candidates")
    n_named = named.count()
    read = mine if n_named <= BROADCAST_ROWS else common.may_be_in(mine, "id", named)  # most other texts are not moved
    named = common.broadcast_if_small(named, n_named, BROADCAST_ROWS)
    per_rule = [F.when(F.array_contains("rules", r), spans_of(F.col("text"), r)).otherwise(nothing) for r in rules if queries[r]]
    verified = read.join(named, "id").select("id", "text_key", F.concat(*per_rule).alias("more")).filter(F.size("more") > 0)
    once = verified.groupBy("id", "text_key").agg(F.first("more").alias("more"))
    both = base.join(once, ["id", "text_key"], "left")
    return both.select("doc_id", "text_key", F.array_sort(F.concat("base", F.coalesce("more", nothing))).alias("spans"))


def op3_secret_scan(spark, sf_dir):
    done = scan_secrets(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}") for name in BASE]  # noqa: B023
    return done.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_sql() -> str:
    """The same spans in DuckDB, from the same patterns and without an index."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"""SELECT doc_id, '{name}' AS kind, {k} AS rank, unnest(range(len(m))) AS i, g, m, z, {least} AS least
            FROM (SELECT doc_id, string_split_regex(text, {quote(p)}) AS g, regexp_extract_all(text, {quote(p)}, 0) AS m, regexp_extract_all(text, {quote(p)}, {group}) AS z FROM docs)"""
        for k, (name, (p, group, least)) in enumerate(RULES.items())
    )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
spans AS (
  SELECT doc_id, kind, rank, i, length(z[i + 1]) AS sized, least,
         length(array_to_string(g[1:i + 1], '')) + length(array_to_string(m[1:i], '')) AS start, length(m[i + 1]) AS long FROM found
), good AS (
  SELECT doc_id, kind, rank, start, kind || ':' || start || ':' || (start + long) AS span FROM spans WHERE sized >= least
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM docs d LEFT JOIN good USING (doc_id) GROUP BY d.doc_id
"""
