"""Conversation structure repair: the cheapest edits that make roles alternate, by a bidirectional search of the edit lattice.

Rows of a conversation stand in the order of turn (nulls first), role, and SHA-256 of the text. The lattice has a node for
each number of rows read and each state: nothing, system, user or assistant written last. Edits are its edges: keep (K),
rerole (R), delete (D), insert (I). A forward and a reverse heap meet; all crossings of the least cost are finished, and the
least concatenation of their audits is the answer.

A long conversation is not one group. Rows without their texts are dealt by ranges of (conversation, order), so a hot one
lies over many tasks; each task cuts what it reads into segments of at most SEGMENT rows and searches them on their own,
from each state to each. Segments that are not a conversation of their own are then chained in order. Texts move once, to
where a conversation is written: its hash is one stream, of which a task holds a batch.

Why least prefixes may be chained: a prefix of an audit fixes its node, so of two different audits that lead to one node at
one cost neither begins with the other (the longer would hold inserts that lead back to the node, which cost more).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a segment. Results do not depend on it.
SEGMENT = 512
#: States: what was written last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
#: The user or assistant row that may follow each state.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = frozenset(("su", "ua", "au"))
#: Codes of rows: the initial of a role that may be kept, o for others, in upper case if truncated; x must go.
MUST_GO = "x"


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row that is kept; None if it may not follow."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def edges(code: str) -> list[list[tuple[int, int, str]]]:
    """For each state: (state after, cost, edit) of each way to take a row."""
    out = [[(q, DELETE, "D")] for q in STATES]
    if code != MUST_GO:
        more = TRUNCATED if code.isupper() else 0
        for q in STATES:
            to = kept_state(q, code.lower())
            if to is not None:
                out[q].append((to, more, "K"))
            out[q].append((FOLLOWS[q], REROLE + more, "R"))
    return out


_EDGES = {c: edges(c) for c in "suaoSUAOx"}
_BACK = {c: [[(p, w, e) for p in STATES for to, w, e in _EDGES[c][p] if to == q] for q in STATES] for c in _EDGES}
_FOLLOWED = [[p for p in STATES if FOLLOWS[p] == q] for q in STATES]


class _Side:
    """One of the two searches. Nodes are 4 * rows + state; equal costs are settled in the order of rows, since an edit that
    costs nothing takes a row, so that a node's least audit is known when it is settled."""

    def __init__(self, codes: str, starts: Iterable[int], forward: bool):
        self.codes, self.forward, self.settled, self.heap, self.best = codes, forward, {}, [], {}
        starts = list(starts)
        for node in starts:
            self.offer(node, 0, "")
        for _ in starts:  # costs below top() are settled, and where the search starts
            self.settle()

    def offer(self, node: int, cost: int, audit: str) -> None:
        if node in self.settled:
            return
        known = self.best.get(node)
        if known is None or (cost, audit) < known:
            if known is None or cost < known[0]:
                heapq.heappush(self.heap, (cost, node // 4 if self.forward else -(node // 4), node))
            self.best[node] = (cost, audit)

    def top(self) -> float:
        while self.heap and (self.heap[0][2] in self.settled or self.best[self.heap[0][2]][0] < self.heap[0][0]):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def steps(self, node: int) -> Iterator[tuple[int, int, str]]:
        i, q = divmod(node, 4)
        if self.forward:
            yield 4 * i + FOLLOWS[q], INSERT, "I"
            if i < len(self.codes):
                for to, cost, edit in _EDGES[self.codes[i]][q]:
                    yield 4 * (i + 1) + to, cost, edit
        else:
            for p in _FOLLOWED[q]:
                yield 4 * i + p, INSERT, "I"
            if i:
                for p, cost, edit in _BACK[self.codes[i - 1]][q]:
                    yield 4 * (i - 1) + p, cost, edit

    def settle(self) -> int:
        node = heapq.heappop(self.heap)[2]
        cost, audit = self.settled[node] = self.best[node]
        for to, more, edit in self.steps(node):
            self.offer(to, cost + more, audit + edit if self.forward else edit + audit)
        return node


def _met(side: _Side, other: _Side, node: int) -> float:
    """The least cost of a way through a node that one search has settled and at which, or a step behind which, it meets the other."""
    cost = side.settled[node][0]
    ways = [cost + more + other.settled[to][0] for to, more, _ in side.steps(node) if to in other.settled]
    return min(ways + [cost + other.settled[node][0]] if node in other.settled else ways, default=float("inf"))


def search(codes: str, start: int, ends: Iterable[int]) -> tuple[int, str] | None:
    """The least (cost, audit) from a state before the codes to one of some states behind them; None if there is no way."""
    ahead, back = _Side(codes, [start], True), _Side(codes, [4 * len(codes) + q for q in ends], False)
    least = _met(ahead, back, start)
    while ahead.top() + back.top() <= least and (ahead.heap or back.heap):
        side, other = (ahead, back) if (ahead.top(), len(ahead.settled)) <= (back.top(), len(back.settled)) else (back, ahead)
        least = min(least, _met(side, other, side.settle()))
    if least == float("inf"):
        return None
    found = [a + back.settled[n][1] for n, (c, a) in ahead.settled.items() if n in back.settled and c + back.settled[n][0] == least]
    for node, (cost, audit) in ahead.settled.items():
        found += [audit + edit + back.settled[to][1] for to, more, edit in ahead.steps(node) if to in back.settled and cost + more + back.settled[to][0] == least]
    return int(least), min(found)


ACCEPTED = (NOTHING, ASSISTANT)


@lru_cache(50_000)
def repair_short(codes: str) -> tuple[int, str]:
    return search(codes, NOTHING, ACCEPTED)


def repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    return repair_short(codes) if len(codes) <= 32 else search(codes, NOTHING, ACCEPTED)


def ways(codes: str) -> list[tuple[int, str] | None]:
    """From each state to each, in order."""
    reached = lambda p, q: q >= p or q >= USER
    return [search(codes, p, [q]) if reached(p, q) else None for p in STATES for q in STATES]


def chained(before: list[tuple[int, str] | None], through: list[tuple[int, str] | None]) -> list[tuple[int, str] | None]:
    """The least (cost, audit) at each state, after one more segment."""
    pairs = [[(before[p], through[4 * p + q]) for p in STATES] for q in STATES]
    return [min(((a[0] + b[0], a[1] + b[1]) for a, b in each if a and b), default=None) for each in pairs]


# Rows


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), damaged by a hash of conversation and turn. Nulls of role and text, and in what is hashed,
    are one space."""
    named = conversations.select(*(conversations[c].alias(c) for c in ("conv_id", "turn", "role", "text")))
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = named.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _plain(conversations: DataFrame) -> DataFrame:
    columns = {"conv_id": conversations["conv_id"], "turn": conversations["turn"].cast("long")}
    columns |= {c: F.coalesce(conversations[c].cast("string"), F.lit(" ")) for c in ("role", "text")}
    rows = conversations.select(*(v.alias(k) for k, v in columns.items()))
    return rows.withColumn("sha", F.unhex(F.sha2("text", 256)))


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, sha, n, blank, truncated, seen): equal rows as one, n times; seen where an earlier turn has role and text."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(common.WHITE)), -1, 1)
    slim = rows.select("conv_id", "turn", "role", "sha", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    each = common.written(slim.groupBy("conv_id", "turn", "role", "sha").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")), "turns")
    # The least of a struct, as a null turn comes first.
    first = each.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = common.written(first.select(F.struct("conv_id", "role", "sha").alias("key"), "first"), "repeated-turns")
    both = each.withColumn("key", F.struct("conv_id", "role", "sha")).join(first, "key", "left")
    seen = F.col("first").isNotNull() & (F.struct("turn") > F.col("first"))
    return both.select("conv_id", "turn", "role", "sha", "n", "blank", "truncated", seen.alias("seen"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
SEGMENTS = "part int, no long, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"


class _Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, no: int):
        self.no, self.codes, self.first, self.last = no, [], None, None
        self.counts, self.low, self.high, self.turns = dict.fromkeys(COUNTS, 0), None, None, 0

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last = initial
        if fault:
            self.counts[fault] += 1
        code = initial if initial in ("s", "u", "a") else "o"
        self.codes.append(MUST_GO if fault in ("blank", "duplicate") else code.upper() if fault else code)
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def row(self, conv, part: int, whole: bool) -> tuple:
        codes = "".join(self.codes)
        found = [repair(codes)] if whole else ways(codes)
        return (conv, part, self.no, whole, *self.counts.values(), self.first, self.last, self.low, self.high, self.turns,
                [c[0] if c else None for c in found], [c[1] if c else None for c in found])


def _segmented(schema: pa.Schema):
    """Rows in order to segments, a `whole` one for each conversation that surely begins and ends in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        conv, segment, opened = None, None, 0

        def close(ended: bool) -> None:
            out.append(segment.row(conv, part, ended and segment.no == 0 and opened > 1))

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "n", "blank", "truncated", "seen")]
            for this, turn, role, n, blank, truncated, seen in zip(*columns, strict=True):
                if segment is None or this != conv:
                    if segment is not None:
                        close(True)
                    conv, segment, opened = this, _Segment(0), opened + 1
                for k in range(n):
                    if len(segment.codes) == SEGMENT:
                        close(False)
                        segment = _Segment(segment.no + 1)
                    segment.add(turn, role, "blank" if blank else "duplicate" if seen or k else "truncated" if truncated else None)
            if out:
                yield _batch(out, schema)
                out.clear()
        if segment is not None:
            close(False)  # it may go on in the next range
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _joined(schema: pa.Schema):
    """Segments in order, conversation by conversation, to one whole row each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None

        def ended() -> tuple:
            cost, audit = min(best[q] for q in ACCEPTED if best[q])
            return now["conv_id"], *(now[n] for n in COUNTS), now["low"], now["high"], now["turns"], cost, audit

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is not None and row["conv_id"] == now["conv_id"]:
                    now["illegal"] += now["last"] + row["first"] not in LEGAL
                    now["turns"] -= now["high"] is not None and now["high"] == row["low"]
                    for n in (*COUNTS, "turns"):
                        now[n] += row[n]
                    now["last"], now["low"] = row["last"], row["low"] if now["low"] is None else now["low"]
                    now["high"] = now["high"] if row["high"] is None else row["high"]
                else:
                    if now is not None:
                        out.append(ended())
                    now, best = row, [(0, ""), None, None, None]
                best = chained(best, [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)])
            if out:
                yield _batch(out, schema)
        if now is not None:
            yield _batch([ended()], schema)

    return run


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    conversations: conv_id, turn, role, text; other columns are ignored. Null roles and texts are one space; a null
    conv_id is a conversation like others. Rows of one turn go by role and by SHA-256 of the text; of equal rows the first
    is no duplicate. Turns without numbers come first and count for no gap. Texts and conversations may have any length. An
    empty table gives no rows.
    """
    spark = conversations.sparkSession
    kind = dict(_plain(conversations).dtypes)["conv_id"]
    segments = f"conv_id {kind}, {SEGMENTS}"
    order = ["conv_id", "turn", "role", "sha"]
    dealt = _faults(_plain(conversations)).repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    found = common.written(dealt.mapInArrow(_segmented(_arrow(spark, segments)), segments), "segments")
    whole = found.filter("whole").select("conv_id", *COUNTS, "low", "high", "turns", F.get("costs", 0).alias("cost"), F.get("audits", 0).alias("audit"))
    schema = f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, cost long, audit string"
    pieces = found.filter("not whole").repartition(common.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part", "no")
    both = whole.unionByName(pieces.mapInArrow(_joined(_arrow(spark, schema)), schema))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return both.select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit")


def _written_out(schema: pa.Schema, digest: bool):
    """Each conversation's audit, then its rows in order, to the repaired rows, or to the audit with a hash of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at, state, pos, hashed, out = None, 0, NOTHING, 0, None, []

        def put(role: str, text: str) -> None:
            nonlocal pos
            if digest:
                hashed.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
            else:
                out.append((head["conv_id"], pos, role, text))
            pos += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(head["text"]) and head["text"][at] == "I":
                state, at = FOLLOWS[state], at + 1
                put(ROLES[state], "")

        def ended() -> None:
            if head is not None:
                inserts()
                if digest:
                    out.append((*(head[n] for n in ("conv_id", "gaps", *COUNTS, "cost", "text")), hashed.hexdigest()))

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    ended()
                    head, at, state, pos, hashed = row, 0, NOTHING, 0, hashlib.sha256()
                    continue
                inserts()
                edit, at = head["text"][at], at + 1
                if edit == "K":
                    state = kept_state(state, row["role"][:1])
                    put(row["role"], row["text"])
                elif edit == "R":
                    state = FOLLOWS[state]
                    put(ROLES[state], row["text"])
            if out:
                yield _batch(out, schema)
                out.clear()
        ended()
        if out:
            yield _batch(out, schema)

    return run


def _stream(conversations: DataFrame, schema: str, digest: bool) -> DataFrame:
    spark, rows = conversations.sparkSession, _plain(conversations)
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, {schema}"
    heads = audits(conversations).select("conv_id", "gaps", *COUNTS, "cost", F.lit(0).alias("kind"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # A conversation's text is hashed from its begin to its end, so it is one task's; that one holds a batch of its rows.
    dealt = both.repartition(common.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "sha").drop("sha", "turn")
    return dealt.mapInArrow(_written_out(_arrow(spark, schema), digest), schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the rows of each conversation after the edits of audits(). One whose rows all go has none."""
    return _stream(conversations, "pos long, role string, text string", False)


def repair_report(conversations: DataFrame) -> DataFrame:
    """audits() with repaired_sha256, of the repaired rows as role:text in lines."""
    counts = ", ".join(f"{n} long" for n in ("gaps", *COUNTS, "cost"))
    return _stream(conversations, f"{counts}, audit string, repaired_sha256 string", True)


def op13_conversation_repair(spark, sf_dir):
    """The report over the damaged table, with a row of zeros for each conversation that lost all rows."""
    table = common.table(spark, sf_dir, "conversations")
    report = repair_report(damaged(table)).withColumnRenamed("conv_id", "_id")
    every = table.select("conv_id").distinct()
    both = every.join(report, every["conv_id"].eqNullSafe(report["_id"]), "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", *COUNTS, "cost")]
    return both.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The walk over all rows at once, row number by row number: the least label (cost, audit) of each state."""
    add = lambda x, cost, edit: f"(lpad((({x})[1:9]::INT + ({cost}))::VARCHAR, 9, '0') || ({x})[10:] || '{edit}')"
    u = f"least(u, {add('e', 5, 'I')}, {add('s', 5, 'I')}, {add('a', 5, 'I')})"
    keep = lambda x, initial: f"CASE WHEN c = '{initial}' THEN {add(x, 'more', 'K')} END"
    rerole = lambda x: f"CASE WHEN c <> 'x' THEN {add(x, '1 + more', 'R')} END"
    return f"""
WITH RECURSIVE crc_steps AS (
  SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM crc_steps WHERE k = 8
), read AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes FROM conversations
), kinds AS (
  SELECT read.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) % 20 AS kind FROM read, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds)
), ordered AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM hurt)
), coded AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS c, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more
  FROM (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN body[-1:] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM ordered)
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM coded GROUP BY conv_id
), walk AS (
  SELECT conv_id, 1::BIGINT AS k, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM counts
  UNION ALL
  SELECT conv_id, k + 1, {add('e', 2, 'D')}, least({add('s', 2, 'D')}, {keep('e', 's')}),
    least({add('u', 2, 'D')}, {keep('e', 'u')}, {keep('s', 'u')}, {keep('a', 'u')}, {rerole('e')}, {rerole('s')}, {rerole('a')}),
    least({add('a', 2, 'D')}, {keep('u', 'a')}, {rerole('u')})
  FROM (SELECT * REPLACE (least(a, {add('u', 5, 'I')}) AS a)
        FROM (SELECT w.conv_id, w.k, e, s, {u} AS u, a, c, more FROM walk w JOIN coded o ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.k = o.k))
), ended AS (
  SELECT conv_id, n, least(e, a, {add(f"({u})", 5, 'I')}) AS label FROM walk w JOIN counts USING (conv_id) WHERE w.k = n + 1
), audits AS (
  SELECT conv_id, label[1:9]::BIGINT AS cost, label[10:] AS audit FROM ended
), letters AS (
  SELECT conv_id, i, audit[i:i] AS edit, length(replace(audit[1:i], 'I', '')) AS k FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM audits)
), kept AS (
  SELECT l.conv_id, l.edit, o.role, CASE WHEN l.edit = 'I' THEN '' ELSE o.text END AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY i) - 1 AS p
  FROM letters l LEFT JOIN coded o ON l.conv_id = o.conv_id AND l.k = o.k WHERE l.edit <> 'D'
), placed AS (
  SELECT *, p - max(CASE WHEN p = 0 AND edit = 'K' AND role[1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS nth FROM kept
), written AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS repaired_sha256 FROM placed GROUP BY conv_id
)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN counts USING (conv_id) LEFT JOIN audits USING (conv_id) LEFT JOIN written USING (conv_id)
"""


OP13_SQL = _sql()
