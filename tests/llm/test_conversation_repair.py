"""Conversation repair against a plain search of all edits and a walk row by row, with edge rows and small segments."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from commentscan.llm import conversation_repair as CR
from tests.llm.test_dedup import edges  # noqa: F401

WHITE = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def brute(codes):
    """Every word of edits of up to one insert between rows and two at the begin, tried one by one."""
    best = None
    gaps = [["", "I", "II"] if k == 0 else ["", "I"] for k in range(len(codes) + 1)]
    for inserts in product(*gaps):
        for edits in product("KRD", repeat=len(codes)):
            audit, made, cost = inserts[0], inserts[0], 5 * len(inserts[0])
            for c, e, i in zip(codes, edits, inserts[1:], strict=True):
                audit += e + i
                made += (c.lower() if e == "K" else "R" if e == "R" else "") + i
                cost += COST[e] + 5 * len(i) + (5 if c.isupper() and e != "D" else 0)
                if c == "x" and e != "D":
                    cost = 10**6
            rest = made[1:] if made[:1] == "s" else made
            fits = len(rest) % 2 == 0 and all(r in ("IR" + "ua"[k % 2]) for k, r in enumerate(rest)) and (rest or not made)
            if fits and cost < 10**6 and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def walked(codes, start=CR.NOTHING, ends=CR.ACCEPTED):
    """Row by row over all states."""
    now = {start: (0, "")}

    def grow(found):
        for _ in range(4):
            for q, (c, a) in list(found.items()):
                to = CR.FOLLOWS[q]
                found[to] = min(found.get(to, (10**9, "")), (c + 5, a + "I"))
        return found

    for code in codes:
        after = {}
        for q, (c, a) in grow(now).items():
            for to, more, e in CR.edges(code)[q]:
                after[to] = min(after.get(to, (10**9, "")), (c + more, a + e))
        now = after
    return min((x for q, x in grow(now).items() if q in ends), default=None)


def by_hand(rows):
    """conv_id to the report, from rows as damaged."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, codes, counts = set(), "", dict.fromkeys(CR.COUNTS, 0)
        for k, (_, role, text) in enumerate(mine):
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            if k and mine[k - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
                counts["illegal"] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        cost, audit = walked(codes)
        turns = [t for t, _, _ in mine if t is not None]
        lines, left, state = [], list(mine), CR.NOTHING
        for e in audit:
            row = left.pop(0) if e != "I" else None
            if e == "K":
                state = CR.kept_state(state, row[1][:1])
                lines.append(f"{row[1]}:{row[2]}")
            elif e != "D":
                state = CR.FOLLOWS[state]
                lines.append(f"{CR.ROLES[state]}:{row[2] if row else ''}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def check(df, rows):
    want = by_hand(rows)
    names = ("gaps", *CR.COUNTS, "cost", "audit", "repaired_sha256")
    done = CR.repair_report(df).collect()
    assert len(done) == len(want)
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in done} == {c: w[:-1] for c, w in want.items()}
    lines = {c: [] for c in want}
    for r in sorted(CR.repaired(df).collect(), key=lambda r: r["pos"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert lines == {c: w[-1] for c, w in want.items()}


def test_search_tries_every_edit():
    rng = random.Random(1)
    for n in range(5):
        for _ in range(40):
            codes = "".join(rng.choice("suaoSUAOx") for _ in range(n))
            assert CR.repair(codes) == brute(codes) == walked(codes), codes


def test_search_equals_the_walk_and_segments_chain():
    rng = random.Random(2)
    for _ in range(150):
        codes = "".join(rng.choice(rng.choice(("ua", "suaoSUAOx", "uUx", "aA"))) for _ in range(rng.randrange(60)))
        assert CR.search(codes, CR.NOTHING, CR.ACCEPTED) == walked(codes)
        for p, q in ((0, 0), (0, 2), (1, 1), (1, 3), (2, 0), (2, 2), (3, 2), (3, 3), (2, 1)):
            assert CR.search(codes, p, [q]) == walked(codes, p, [q]), (codes, p, q)
        best = [(0, ""), None, None, None]
        cuts = sorted(rng.choices(range(len(codes) + 1), k=3))
        for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True):
            best = CR.chained(best, CR.ways(codes[a:b]))
        assert min(x for x in (best[0], best[3]) if x) == CR.repair(codes)


@pytest.mark.parametrize("segment", [1, 7, 512])
def test_report_over_tasks(spark, monkeypatch, segment):
    """A conversation of a third of all rows, repeated rows, null turns and roles, ranges that cut conversations."""
    monkeypatch.setattr(CR, "SEGMENT", segment)
    rng = random.Random(segment)
    texts = ["Yes.", "No!", "Well", "", " \t", "ok ok", "A longer one?", None, "é.", "x\ny."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "usher", "User"]
    rows = [(1, k // 2 if k % 5 else None, rng.choice(roles[:6]), rng.choice(texts) if k % 3 else f"{k}.") for k in range(150)]
    rows += [(2, 5, "user", "same.")] * 60
    rows += [(rng.choice([None, *range(3, 40)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(250)]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5), rows)


def test_damage(spark):
    rows = [(k, t, r, x) for k in (None, 0, 7, -3) for t in (None, *range(12)) for r, x in (("system", "a. b! c?"), (None, None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else x.translate({ord(p): None for p in ".!?"}) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in CR.damaged(df).collect())


def test_long_texts(spark):
    rows = [(1, 0, "user", "long text " * 300_000 + "."), (1, 1, "assistant", "y" * 2_000_000), (1, 2, "assistant", "Yes.")]
    check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows)


def test_edges(spark, edges):  # noqa: F811
    odd = edges.withColumnsRenamed({"doc_id": "conv_id"}).selectExpr("*", "size as turn", "row as role", "1 as no", "true as whole", "'k' as kind", "3 as cost", "4 as sha", "5 as gaps", "6 as audit", "7 as blank", "8 as seen", "9 as times", "10 as n")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in odd.collect()]
    check(odd, rows)
    assert CR.repair_report(odd.limit(0)).count() == CR.repaired(odd.limit(0)).count() == CR.damaged(odd.limit(0)).count() == 0
