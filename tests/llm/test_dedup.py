"""Line, near-copy and substring dedup against brute force, with edge rows."""

import hashlib
import random

import numpy as np
import pytest

from commentscan.llm import components as C
from commentscan.llm import embedding_dups as E
from commentscan.llm import line_dedup as LD
from commentscan.llm import simhash as SH
from commentscan.llm import substring_dedup as SD

ROWS = [
    (1, "z A b c d e f g h i j", "x"), (None, "a b c d e f g h i j", "z"), (1, "z A b c d e f g h i j", "x"), (2, None, "z"), (3, "", "z"),
    (None, "k l m n o p", None), (7, "a b c d e x g h", None),
]


@pytest.fixture(scope="module")
def edges(spark):
    """Null ids, texts and columns, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, row string").selectExpr("*", "'q' as id", "1 as pos", "2 as fp", "3 as score", "4 as epoch",
        "5 as spans", "6 as base_spans", "7 as held_out", "8 as predicted", "9 as n_words", "10 as size", "11 as taken", "12 as text_key", "13 as id_key", "14 as stamp", "15 as key", "16 as rules", "17 as part", "18 as first", "19 as n_dropped")


def made_up(rng, n):
    """Documents of words with passages, lines and copies in common."""
    words = [f"w{k}" for k in range(400)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(8, 40))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(rng.randrange(0, 6))]
        out.append(rng.choice((" ", "\n", "\n\n")).join(parts))
        if out and rng.random() < 0.2:
            out.append(rng.choice(out))
    return out[:n]


# Lines


def lines_by_hand(rows):
    white = " \t\n\x0b\x0c\r"
    order = lambda i: (i is None, i)
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(white))
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), i), i, key=order)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_lines(spark, monkeypatch, hot):
    rng = random.Random(2)
    rows = [(k // 2 if k % 7 else None, t) for k, t in enumerate(made_up(rng, 60))] + [(5, "ÄÖ Common LINE\n x \nÄÖ common line"), (6, " äö Common line\t"), (6, "ÄÖ COMMON line")]
    if hot:
        monkeypatch.setattr(LD, "hot_keys", lambda lines: [r["h1"] for r in lines.groupBy("h1").count().filter("count > 3").collect()])
    done = LD.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in done])) == sorted(map(repr, lines_by_hand(rows)))


def test_lines_edges(spark, edges):
    done = LD.dedup_lines(edges)
    assert done.count() == len(ROWS) and all(r["n_lines"] == 1 for r in done.collect())
    assert LD.dedup_lines(edges.limit(0)).count() == 0
    names = [f.name for f in LD.line_bitmaps(edges).schema]
    assert names == ["doc_id", "text_key", "n_dropped", "dropped_runs"]


def test_hot_keys_are_found(spark):
    rows = spark.range(20000).selectExpr("if(id % 3 = 0, 7, id + 100) as h1")
    assert LD.hot_keys(rows) == [7]


# Fingerprints


def test_fingerprint_by_hand():
    import xxhash

    def plain(t):
        w = t.encode().lower().split()
        if not w:
            return 0
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ("", " \t", "a", "A b", "a B c", "a b c d", "É x\x0by z É x", "p q r " * 50):
        assert SH.fingerprint_of(t.encode()) % 2**64 == plain(t)


def closure(linked, labels):
    labels = np.array(labels)
    while True:
        new = np.array([labels[row].min() for row in linked])
        if (new == labels).all():
            return labels
        labels = new


@pytest.mark.parametrize("block", [50, 200_000])
def test_trie_join(spark, monkeypatch, block):
    monkeypatch.setattr(SH, "BLOCK", block)
    rng = np.random.default_rng(1)
    values = []
    for base in rng.integers(0, 2**63, 30, dtype=np.uint64):
        for _ in range(25):
            v = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                v ^= 1 << int(k)
            values.append(v)
    near_one = [int(rng.integers(0, 2**48)) for _ in range(150)]  # share a quarter
    values = np.unique(np.array(values + near_one, np.uint64))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in C.components(SH.near_fingerprints(fps)).collect()}
    linked = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    want = closure(linked, values.view(np.int64))
    assert [got.get(v, v) for v in values.view(np.int64).tolist()] == want.tolist()


def test_simhash_groups(spark, edges):
    rows = {(r["doc_id"], r["text_key"]): r for r in SH.simhash_groups(edges).collect()}
    empty = [r for r in rows.values() if r["fp"] == 0]
    assert {r["doc_id"] for r in empty} == {2, 3} and {r["component_id"] for r in empty} == {2}
    assert SH.simhash_groups(edges).count() == len(ROWS)
    kept = SH.keep_one_of_each(edges)
    assert kept.columns == edges.columns and kept.count() == 5
    assert SH.keep_one_of_each(edges.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, 500 + k) for k in range(1, 60)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in {y for p in links if p[0] != p[1] for y in p}}


# Substrings


def substrings_by_hand(rows):
    order = lambda i: SD.LAST_ID if i is None else i
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for s in range(len(w) - 12):
            k = tuple(w[s : s + 13])
            first[k] = min(first.get(k, SD.LAST_ID), order(i))
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < order(i):
                gone.update(range(s, s + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages_rows():
    rng = random.Random(3)
    long = " ".join(rng.choices([f"w{k}" for k in range(400)], k=9000))
    rows = [(k // 2 if k % 9 else None, t) for k, t in enumerate(made_up(rng, 80))] + [(90, "on " * 40), (91, "x " + "on " * 30), (92, None), (93, "")]
    rows += [(94, long), (95, "a b " + long), (96, long[9000:]), (97, "on " * 40 + long[:4000] + " on" * 30)]
    # Texts of one id, or of none, that share the words before a passage of an earlier document.
    passage = " ".join(f"p{k}" for k in range(20))
    return rows + [(98, "q r s " + passage), (None, "x y z " + passage + " one"), (None, "x y z " + passage + " two"), (99, "t u " + passage), (99, "t u " + passage + " more")]


@pytest.mark.parametrize(("most", "load"), [(0, 5), (3, 100_000), (2000, 100_000), (2000, 5)])
def test_substrings(spark, monkeypatch, most, load):
    monkeypatch.setattr(SD, "MAX_CONTEXTS", most)
    monkeypatch.setattr(SD, "LOAD", load)
    rows = passages_rows()
    done = SD.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in done])) == sorted(map(repr, substrings_by_hand(rows)))
    for r in done:
        assert sum(b - a for a, b in r["removed"]) == r["n_removed"]


@pytest.mark.parametrize("most", [0, 2000])
@pytest.mark.parametrize("bits", [3, 8])
def test_no_hash_alone_removes_words(spark, monkeypatch, most, bits):
    """With hashes that collide all the time, passages are missed but nothing goes that no earlier document holds."""
    monkeypatch.setattr(SD, "MAX_CONTEXTS", most)
    rows = [(k, t) for k, (_, t) in enumerate(passages_rows())]
    done = {r["doc_id"]: r for r in SD.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), bits).collect()}
    held, removed = set(), 0
    for i, t in rows:
        words = (t or "").split()
        windows = [tuple(words[s : s + 13]) for s in range(len(words) - 12)]
        covered = {k for s, w in enumerate(windows) if w in held for k in range(s, s + 13)}
        gone = {k for a, b in done[i]["removed"] for k in range(a, b)}
        assert gone <= covered
        removed += len(gone)
        held.update(windows)
    assert removed > 0 or bits == 3


def test_substrings_edges(spark, edges):
    assert SD.dedup_substrings(edges).count() == len(ROWS)
    assert SD.dedup_substrings(edges.limit(0)).count() == 0


def test_suffix_automaton():
    rng = random.Random(5)
    for _ in range(40):
        passages = [[rng.choice("abc") for _ in range(rng.randrange(1, 15))] for _ in range(3)]
        automaton = SD.SuffixAutomaton()
        for p in passages:
            automaton.add(p)
        inside = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        text = [rng.choice("abcd") for _ in range(20)]
        want = [max((n for n in range(e + 2) if n == 0 or tuple(text[e + 1 - n : e + 1]) in inside), default=0) for e in range(len(text))]
        assert list(automaton.matching(text)) == want


# Embeddings


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 60)
    monkeypatch.setattr(E, "CELL", 80)
    monkeypatch.setattr(E, "CHUNK", 25)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + rng.normal(size=(k, 8)) * s for c, k, s in zip(centres, (60, 30, 1, 20, 40, 9, 9, 50, 3, 3, 3, 90), (0.05, 0.3, 1, 0.6, 0.2, 0.5, 2, 0.4, 1, 1, 1, 0.02), strict=True)])
    x = np.concatenate([x, x[:15], x[5:6] * 3])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in E.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    want = closure(linked, ids)
    assert [got[i]["n_links"] for i in ids] == (linked.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in ids] == want.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def by_hand(x, ids, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= cosine
    return {int(i): (int(n) - 1, int(c)) for i, n, c in zip(ids, linked.sum(1), closure(linked, ids), strict=True)}


def test_embeddings_in_clusters_of_clusters(spark, monkeypatch):
    """Pivots on several levels, blocks of a hot cell, and every pair found that brute force finds."""
    monkeypatch.setattr(E, "BLOCK", 40)
    monkeypatch.setattr(E, "CELL", 4)
    rng = np.random.default_rng(9)
    top = rng.normal(size=(5, 16))
    middle = np.concatenate([t + 0.5 * rng.normal(size=(6, 16)) for t in top])
    x = np.concatenate([m + s * rng.normal(size=(k, 16)) for m, s, k in zip(middle, [0.02, 0.1, 0.2, 0.3, 0.4] * 6, [9, 12, 15, 3, 130, 9] * 5, strict=True)])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    router = E._routers(E._classes(df)[2], 0.447)[16]
    depth = lambda at: 1 + max(map(depth, router.nodes[at][1])) if router.nodes[at] else 0
    assert depth(0) >= 2
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df).collect()}
    assert got == by_hand(x, ids)


@pytest.mark.parametrize("clusters", [3, 0])
def test_blocks_in_groups(spark, monkeypatch, clusters):
    """However many blocks a group has, the links are the same; vectors travel less often."""
    monkeypatch.setattr(E, "BLOCK", 10)
    monkeypatch.setattr(E, "CELL", 40)
    monkeypatch.setattr(E, "VISITS", 500)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 6))
    if clusters:  # a hot cell of many blocks, and others
        x = rng.normal(size=(clusters, 6))[np.minimum(rng.integers(0, 6, 900), clusters - 1)] + 0.2 * x
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent = []
    for most in (1, 3, 8):
        monkeypatch.setattr(E, "gathered", lambda blocks, tasks, most=most: most)
        sent.append(E._paired(E._classes(df)[2], 0.9)[0].count())
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df).collect()}
        assert got == by_hand(x, np.arange(len(x)))
    assert sent[0] > 1.5 * sent[1] and sent[1] > 1.2 * sent[2]


def test_groups_leave_work_to_every_task():
    assert [E.gathered(b, 24) for b in (1, 9, 60, 120, 10**6)] == [1, 1, 2, 4, E.GATHER]


def test_embeddings_of_many_lengths(spark):
    rng = np.random.default_rng(10)
    rows = []
    for length in range(1, 1101):
        v = rng.normal(size=length)
        rows += [(2 * length, v.tolist()), (2 * length + 1, (v + 0.01).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df).collect()}
    assert len(got) == 2200
    for length in range(1, 1101):
        pair = np.array([rows[2 * length - 2][1], rows[2 * length - 1][1]])
        assert {k: got[k] for k in (2 * length, 2 * length + 1)} == by_hand(pair, [2 * length, 2 * length + 1])


def test_embeddings_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (None, [2.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (10, []), (11, [3.0]), (12, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as weight")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in E.near_vectors(df).collect())
    lone = [(i, 0, i, True) for i in (5, 6, 7, 8, 10, 12)]
    assert got == sorted([(0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (9, 1, 9, True), (11, 1, 9, False), *lone])
    assert E.near_vectors(df.limit(0)).count() == 0


def test_digest_of_kept_text(spark):
    df = spark.createDataFrame([(1, "a  b\tc")], "doc_id long, text string")
    assert hashlib.sha256(b"a b c").hexdigest() == hashlib.sha256(SD.dedup_substrings(df).first()["kept_text"].encode()).hexdigest()
