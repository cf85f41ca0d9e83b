"""Exact dedup against plain dictionaries, with edge rows, huge documents and fingerprints that collide."""

import hashlib
import random

import numpy as np

from commentscan.llm import exact_dedup as X
from tests.llm.test_dedup import edges  # noqa: F401


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def by_hand(rows):
    least = lambda i: (i is not None, i or 0)
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    return sorted(
        (repr(i), repr(max(groups[lowered(t)], key=least)), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows
    )


def check(df, rows, **more):
    done = X.copies(df, **more).collect()
    assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in done) == by_hand(rows)
    assert sorted(r["text_sha256"] for r in done if r["kept"]) == sorted({hashlib.sha256(lowered(t).encode()).hexdigest() for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in done if r["kept"])


def made_up(rng, n):
    texts = ["", None, "A", "a", "É", "é", "\x00", "\x00\x00"]
    for _ in range(n):
        t = "".join(rng.choice("abAB éß\n") for _ in range(rng.choice((1, 3, 511, 512, 513, 1024, 3000))))
        texts += [t] * rng.choice((1, 1, 2, 5)) + [t.swapcase()] * rng.choice((0, 1)) + [t[:-1] + "z"] * rng.choice((0, 1))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(None if i % 17 == 3 else i // 2 if i % 5 == 0 else i, t) for i, t in zip(ids, texts, strict=True)]


def test_fingerprints_are_polynomials_and_compose():
    rng, hasher = random.Random(1), X.Hasher()
    parts = [rng.randbytes(n) for n in (0, 1, 2, 511, 512, 513, 5000, 0, 7)]
    cuts = np.cumsum([0, *map(len, parts)])
    got = hasher.of(np.frombuffer(b"".join(parts), np.uint8), cuts)
    for data, found in zip(parts, got, strict=True):
        assert found.tolist() == [sum(c * pow(p, len(data) - 1 - k, X.PRIME) for k, c in enumerate(data)) % X.PRIME for p in X.POINTS]
    whole = hasher.of(np.frombuffer(b"".join(parts), np.uint8), cuts[[0, -1]])[0]
    behind = cuts[-1] - cuts[1:]
    assert (sum(X.shifted(f, int(b)) for f, b in zip(got, behind, strict=True)) % X.PRIME == whole).all()


def test_groups_are_those_of_equal_texts(spark):
    rows = made_up(random.Random(2), 60)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_parts_of_huge_documents_add_up(spark, monkeypatch):
    """With bounds so small that most documents are cut up and compared over many pieces."""
    rows = made_up(random.Random(3), 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {(r["h"], r["n_bytes"]): (r["fp_a"], r["fp_b"]) for r in X.fingerprints(df).collect()}
    for name, value in (("HUGE", 100), ("PART", 64), ("PIECE", 50)):
        monkeypatch.setattr(X, name, value)
    assert {(r["h"], r["n_bytes"]): (r["fp_a"], r["fp_b"]) for r in X.fingerprints(df).collect()} == whole
    check(df, rows)


def test_colliding_fingerprints_are_told_apart(spark):
    """With two bits of each hash, many different texts of one length share a key."""
    rows = made_up(random.Random(4), 60)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, bits=1)


def test_long_texts(spark):
    long = "Lorem é ipsum " * 200_000
    rows = [(1, long), (2, long.upper().replace("É", "é")), (3, long[:-1]), (4, "x" + long[1:])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_edges(spark, edges):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    check(edges, rows)
    assert X.copies(edges.limit(0)).count() == 0
    kept = X.keep_one_of_each(edges)
    assert kept.columns == edges.columns and sorted(lowered(r["text"]) for r in kept.collect()) == sorted({lowered(t) for _, t in rows})
