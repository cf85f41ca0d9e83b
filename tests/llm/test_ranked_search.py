"""Ranked search against plain counting, with ties, copies, edge rows and bounds that must never lose a row."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from commentscan.llm import ranked_search as R
from tests.llm.test_dedup import edges  # noqa: F401


def terms_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(R.TERM, low)


def by_hand(docs, items, k=R.TOP):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


def check(spark, docs, items, k=R.TOP):
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(repr(tuple(r)) for r in R.search(d, q, k).collect()) == by_hand(docs, items, k)


def made_up(rng, n, n_words=300):
    words = [f"w{k}" for k in range(n_words)] + ["É", "é", "Straße", "x1", "X1"]
    share = [1 / (1 + k) for k in range(len(words))]
    texts = ["", None, "  ...", "W1 w1\tW1"]
    for _ in range(n):
        t = rng.choice((" ", ", ", "\n", "_")).join(rng.choices(words, share, k=rng.choice((1, 5, 40, 200))))
        texts += [t] * rng.choice((1, 1, 1, 4))
    return texts


@pytest.mark.parametrize(("leaf", "block"), [(2, 32), (4, 50), (32, 16_384)])
def test_the_best_of_all_documents(spark, monkeypatch, leaf, block):
    """Over leaves and blocks of several sizes; a third of all documents are copies."""
    monkeypatch.setattr(R, "LEAF", leaf)
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(leaf)
    texts = made_up(rng, 150)
    texts += ["the w3 w7 É same again w250"] * (len(texts) // 2)
    docs = [(None if k % 50 == 9 else k % 1000, t) for k, t in enumerate(texts)]
    rng.shuffle(docs)
    items = [(k, t) for k, t in enumerate(rng.sample(texts, 25))] + [(1, "w1 w1 w2"), (None, "é x1"), (7, None), (8, "unheard"), (9, "w250 w3")]
    check(spark, docs, items)
    check(spark, docs, items, 3)


def test_batches_of_items(spark, monkeypatch):
    monkeypatch.setattr(R, "ITEM_TERMS", 20)
    rng = random.Random(5)
    texts = made_up(rng, 40)
    check(spark, list(enumerate(texts)), list(enumerate(rng.sample(texts, 20))))


@pytest.mark.parametrize("sizes", [(30, 50), (7, 7, 7, 130), (64, 64), (20, 44, 1)])
def test_each_row_is_in_one_block(monkeypatch, sizes):
    """However the batches of a task lie to its blocks."""
    monkeypatch.setattr(R, "BLOCK", 64)
    ids, batches = iter(range(sum(sizes))), []
    for n in sizes:
        cuts = pa.array(np.arange(n + 1), pa.int32())
        one = pa.ListArray.from_arrays(cuts, pa.array([0] * n, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array([1] * n, pa.int32()))
        batches.append(pa.RecordBatch.from_arrays([pa.array([next(ids) for _ in range(n)]), pa.array([1] * n), *one], names=["doc_id", "n", "at", "tf"]))
    blocks = list(R._blocks(batches, R.Task(100, 100, np.array([5]), [], 20)))
    assert sorted(i for b in blocks for i in b.ids) == list(range(sum(sizes)))
    assert max(len(b.ids) for b in blocks) <= 64


def test_tasks_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        rng = random.Random(8)
        texts = made_up(rng, 200)
        check(spark, list(enumerate(texts)), list(enumerate(rng.sample(texts, 20))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bounds_hold_and_subtrees_are_pruned():
    """No row of a node scores above the node's bound; of documents on different subjects most are not scored."""
    rng = np.random.default_rng(3)
    n_terms, n = 400, 3000
    subject = rng.integers(0, 20, n)
    at = [np.unique(np.concatenate([rng.integers(0, 20, 3) + 20 * s, rng.integers(0, n_terms, 1)])) for s in subject]
    cuts = np.concatenate([[0], np.cumsum([len(a) for a in at])])
    flat = np.concatenate(at)
    tf = rng.integers(1, 4, len(flat))
    df = np.bincount(flat, minlength=n_terms)
    weights = np.array([R.weight(n, int(x)) for x in df])
    task = R.Task(n, int(tf.sum()), weights, [], 5)
    x = task.values(tf, np.repeat(np.add.reduceat(tf, cuts[:-1]), np.diff(cuts)))
    block, scored = R.Block(task, list(range(n)), cuts, flat, x), 0
    dense = np.zeros((n, n_terms), np.int64)
    dense[np.repeat(np.arange(n), np.diff(cuts)), flat] = x
    per_term = np.zeros(n_terms, np.int64)
    for s in range(20):
        terms, times = np.arange(20 * s, 20 * s + 5), np.array([1, 2, 1, 1, 3])
        scores = dense[:, terms] @ (times * weights[terms])
        bounds = block.bounds(terms, times)
        for node, (a, b) in enumerate(block.spans):
            assert scores[block.ids[a:b]].max() <= bounds[node]
        best, seen = block.search(terms, times, [], per_term)
        scored += seen
        assert best == sorted((-int(v), k) for k, v in enumerate(scores) if v)[:5] and not per_term.any()
    assert scored < 20 * n / 2


def test_long_texts(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choices(["a", "b", "c", "É"], k=n))) for k, n in enumerate((3, 400_000, 1_000_000, 7))] + [(9, "z" * 3_000_000)]
    check(spark, docs, [(0, "a É"), (1, docs[1][1]), (2, "z" * 3_000_000)])


def test_edges(spark, edges):  # noqa: F811
    items = edges.withColumnRenamed("doc_id", "item_id").selectExpr("*", "1 as qn", "2 as terms", "3 as rank", "4 as doc_id")
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    done = R.search(edges.selectExpr("*", "5 as data", "6 as n", "7 as docs"), items)
    assert sorted(repr(tuple(r)) for r in done.collect()) == by_hand(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert R.search(edges.limit(0), items).count() == R.search(edges, items.limit(0)).count() == 0
    blank = edges.selectExpr("doc_id", "'' as text")
    assert R.search(blank, items).count() == 0
