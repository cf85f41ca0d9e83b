"""Ranked lexical search: exact inner products by sparse ball trees.

A document is a sparse vector of integers (how much each of its terms would add to a score, by its length), an item one of
term weights; a score is their inner product. The items' terms are counted in every document in one pass; what other
terms a vector has cannot change a product, so only those are kept. Documents are then taken in blocks. A block's ball tree
halves it along its two farthest points, down to leaves; every node has a centre and the radius around it. For any vector x
of a node, <q, x> <= <q, centre> + |q| * radius, rounded up so that no rounding can lose a row; a subtree whose bound is below
an item's k-th best score so far is pruned, and the others are opened best first. Leaves are scored in integers.

Coordinates are stretched by the root of the term's weight, and items shrunk by as much, which changes no product but keeps
frequent words, of little weight, from making all balls wide.

Each task returns k rows an item at most. Items are searched in batches of at most ITEM_TERMS terms or so; a batch is what the
driver holds and sends to tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What a term is made of: ASCII letters and digits, and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: For UTF-8: other ASCII characters become blanks, and A-Z lower case.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
TOP = 20
#: Different terms of a batch's items, counted item by item, on average.
ITEM_TERMS = 200_000
#: Documents of a leaf; numbers in the centres of a block's nodes, which sets the documents of a block, so many at most.
LEAF, CENTRES, BLOCK = 32, 4_000_000, 16_384
#: Relative room for rounding in doubles, far above the error of a sum of a million products.
SLACK = 1e-9


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Counts:
    """What tasks need to read documents: the number of each term of the items, from 1."""

    def __init__(self, terms: Iterable[str]):
        self.number = {t.encode(): k for k, t in enumerate(terms, 1)}


def _counted(counts):
    """Documents (doc_id, data) to (doc_id, n, docs, at, tf): those with terms of the items, each with their numbers and how
    often they occur; and a row for the rest of a batch, with sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = counts.value.number
        stride = len(number) + 1
        for batch in batches:
            lengths, found, owner = [], [], []
            for k, data in enumerate(batch.column("data").to_pylist()):
                terms = data.translate(FOLD).split()
                lengths.append(len(terms))
                mine = list(filter(None, map(number.get, terms)))
                found += mine
                owner.append(np.full(len(mine), k, np.int64))
            n = np.array(lengths, np.int64)
            pairs, tf = np.unique(np.concatenate([*owner, np.zeros(0, np.int64)]) * stride + np.array(found, np.int64), return_counts=True)
            docs, cuts = np.unique(pairs // stride, return_index=True)
            cuts = np.append(cuts, len(pairs)).astype(np.int32)
            rest = np.ones(len(n), bool)
            rest[docs] = False
            at = pa.ListArray.from_arrays(pa.array(cuts), pa.array((pairs % stride - 1).astype(np.int32)))
            tfs = pa.ListArray.from_arrays(pa.array(cuts), pa.array(tf.astype(np.int32)))
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs)), pa.array(n[docs]), pa.array(np.ones(len(docs), np.int64)), at, tfs], names=list(_COUNTED))
            empty = pa.array([[]], pa.list_(pa.int32()))
            sums = [pa.array([int(n[rest].sum())]), pa.array([int((n[rest] > 0).sum())])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), *sums, empty, empty], names=list(_COUNTED))

    return run


_COUNTED = ("doc_id", "n", "docs", "at", "tf")


class Task:
    """What tasks need to search: weights of terms, sums over all documents, and the items' terms and how often each has them."""

    def __init__(self, n_docs: int, n_terms: int, weights: np.ndarray, items: list[tuple[int, np.ndarray, np.ndarray]], k: int):
        self.n_docs, self.n_terms, self.weights, self.items, self.k = n_docs, n_terms, weights, items, k
        self.stretch = np.sqrt(np.maximum(weights, 1).astype(np.float64))

    def values(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term adds, for each unit of its weight, that stands tf times in a document of n terms."""
        m = 100 - 25 + (25 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Block:
    """Some documents: their terms (cuts, at, x), in the order of the leaves of their ball tree."""

    def __init__(self, task: Task, ids: list, cuts: np.ndarray, at: np.ndarray, x: np.ndarray):
        self.task, self.ids, self.cuts, self.at, self.x = task, ids, cuts, at, x
        self.present = np.bincount(at, minlength=len(task.weights)) > 0
        self.columns = np.flatnonzero(self.present)
        self.column = np.zeros(len(task.weights), np.int64)
        self.column[self.columns] = np.arange(len(self.columns))
        self.y = x * task.stretch[at]
        self.norms = np.add.reduceat(self.y * self.y, cuts[:-1])
        self.order: list[np.ndarray] = []
        self.centres, self.radii, self.most, self.below, self.spans = [], [], [], [], []
        self._grow(np.arange(len(ids)))
        self.centres, self.radii, self.most = np.array(self.centres), np.array(self.radii), np.array(self.most)
        order = np.concatenate(self.order)
        entries = self._entries(order)
        lengths = np.diff(self.cuts)[order]
        self.ids = [ids[k] for k in order.tolist()]
        self.cuts, self.at, self.x = np.concatenate([[0], np.cumsum(lengths)]), at[entries], x[entries]

    def _entries(self, rows: np.ndarray) -> np.ndarray:
        lengths = (self.cuts[1:] - self.cuts[:-1])[rows]
        return np.repeat(self.cuts[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())

    def _grow(self, rows: np.ndarray) -> int:
        """The number of a node over some rows, after those of its children were made."""
        entries = self._entries(rows)
        column, y = self.column[self.at[entries]], self.y[entries]
        starts = np.concatenate([[0], np.cumsum((self.cuts[1:] - self.cuts[:-1])[rows])[:-1]])
        squares = self.norms[rows]

        def distances(point: np.ndarray) -> np.ndarray:
            """From a point, rounded up."""
            size = float(point @ point)
            inner = np.add.reduceat(point[column] * y, starts)
            return np.sqrt(np.maximum(0, squares - 2 * inner + size) + SLACK * (squares + size))

        def row(k: int) -> np.ndarray:
            point, part = np.zeros(len(self.columns)), slice(starts[k], starts[k] + self.cuts[rows[k] + 1] - self.cuts[rows[k]])
            point[column[part]] = y[part]
            return point

        centre = (np.bincount(column, y, len(self.columns)) / len(rows)).astype(np.float32)
        away = distances(centre.astype(np.float64))
        below = None
        if len(rows) > LEAF and away.max() ** 2 > 4 * SLACK * squares.max():  # else all are copies
            a = row(int(away.argmax()))
            from_a = distances(a)
            nearer = from_a - distances(row(int(from_a.argmax())))
            order = np.argsort(nearer, kind="stable")
            # The cut is where the nearer end changes, but no side gets less than an eighth, so that the tree stays low.
            cut = int(np.clip(np.searchsorted(nearer[order], 0), len(rows) // 8, len(rows) - len(rows) // 8))
            below = (self._grow(rows[order[:cut]]), self._grow(rows[order[cut:]]))
            span = (self.spans[below[0]][0], self.spans[below[1]][1])
            most = np.maximum(self.most[below[0]], self.most[below[1]])
        else:
            most = np.zeros(len(self.columns), np.float32)  # whole numbers of six digits
            np.maximum.at(most, column, self.x[entries].astype(np.float32))
            begin = sum(map(len, self.order)) if not self.spans else self.spans[-1][1]
            span = (begin, begin + len(rows))
            self.order.append(rows)
        self.centres.append(centre)
        self.radii.append(float(away.max()))
        self.most.append(most)
        self.below.append(below)
        self.spans.append(span)
        return len(self.spans) - 1

    def bounds(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """No row of a node scores more."""
        shrunk, held = times * self.task.weights[terms] / self.task.stretch[terms], self.present[terms]
        columns, added = self.column[terms[held]], (times * self.task.weights[terms])[held].astype(np.float64)
        products = self.centres[:, columns].astype(np.float64) @ shrunk[held]
        ball = (products + math.sqrt(float(shrunk @ shrunk)) * self.radii) * (1 + SLACK) + 1
        return np.minimum(ball, self.most[:, columns].astype(np.float64) @ added * (1 + SLACK))

    def search(self, terms: np.ndarray, times: np.ndarray, best: list, per_term: np.ndarray) -> tuple[list, int]:
        """best, the k best (score, doc_id) of an item so far, sorted, with those of this block; and how many rows were scored."""
        k, scored = self.task.k, 0
        bounds = self.bounds(terms, times)
        top = len(self.spans) - 1
        heap = [(-bounds[top], top)]
        per_term[terms] = times * self.task.weights[terms]
        while heap and not (len(best) == k and -heap[0][0] < -best[-1][0]):
            bound, node = heapq.heappop(heap)
            if self.below[node]:
                for child in self.below[node]:
                    heapq.heappush(heap, (max(bound, -bounds[child]), child))  # no child's bound is above its parent's
                continue
            a, b = self.spans[node]
            part = slice(self.cuts[a], self.cuts[b])
            scores = np.add.reduceat(per_term[self.at[part]] * self.x[part], self.cuts[a:b] - self.cuts[a])
            scored += b - a
            least = -best[-1][0] if len(best) == k else 1
            for r in np.flatnonzero(scores >= least).tolist():
                best.append((-int(scores[r]), self.ids[a + r]))
            best = sorted(best, key=_order)[:k]
        per_term[terms] = 0
        return best, scored


def _order(row: tuple) -> tuple:
    return row[0], row[1] is None, row[1] or 0


def _searched(task, kind: pa.DataType):
    """Vectors to (qn, doc_id, score), the best of all that one task reads."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = task.value
        best: dict[int, list] = {}
        per_term = np.zeros(len(known.weights), np.int64)
        for block in _blocks(batches, known):
            for qn, terms, times in known.items:
                found, _ = block.search(terms, times, best.get(qn, []), per_term)
                if found:
                    best[qn] = found
        rows = [(qn, i, -s) for qn, found in best.items() for s, i in found]
        for at in range(0, len(rows), 10_000):
            qn, ids, scores = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(qn, pa.int64()), pa.array(ids, kind), pa.array(scores, pa.int64())], names=["qn", "doc_id", "score"])

    return run


def _blocks(batches: Iterable[pa.RecordBatch], task: Task) -> Iterator[Block]:
    size = max(LEAF, min(BLOCK, CENTRES * LEAF // (2 * max(1, len(task.weights)))))
    held, n_held = [], 0

    def block() -> Block:
        ids = [i for part in held for i in part[0]]
        lengths, n, at, tf = (np.concatenate([part[k] for part in held]) for k in range(1, 5))
        return Block(task, ids, np.concatenate([[0], np.cumsum(lengths)]), at, task.values(tf, np.repeat(n, lengths)))

    for batch in batches:
        first = 0
        while first < len(batch):
            part = batch.slice(first, size - n_held)  # what still fits; a batch may begin or end amid a block
            first += len(part)
            at, tf = part.column("at"), part.column("tf")
            held.append((part.column("doc_id").to_pylist(), at.value_lengths().to_numpy().astype(np.int64), part.column("n").to_numpy(), at.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)))
            n_held += len(part)
            if n_held >= size:
                yield block()
                held, n_held = [], 0
    if held:
        yield block()


def _item_batch(rows) -> tuple[Counts, list[tuple[int, list[str], list[int]]]]:
    items = [(r["qn"], Counter(r["terms"])) for r in rows]
    return Counts(sorted({t for _, c in items for t in c})), [(qn, list(c), list(c.values())) for qn, c in items]


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Each item's k best documents with a score above 0: item_id, rank, doc_id, score.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Equal scores go by ascending doc_id, null last. Every row
    of docs is a document and every row of items an item: rows that repeat an id are ranked each on its own, an item's
    rows get ranks of their own. Null and empty texts have no terms; such documents count for nothing, such items find
    nothing. Texts may have any length. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    asked = items.select(items["item_id"].alias("item_id"), F.regexp_extract_all(common.ascii_lower(common.text_or_empty(items)), F.lit(TERM), 0).alias("terms"))
    asked = common.written(asked.filter(F.size("terms") > 0).withColumn("qn", F.monotonically_increasing_id()), "items")
    n_batches = (asked.agg(F.sum(F.size(F.array_distinct("terms")))).first()[0] or 0) // ITEM_TERMS + 1
    text = docs.select(docs["doc_id"].alias("doc_id"), common.text_or_empty(docs).cast("binary").alias("data"))
    kind = dict(text.dtypes)["doc_id"]
    parts = []
    for batch in range(n_batches):
        rows = asked.filter(F.pmod(F.xxhash64("qn"), F.lit(n_batches)) == batch).select("qn", "terms").collect()  # ITEM_TERMS terms or so
        counts, named = _item_batch(rows)
        sent = spark.sparkContext.broadcast(counts)
        schema = f"doc_id {kind}, n long, docs long, at array<int>, tf array<int>"
        vectors = common.written(text.mapInArrow(_counted(sent), schema), "vectors")
        n_docs, n_terms = vectors.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = vectors.select(F.explode("at").alias("term")).groupBy("term").count().collect()  # a row for each term of the batch
        weights = np.zeros(len(counts.number), np.int64)
        for r in df:
            weights[r["term"]] = weight(n_docs, r["count"])
        number = lambda terms: np.array([counts.number[t.encode()] - 1 for t in terms], np.int64)  # noqa: B023, E731
        task = spark.sparkContext.broadcast(Task(n_docs, n_terms, weights, [(qn, number(terms), np.array(times, np.int64)) for qn, terms, times in named], k))
        arrow = vectors.limit(0).select("doc_id").toArrow().schema.field("doc_id").type
        found = vectors.filter(F.size("at") > 0).select("doc_id", "n", "at", "tf").mapInArrow(_searched(task, arrow), f"qn long, doc_id {kind}, score long")
        best = Window.partitionBy("qn").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = common.written(found, "found").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        parts.append(ranked)
        common.drop(vectors)
    every = reduce(DataFrame.unionByName, parts)
    return every.join(asked.select("qn", "item_id"), "qn").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir):
    return search(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")), common.table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH doc_terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), sums AS (
  SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM doc_terms
), sized AS (
  SELECT doc_id, terms, 75 + (25 * len(terms) * n_docs) // n_terms AS m FROM doc_terms, sums WHERE len(terms) > 0
), counted AS (
  SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM sized) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), sums
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM items JOIN counted USING (term) JOIN weights USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
