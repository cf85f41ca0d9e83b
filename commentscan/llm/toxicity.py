"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, a hash sample of all documents the unlabelled ones. A linear model over
counts of words and word beginnings minimises the class-prior-corrected logistic risk: the positives' share is taken
out of the unlabelled risk, and where that estimate turns negative its gradient is reversed, so it cannot overfit.
Spark counts in how many sampled documents each hashed feature occurs and picks the telling ones; numpy fits the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .quality import remainder, training_rows

#: A score of at least CUT predicts label 1.
CUT = 0.3
#: Most positives and unlabelled documents to train on (those with the smallest hashes), and most features.
MAX_POSITIVES, MAX_UNLABELLED, MAX_FEATURES = 4_000, 12_000, 1024
#: Bytes of the word beginnings, and the feature hash's size.
BEGINNINGS = (4, 6, 8)
DIM = 1 << 20
#: Prior if no labelled row says otherwise.
PRIOR = 0.1
MEMO = 300_000

_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def distinct_words(data: bytes) -> set[bytes]:
    """Lower-case words, parted by anything but ASCII letters, digits and bytes of other scripts."""
    return set(data.decode(errors="replace").lower().encode().translate(_BLANK).split())


def word_features(word: bytes) -> list[int]:
    parts = [b"=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(p) % DIM for p in parts]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Rows of numbers as one Arrow array, without a Python object for each number."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, kind.to_pandas_dtype())]), kind))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def feature_ids(texts: pa.Array) -> pa.Array:
    def ids(data: bytes) -> np.ndarray:
        return np.unique(np.fromiter((f for w in distinct_words(data) for f in word_features(w)), np.int32))

    return _lists([ids(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], pa.int32())


class Counter:
    """Logarithmic counts of the chosen features among a text's distinct words, and of those words at the end.

    Long texts hold more of any feature by chance; the last number lets the model allow for that. Remembers words it has seen.
    """

    def __init__(self, chosen: list[int]):
        self.place = {f: k for k, f in enumerate(chosen)}
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, data: bytes) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        hits: list[int] = []
        words = distinct_words(data)
        for word in words:
            found = self.memo.get(word)
            if found is None:
                found = self.memo[word] = tuple(self.place[f] for f in word_features(word) if f in self.place)
            hits += found
        counts = np.bincount(np.array(hits, np.int64), minlength=len(self.place) + 1)
        counts[-1] = len(words)
        return np.log1p(counts)


def fit(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), by Adam."""
    p, u = x[positive].astype(np.float32), x[~positive].astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    if not len(p) or not len(u):
        return w, b
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    loss = lambda z: np.logaddexp(0, z)  # noqa: E731  of being scored z and negative
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = loss(zu).mean() - prior * loss(zp).mean()
        up, uu = sp / len(p), su / len(u)  # of the negative losses
        if negative >= 0:
            cp, cu = prior * ((sp - 1) / len(p) - up), uu
        else:
            cp, cu = prior * up, -uu
        g = np.r_[p.T @ cp.astype(np.float32) + u.T @ cu.astype(np.float32) + ridge * w, cp.sum() + cu.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    return w, b


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(text, positive) of the training documents, in the shared folder, and the class prior."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1))
    known = known.filter(remainder(F.col("doc_id"), 4) != 2)
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    positives = training_rows(known.filter("toxic = 1"), "toxic", 4, 2, MAX_POSITIVES).select("id").distinct().withColumn("positive", F.lit(True))
    mine = docs.filter(remainder(docs["doc_id"], 4) != 2)
    unlabelled = mine.select(mine["doc_id"].alias("id")).distinct().orderBy(F.xxhash64(F.lit("u"), "id"), "id").limit(MAX_UNLABELLED).withColumn("positive", F.lit(False))
    rows = common.written(positives.unionByName(unlabelled), "toxicity-ids")
    text = common.text_or_empty(docs)
    joined = docs.select(docs["doc_id"].alias("id"), text.alias("text"), F.xxhash64(text).alias("key")).join(F.broadcast(rows), "id")  # at most the two limits
    # One text an id; they are dealt by id, so no task gets more than its share.
    sample = joined.groupBy("id", "positive").agg(F.min_by("text", "key").alias("text")).repartition(common.partitions(docs.sparkSession), "id")
    return common.written(sample.select("text", "positive", F.xxhash64("id").alias("order")), "toxicity-sample"), min(0.9, max(1e-3, toxic / n)) if n else PRIOR


def choose(sample: DataFrame, prior: float) -> list[int]:
    """Features that are commoner among positives than the prior-corrected rest, by the z of the difference."""
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    per = sample.select("positive", F.explode(feature_ids("text")).alias("f")).groupBy("f").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    a, b = F.col("p") / max(1, n_p), F.col("u") / max(1, n_u)
    rest = F.greatest(F.lit(0.0), (b - prior * a) / (1 - prior))
    z = (a - rest) / F.sqrt(F.greatest(b, a * prior) * (1 - b + 1e-3) / max(1, n_p))
    return [r["f"] for r in per.filter("p >= 3").orderBy(z.desc(), "f").limit(MAX_FEATURES).collect()]


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[int], np.ndarray, float]:
    sample, prior = _sample(docs, labels)
    chosen = choose(sample, prior)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def counts(texts: pa.Array) -> pa.Array:
        count = Counter(chosen)
        return _lists([count(t.as_buffer().to_pybytes()).astype(np.float32) for t in texts], pa.float32())

    if not chosen:
        return [], np.zeros(1), float(np.log(prior / (1 - prior)))
    found = sample.select(counts("text").alias("x"), "positive", "order").toArrow().sort_by([("order", "ascending"), ("positive", "ascending")])
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(chosen) + 1)
    return chosen, *fit(x, np.array(found["positive"].to_pylist(), bool), prior)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted.

    docs: doc_id, text and any others (columns named like the added ones are replaced); labels: doc_id, toxic. Only
    label 1 outside the held-out rows (crc32 of doc_id mod 4 is 2) marks a positive; of label 0 nothing but its
    number is used, for the class prior. Null and empty texts are scored like any text without words. Labels that
    are null or not 0 or 1 count as unlabelled. Without positives every score is the prior. Rows with a null
    doc_id are scored, not held out and not trained on. Repeated rows get equal scores. Where an id has several texts, one
    is trained on. Features that tell equally well go by their number. An empty table gives no rows.
    """
    chosen, weights, bias = train(docs, labels)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        count = Counter(chosen)
        z = np.array([count(t.as_buffer().to_pybytes() if t.is_valid else b"") @ weights + bias if chosen else bias for t in texts], float)
        return pa.array(1 / (1 + np.exp(np.clip(-z, -500, 500))), pa.float64())

    held = F.coalesce(remainder(docs["doc_id"], 4) == 2, F.lit(False))
    done = docs.withColumn("score", scored(common.text_or_empty(docs))).withColumn("held_out", held)
    return done.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op10_toxicity(spark, sf_dir):
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return toxicity_scores(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
