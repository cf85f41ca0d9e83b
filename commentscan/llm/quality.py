"""Quality scores by Bradley-Terry ranking.

Each document with label 1 is preferred to each with label 0. Scores are linear in features of the whole text: its shape,
and shares of hashed words and of hashed runs of three bytes. Their weights lower the logistic loss on feature differences,
over all pairs of all rows that may be learnt from. What a row's pairs weigh together follows from its score and from how the
scores of the other class lie, so a step needs two passes over the rows: one counts the scores of each class in narrow bins,
one sums features by these weights. Passes run where the rows lie; the driver gets sums of fixed size. The cut is a quantile of the training scores, at the share of label 0, and the logistic
scale puts it at the score CUT.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A score of at least CUT predicts label 1.
CUT = 0.3
#: Labels of which all are sent to each task; more are joined by shuffle.
SMALL = 1_000_000
#: Buckets of hashed words, and of hashed runs of three bytes; words whose bucket a process remembers.
WORD_BUCKETS, RUN_BUCKETS, MEMO = 128, 128, 200_000

#: Classes of bytes: a-z, A-Z, digits, white space, line ends, sentence marks, other ASCII, not ASCII.
_SETS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:?'\"-()")
_CLASSES = np.array([next((k for k, s in enumerate(_SETS) if b in s), 6 if b < 128 else 7) for b in range(256)])


_buckets: dict[bytes, int] = {}


def shape(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Shares of byte classes, word lengths and repetition, over the whole text."""
    n = max(1, len(data))
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    small, large, digit, white, line, mark, odd, far = np.bincount(_CLASSES, by_byte, 8)
    m = max(1, len(words))
    top = max(counts.values(), default=0) / m
    again = sum(map(bytes.__eq__, words, words[1:])) / m
    distinct = np.log1p(len(counts)) / np.log1p(m)
    letters = max(1.0, small + large)
    return [
        np.log1p(m), large / letters, odd / n, np.sqrt(odd / n), digit / n, far / n, white / n, np.sqrt(line / m), mark / n,
        n / m / 10, top, again, np.sqrt(again), distinct, float(not words),
    ]


def features(data: bytes) -> np.ndarray:
    lowered = data.lower()
    words = lowered.split()
    counts = Counter(words)
    if len(_buckets) > MEMO:
        _buckets.clear()
    by_word = np.zeros(WORD_BUCKETS)
    for word, count in counts.items():
        at = _buckets.get(word)
        if at is None:
            at = _buckets[word] = zlib.crc32(word) % WORD_BUCKETS
        by_word[at] += count
    codes = np.frombuffer(lowered, np.uint8).astype(np.uint32)
    runs = (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) * np.uint32(2654435761) >> np.uint32(25) if len(codes) > 2 else codes[:0]
    by_run = np.bincount(runs, minlength=RUN_BUCKETS)
    return np.concatenate([shape(data, words, counts), np.sqrt(by_word / max(1, len(words))), np.sqrt(by_run / max(1, len(runs)))])


N_FEATURES = len(features(b""))
#: Hashed shares are many and each says little, so they may count for less than a feature of the shape. How much is chosen among
#: these by the loss on a FOLDth of the rows to learn from (by a hash of their features, so copies stay together), after a fit on
#: the others; rows held out have no say.
HASHED, FOLD = (1.0, 0.5, 0.25, 0.125), 5
#: Steps of a fit, the ridge of its loss, and what keeps a step short where features hardly vary.
STEPS, RIDGE, DAMPING = 6, 1e-3, 0.05
#: Scores of a class are counted in bins this wide, up to a bound either way, to weigh all pairs at once.
BIN, BOUND = 1 / 32, 32
_EDGE = round(BOUND / BIN)
_MIDS = (np.arange(-_EDGE, _EDGE) + 0.5) * BIN
#: Numbers of a piece of a task's sums.
PIECE = 2048


def scales(hashed: float) -> np.ndarray:
    return np.r_[np.ones(N_FEATURES - WORD_BUCKETS - RUN_BUCKETS), np.full(WORD_BUCKETS + RUN_BUCKETS, hashed)]


def _plain(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / std, -8, 8)


def standard(x: np.ndarray, model: dict) -> np.ndarray:
    return _plain(x, model["mean"], model["std"]) * scales(model["hashed"])


@F.arrow_udf(T.ArrayType(T.FloatType()))
def feature_column(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], pa.list_(pa.float32()))


def left_out(x: np.ndarray) -> np.ndarray:
    """Which rows a fit that is to choose a scale leaves out."""
    return np.array([zlib.crc32(row.tobytes()) % FOLD == 0 for row in x.astype(np.float32)], bool)


# Sums over rows (x, label), which add up over parts of a table.


def _moments(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Left out or not, by label: number of rows, sums of features, sums of their squares."""
    side, x = left_out(x).astype(int), x.astype(np.float64)
    each = [x[(side == a) & (label == b)] for a in (0, 1) for b in (0, 1)]
    return np.concatenate([np.r_[len(e), e.sum(0), (e * e).sum(0)] for e in each])


def _products(mean: np.ndarray, std: np.ndarray):
    """By label: sums of standard features and of their products."""

    def sums(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        z = _plain(x, mean, std)
        return np.concatenate([np.r_[e.sum(0), (e.T @ e).ravel()] for e in (z[label == 0], z[label == 1])])

    return sums


def _histograms(mean: np.ndarray, std: np.ndarray, weights: np.ndarray):
    """By model, left out or not, label and bin: number of rows. Scores past BOUND count in the last bin."""

    def sums(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        at = np.clip(np.floor(_plain(x, mean, std) @ weights.T / BIN), -_EDGE, _EDGE - 1).astype(np.int64) + _EDGE
        group = (left_out(x) * 2 + label)[:, None] + 4 * np.arange(len(weights))
        return np.bincount((group * 2 * _EDGE + at).ravel(), minlength=len(weights) * 8 * _EDGE).astype(np.float64)

    return sums


def _gradients(mean: np.ndarray, std: np.ndarray, weights: np.ndarray, curves: np.ndarray, trial: np.ndarray):
    """By model: features summed by what their rows' pairs weigh (curves: by model, label and bin)."""

    def sums(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        z, left = _plain(x, mean, std), left_out(x)
        s, out = z @ weights.T, []
        for k in range(len(weights)):
            pull = np.where(label == 1, np.interp(s[:, k], _MIDS, curves[k, 1]), np.interp(s[:, k], _MIDS, curves[k, 0]))
            out.append((pull * ~(left & trial[k])) @ z)
        return np.concatenate(out)

    return sums


class Rows:
    """Rows in memory."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.x, self.label = x, label

    def sums(self, of) -> np.ndarray:
        return of(self.x, self.label)

    def middle(self, model: dict, share_0: float) -> tuple[float, float]:
        """Between which two scores the share lies, halfway; and how far scores spread."""
        found = np.sort(standard(self.x, model) @ model["weights"])
        k = _place(share_0, len(found))
        return (found[k - 1] + found[k]) / 2, float(np.std(found))


def _place(share_0: float, n: int) -> int:
    return int(np.clip(round(share_0 * n), 1, n - 1))


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES), batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)


class Table:
    """Rows of a table (x: array<float>, label: int), which stay where they are; tasks add up, the driver gets the total."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def sums(self, of) -> np.ndarray | None:
        def run(batches):
            total = None
            for batch in batches:
                if len(batch):
                    part = of(*_batch(batch))
                    total = part if total is None else total + part
            if total is not None:
                pieces = [total[a : a + PIECE] for a in range(0, len(total), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], names=["k", "v"])

        def add(table: pa.Table) -> pa.Table:
            v = table["v"].combine_chunks()
            total = v.flatten().to_numpy().reshape(len(table), -1).sum(0)
            return pa.table({"k": table["k"].slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

        found = self.rows.mapInArrow(run, "k int, v array<double>").groupBy("k").applyInArrow(add, "k int, v array<double>").toArrow().sort_by("k")
        return found["v"].combine_chunks().flatten().to_numpy() if len(found) else None

    def middle(self, model: dict, share_0: float) -> tuple[float, float]:
        """As of Rows: the two scores are narrowed down by counts in bins, and counts in bins of a bin."""

        def run(batches):
            for batch in batches:
                x, _ = _batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array(standard(x, model) @ model["weights"], pa.float64())], names=["s"])

        scores = common.written(self.rows.mapInArrow(run, "s double"), "quality-scores")
        n, spread = scores.agg(F.count("*"), F.stddev_pop("s")).first()

        def nth(k: int) -> float:
            some = scores
            for finer in (1, 1 << 12, 1 << 24, None):
                bin = F.col("s") if finer is None else F.floor(F.col("s") * (finer / BIN))
                for value, count in sorted((r["bin"], r["count"]) for r in some.groupBy(bin.alias("bin")).count().collect()):
                    if k < count:
                        break
                    k -= count
                some = some.filter(bin == value)
            return value

        k = _place(share_0, n)
        found = (nth(k - 1) + nth(k)) / 2, spread
        common.drop(scores)
        return found


def fits(rows: Rows | Table, counts: np.ndarray, mean: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights for each of HASHED, and which of these has the least loss on pairs of the rows left out of a fit of its own; the
    first where those or the others lack a class. counts: of rows, left out or not, by label.

    A step is Newton's, with the curvature that the loss has at most, so it never overshoots; few of them keep the weights small.
    """
    scale = np.array([scales(h) for h in HASHED * 2])
    trial = np.arange(len(scale)) >= len(HASHED)
    of = rows.sums(_products(mean, std)).reshape(2, -1)
    n = counts.sum(0)
    means = of[:, :N_FEATURES] / n[:, None]
    around = [of[k, N_FEATURES:].reshape(N_FEATURES, -1) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    apart = means[1] - means[0]
    most = 0.25 * (around[0] + around[1] + np.outer(apart, apart))
    steps = [np.linalg.inv(most * np.outer(d, d) + DAMPING * np.eye(N_FEATURES)) for d in scale]
    gap = _MIDS[None] - _MIDS[:, None]
    wrong = 1 / (1 + np.exp(-gap))  # of a pair: a row of label 1 in a bin, one of label 0 in another
    w = np.zeros(scale.shape)
    size = np.maximum(1, np.where(trial[:, None], counts[0], n))
    for step in range(STEPS + 1):
        hist = rows.sums(_histograms(mean, std, w * scale)).reshape(len(w), 2, 2, -1)
        if step == STEPS:
            break
        own = np.where(trial[:, None, None], hist[:, 0], hist.sum(1))
        share = own / size[:, :, None]
        curves = np.stack([share[:, 1] @ wrong, -(share[:, 0] @ wrong.T)], 1) / size[:, :, None]
        g = rows.sums(_gradients(mean, std, w * scale, curves, trial)).reshape(w.shape) * scale + RIDGE * w
        w = w - np.stack([a @ b for a, b in zip(steps, g, strict=True)])
    if (counts == 0).any():
        return w[: len(HASHED)], HASHED[0]
    loss = np.logaddexp(0, gap)
    lost = [float(h[1, 1] @ loss @ h[1, 0]) for h in hist[len(HASHED) :]]
    return w[: len(HASHED)], HASHED[int(np.argmin(lost))]


def _summary(rows: Rows | Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of rows, left out or not, by label; means and deviations of features."""
    found = rows.sums(_moments)
    if found is None:
        found = np.zeros(4 * (1 + 2 * N_FEATURES))
    found = found.reshape(2, 2, -1)
    counts, total = found[:, :, 0], found.sum((0, 1))
    mean = total[1 : 1 + N_FEATURES] / max(1, total[0])
    return counts, mean, np.sqrt(np.maximum(0, total[1 + N_FEATURES :] / max(1, total[0]) - mean * mean)) + 1e-6


def chosen_scale(x: np.ndarray, label: np.ndarray) -> float:
    """Of HASHED the one with the least loss on pairs of rows left out of its fit; the first where those lack a class."""
    rows = Rows(x, label)
    summary = _summary(rows)
    return HASHED[0] if (summary[0] == 0).any() else fits(rows, *summary)[1]


def _fitted(rows: Rows | Table, share_0: float | None = None) -> dict:
    counts, mean, std = _summary(rows)
    n_0, n_1 = counts.sum(0)
    if not n_0 or not n_1:  # nothing to prefer: everything passes, or nothing does
        flat = {"mean": np.zeros(N_FEATURES), "std": 1.0, "hashed": 1.0, "weights": np.zeros(N_FEATURES)}
        return flat | {"cut": 1.0 if n_0 else -1.0, "scale": 1.0}
    weights, hashed = fits(rows, counts, mean, std)
    model = {"mean": mean, "std": std, "hashed": hashed, "weights": weights[HASHED.index(hashed)]}
    cut, spread = rows.middle(model, 1 - n_1 / (n_0 + n_1) if share_0 is None else share_0)
    return model | {"cut": cut, "scale": max(1e-6, spread / 2)}


def fit(x: np.ndarray, label: np.ndarray, share_0: float) -> dict:
    """Weights from preference pairs, and the cut at the quantile share_0 of the scores."""
    return _fitted(Rows(x, label.astype(np.int64)), share_0)


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """0 to 1; CUT at the model's cut."""
    z = standard(x, model) @ model["weights"]
    return 1 / (1 + np.exp(np.clip(-(z - model["cut"]) / model["scale"] - np.log(CUT / (1 - CUT)), -500, 500)))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; null for a null id."""
    return F.crc32(doc_id.cast("string")) % by


def known_rows(labels: DataFrame, label: str, by: int, held: int) -> DataFrame:
    """(id, label): labelled rows outside the held-out remainder."""
    known = labels.select(labels["doc_id"].alias("id"), labels[label].cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    return known.filter(remainder(F.col("id"), by) != held)


def training_rows(labels: DataFrame, label: str, by: int, held: int, limit: int) -> DataFrame:
    """known_rows, those with the smallest hashes if over limit."""
    return known_rows(labels, label, by, held).orderBy(F.xxhash64("id"), "id", "label").limit(limit)


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on all rows that may be learnt from. Their features are written once, and read by each pass."""
    rows = known_rows(labels, "quality", 5, 0)
    mine = docs.select(docs["doc_id"].alias("id"), common.text_or_empty(docs).alias("text"))
    if rows.count() <= SMALL:
        numbers = mine.join(F.broadcast(rows), "id").select("label", feature_column("text").alias("x"))
    else:  # features are joined, so that no text goes through the shuffle
        numbers = mine.select("id", feature_column("text").alias("x")).join(rows, "id").select("label", "x")
    written = common.written(numbers, "quality-features")
    model = _fitted(Table(written))
    common.drop(written)
    return model


def with_score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of the whole text; a column of that name is replaced."""

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], np.float32).reshape(-1, N_FEATURES)
        return pa.array(score(model, x), pa.float64())

    return docs.withColumn(name, scored(common.text_or_empty(docs)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted.

    docs: doc_id, text and any others (columns named like the added ones are replaced); labels: doc_id, quality.
    Null and empty texts are scored like any text; labels that are null or not 0 or 1, and rows held out (crc32 of
    doc_id mod 5 is 0), are not learnt from. Without two classes to learn from, all rows get one score, below CUT
    only where every label is 0. A row with a null doc_id is not held out. Repeated rows get equal scores; rows with one
    score fall on one side of the cut. An empty table gives no rows.
    """
    done = with_score(docs, train(docs, labels))
    held = F.coalesce(remainder(done["doc_id"], 5) == 0, F.lit(False))
    return done.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs with a score of at least CUT, unchanged."""
    packed = docs.select(F.struct("*").alias("row"), common.text_or_empty(docs).alias("text"))
    return with_score(packed, model).filter(F.col("score") >= CUT).select("row.*")


def op6_quality_classifier(spark, sf_dir):
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_scores(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
