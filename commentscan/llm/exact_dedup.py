"""Exact dedup by composable polynomial fingerprints, and a comparison piece by piece of what has equal ones.

The fingerprint of a byte string is its polynomial at four fixed points modulo 2^31 - 1, so that of a whole follows from
those of its parts: fp(ab) = fp(a) * point^length(b) + fp(b). Texts are hashed in blocks of STEP bytes, all blocks of a
batch in one matrix product. Documents above HUGE bytes are cut into pieces that are dealt over all tasks, each hashed
on its own; shifted by what follows them, the parts' fingerprints add up.

Rows of equal length, fingerprint and 64-bit hash (by which the JVM finds their texts again) are a group. Their texts are
then compared: cut into pieces of PIECE bytes, of which each task keeps the least and the largest of every group and
place, so a group of a third of all rows costs one row a task and place. A group whose pieces differ is dealt out
again by its whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PRIME = 2**31 - 1
#: Where the polynomial is evaluated: four fixed numbers below PRIME.
POINTS = (1_103_515_249, 1_664_525_017, 742_938_287, 950_706_379)
#: Bytes of a block of the matrix product, and blocks of one product.
STEP, BLOCKS = 512, 4096
#: Bytes from which a document is cut up, of its parts, and of the pieces that are compared. Results do not depend on them.
HUGE, PART, PIECE = 1 << 20, 1 << 18, 1 << 13
#: log2 of the bits of the bitmap of candidates, least and most (32 MB): 16 bits for each copied text as long as that fits.
BITS_LEAST, BITS_MOST = 15, 28
F_COLUMNS = tuple(f"f{k}" for k in range(len(POINTS)))
KEY = ("n_bytes", "h", "fp_a", "fp_b")


def powers(n: int, step: int = 1) -> np.ndarray:
    """(n, points): point ** (step * k) modulo PRIME."""
    out = np.ones((n, len(POINTS)), np.int64)
    each = np.array([pow(p, step, PRIME) for p in POINTS], np.int64)
    for k in range(1, n):
        out[k] = out[k - 1] * each % PRIME
    return out


def _matrix() -> np.ndarray:
    """(STEP, 2 * points): what each byte of a block weighs, low and high halves apart, so that sums are exact in doubles."""
    weight = powers(STEP)[::-1]
    return np.hstack([weight & 0xFFFF, weight >> 16]).astype(np.float64)


class Hasher:
    """Fingerprints of byte strings."""

    def __init__(self):
        self.matrix, self.shift = _matrix(), powers(1, STEP)

    def of(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """(n, points): of data[cuts[k]:cuts[k + 1]] each. An empty string has 0."""
        lengths = np.diff(cuts)
        blocks = -(-lengths // STEP)
        ends = np.cumsum(blocks)
        if len(self.shift) < blocks.max(initial=0):
            self.shift = powers(int(blocks.max()), STEP)
        hashes = np.zeros((int(blocks.sum()), len(POINTS)), np.int64)
        # Strings end where a block ends; zeros in front of them weigh nothing.
        first = 0
        while first < len(lengths):
            done = ends[first] - blocks[first]
            last = max(first + 1, int(np.searchsorted(ends, done + BLOCKS, "right")))
            padded = np.zeros((int(ends[last - 1] - done), STEP), np.uint8)
            flat = padded.reshape(-1)
            for k in range(first, last):
                end = (ends[k] - done) * STEP
                flat[end - lengths[k] : end] = data[cuts[k] : cuts[k + 1]]
            for at in range(0, len(padded), BLOCKS):
                halves = (padded[at : at + BLOCKS].astype(np.float64) @ self.matrix).astype(np.int64)
                low, high = halves[:, : len(POINTS)], halves[:, len(POINTS) :]
                hashes[done + at : done + at + len(halves)] = (low + (high % PRIME) * 65536) % PRIME
            first = last
        out = np.zeros((len(lengths), len(POINTS)), np.int64)
        full = np.flatnonzero(blocks)
        if len(full):
            behind = np.repeat(ends, blocks) - 1 - np.arange(len(hashes))
            out[full] = np.add.reduceat(hashes * self.shift[behind] % PRIME, (ends - blocks)[full], axis=0) % PRIME
        return out


def shifted(fingerprint: np.ndarray, behind: int) -> np.ndarray:
    """What a part with so many bytes behind it adds to the fingerprint of the whole."""
    return np.array([int(f) * pow(p, behind, PRIME) % PRIME for f, p in zip(fingerprint, POINTS, strict=True)], np.int64)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces data (binary) and behind, the bytes that follow it in its document, by F_COLUMNS."""
    hasher = Hasher()
    for batch in batches:
        data = batch.column("data")
        cuts = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        body = np.frombuffer(data.buffers()[2] or b"", np.uint8)
        prints = hasher.of(body, cuts)
        for k, behind in enumerate(batch.column("behind").to_pylist()):
            if behind:
                prints[k] = shifted(prints[k], behind)
        rest = [n for n in batch.schema.names if n not in ("data", "behind")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *(pa.array(prints[:, k]) for k in range(len(POINTS)))], names=[*rest, *F_COLUMNS])


def _hash(rows: DataFrame) -> DataFrame:
    rest = [f"{n} {t}" for n, t in rows.dtypes if n not in ("data", "behind")]
    return rows.mapInArrow(_hashed, ", ".join([*rest, *(f"{f} long" for f in F_COLUMNS)]))


def normalized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, data, n_bytes, h) of docs; row numbers the rows of this reading."""
    texts = docs.select(docs["doc_id"].alias("doc_id"), common.text_or_empty(docs).alias("text")).withColumn("row", F.monotonically_increasing_id())
    lowered = texts.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), common.ascii_lower(F.col("text")).alias("text"))
    return lowered.select("row", "doc_id", "n_bytes", F.xxhash64("text").alias("h"), "text")


def _parts(data: Column, n_bytes: Column, size: int) -> Column:
    """structs (no, data) of a binary cut every `size` bytes; one empty part of an empty one."""
    last = F.greatest(F.ceil(n_bytes / size) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("no"), F.substring(data, i * size + 1, F.lit(size)).alias("data")))


def fingerprints(docs: DataFrame, bits: int = 62) -> DataFrame:
    """(row, doc_id, sha, and KEY) of each row of docs. bits: how much of each hash counts; fewer make texts collide."""
    rows = normalized(docs).withColumn("sha", F.unhex(F.sha2("text", 256)))
    data = F.col("text").cast("binary")
    small = _hash(rows.filter(F.col("n_bytes") <= HUGE).select("row", "doc_id", "n_bytes", "h", "sha", data.alias("data"), F.lit(0).cast("long").alias("behind")))
    cut = rows.filter(F.col("n_bytes") > HUGE).withColumn("data", data).select("row", "doc_id", "n_bytes", "h", "sha", F.explode(_parts(F.col("data"), F.col("n_bytes"), PART)).alias("part"))
    behind = F.greatest(F.col("n_bytes") - (F.col("part.no").cast("long") + 1) * PART, F.lit(0))
    parts = cut.select("row", "doc_id", "n_bytes", "h", "sha", F.col("part.no").alias("no"), "part.data", behind.alias("behind"))
    n = common.partitions(docs.sparkSession)
    hashed = _hash(parts.repartition(n, "row", "no")).groupBy("row", "n_bytes").agg(
        F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("sha").alias("sha"), *((F.sum(f) % PRIME).alias(f) for f in F_COLUMNS)
    )
    mask = (1 << bits) - 1
    both = small.unionByName(hashed)
    packed = [(F.shiftleft(a, 31) + F.col(b)).bitwiseAND(mask).alias(n) for a, b, n in (("f0", "f1", "fp_a"), ("f2", "f3", "fp_b"))]
    return both.select("row", "doc_id", "sha", "n_bytes", F.col("h").bitwiseAND(mask if bits < 62 else -1).alias("h"), *packed)


def _candidates(docs: DataFrame, groups: DataFrame, bits: int) -> DataFrame:
    """normalized(docs), of which most rows that are in no group are gone: those whose bit no group has set."""
    n_bits = min(max(BITS_LEAST, (16 * groups.count()).bit_length()), BITS_MOST)
    slot = F.col("h").bitwiseAND((1 << n_bits) - 1)
    marked = groups.groupBy(F.shiftright(slot, 15).alias("bucket")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bitmap"))
    rows = normalized(docs)
    if bits < 62:
        rows = rows.withColumn("h", F.col("h").bitwiseAND((1 << bits) - 1))
    at = slot.bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("bucket", F.shiftright(slot, 15)).join(F.broadcast(marked), "bucket")  # 2^BITS_MOST bits at most
    return found.filter(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).drop("bucket", "bitmap")


def _differing(candidates: DataFrame) -> DataFrame:
    """(n_bytes, h) of which two texts differ in some piece."""
    binary = candidates.select("n_bytes", "h", F.col("text").cast("binary").alias("data"))
    pieces = binary.select("n_bytes", "h", F.explode(_parts(F.col("data"), F.col("n_bytes"), PIECE)).alias("part"))
    spans = pieces.groupBy("n_bytes", "h", F.col("part.no").alias("no")).agg(F.min("part.data").alias("low"), F.max("part.data").alias("high"))
    return spans.filter("low <> high").select("n_bytes", "h").distinct()


def _last() -> Column:
    """The row that stays: the largest doc_id, of which null is the least; of rows that share it, one."""
    return F.max(F.struct("doc_id", "row"))


def copies(docs: DataFrame, bits: int = 62) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    docs: doc_id, text; other columns are ignored. Texts are equal if they are after A-Z becomes a-z; of a group the row with
    the largest doc_id stays (null counts as the least id). Rows that share that doc_id and the text are one document
    repeated: one of them is kept. A null text counts as empty, and all empty texts are a group. Texts may have any length.
    An empty table gives no rows.
    """
    prints = common.written(fingerprints(docs, bits), "fingerprints")
    groups = common.written(prints.groupBy(*KEY).agg(F.count("*").alias("group_size"), _last().alias("last")).filter("group_size > 1"), "groups")
    placed = prints.join(groups, list(KEY), "left").select("row", "doc_id", "sha", "n_bytes", "h", "group_size", "last")
    candidates = _candidates(docs, groups.select("n_bytes", "h"), bits)
    differing = common.written(_differing(candidates), "differing")
    if not differing.isEmpty():
        differ = ["n_bytes", "h"]
        texts = candidates.join(differing, differ, "left_semi").select("row", "doc_id", *differ, "text", F.unhex(F.sha2("text", 256)).alias("sha"))
        apart = common.written(texts, "apart")
        whole = common.written(apart.groupBy(*differ, "text").agg(F.count("*").alias("group_size"), _last().alias("last")), "apart-groups")
        again = apart.join(whole, [*differ, "text"]).select(*placed.columns)
        placed = placed.join(differing, differ, "left_anti").unionByName(again)
    alone = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(alone == 1, F.col("doc_id")).otherwise(F.col("last.doc_id"))
    kept = (alone == 1) | (F.col("row") == F.col("last.row"))
    return placed.select("doc_id", keep.alias("keep_id"), alone.alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that copies() drops; all columns, whatever their names."""
    kept = copies(docs).filter("kept").select(F.struct("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    packed = docs.select(F.struct("*").alias("row"), F.struct(docs["doc_id"].alias("doc_id")).alias("_id"), F.unhex(F.sha2(common.ascii_lower(common.text_or_empty(docs)), 256)).alias("_sha"))
    return packed.join(kept, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select("row.*")


def op12_exact_dedup(spark, sf_dir):
    return copies(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
