"""SimHash near-dedup: fingerprints that differ in few bits, found by a binary trie joined with itself.

Two fingerprints within three bits agree on one of their four 16-bit quarters. So the fingerprints are turned four
ways, each time with another quarter in front, and dealt by that quarter: a task gets whole subtries of depth 16.
There it walks pairs of trie nodes together, adds up the differing bits and drops a pair as soon as they exceed the
budget. Budgets of one, two and three bits run in turn, and pairs of nodes that one component already covers are
skipped, so a dense cluster of near copies is not compared pair by pair. Tasks return spanning links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

WORDS = 3
MAX_BITS = 3
QUARTERS = 4
#: Fingerprints that a task holds at a time; a quarter shared by more is dealt out to pairs of blocks of this size, all of
#: which are compared: results do not depend on it.
BLOCK = 200_000
#: Node pairs that are walked at a time, and the block of pairs that is compared directly.
FRONTIER = 1 << 18
LEAF = 64


def fingerprint_of(data: bytes, words: int = WORDS) -> int:
    """The 64 majority bits of the hashes of all word shingles, signed. No words: 0."""
    found = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], pa.int64())


class Forest:
    """Links among sorted distinct 64-bit values within groups, by walking trie node pairs."""

    def __init__(self, groups: np.ndarray, values: np.ndarray):
        self.values, self.roots = values, np.arange(len(values))
        bounds = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
        self.nodes = np.stack([bounds[:-1], bounds[1:]], 1)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Unite by minimum labels until nothing moves."""
        roots = self.roots
        while len(i):
            a, b = roots[i], roots[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := roots[roots], roots):
                roots[:] = up

    def walk(self, budget: int) -> None:
        changes = np.cumsum(np.r_[0, self.roots[1:] != self.roots[:-1]])  # equal at both ends: one component throughout
        wide = self.nodes[self.nodes[:, 1] - self.nodes[:, 0] > 1]
        start = np.c_[wide, wide, np.zeros((len(wide), 1), np.int64)]
        stack = [(63 - 64 // QUARTERS, start[at : at + FRONTIER]) for at in range(0, len(start), FRONTIER)]
        while stack:
            bit, pairs = stack.pop()
            a0, a1, b0, b1, err = pairs.T
            covered = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (self.roots[a0] == self.roots[b0])
            pairs = pairs[~covered]
            a0, a1, b0, b1, err = pairs.T
            leaf = ((a1 - a0) * (b1 - b0) <= LEAF) | (bit < 0)
            self.compare(pairs[leaf], budget)
            pairs = pairs[~leaf]
            if len(pairs):
                children = self.split(pairs, bit, budget)
                stack += [(bit - 1, children[at : at + FRONTIER]) for at in range(0, len(children), FRONTIER)]

    def split(self, pairs: np.ndarray, bit: int, budget: int) -> np.ndarray:
        a0, a1, b0, b1, err = pairs.T
        am, bm = self.middle(a0, a1, bit), self.middle(b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        cross = np.c_[a0, am, bm, b1, err + 1], np.c_[am, a1, b0, bm, err + 1][~same]  # of a node with itself, once
        children = np.concatenate([np.c_[a0, am, b0, bm, err], np.c_[am, a1, bm, b1, err], *cross])
        a0, a1, b0, b1, err = children.T
        single = (a0 == b0) & (a1 - a0 < 2) & (a1 == b1)
        return children[(err <= budget) & (a0 < a1) & (b0 < b1) & ~single]

    def middle(self, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where the bit turns to one in each sorted range: a binary search in all ranges at once."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            one = (self.values[np.minimum(mid, len(self.values) - 1)] >> np.uint64(bit)) & np.uint64(1) == 1
            hi, lo = np.where(open_ & one, mid, hi), np.where(open_ & ~one, mid + 1, lo)
        return lo

    def compare(self, pairs: np.ndarray, budget: int) -> None:
        a0, a1, b0, b1, _ = pairs.T
        wide = (a1 - a0) * (b1 - b0)
        cuts = np.searchsorted(np.cumsum(wide), np.arange(FRONTIER * 8, wide.sum() + FRONTIER * 8, FRONTIER * 8)) if len(wide) else []
        for part in np.split(np.arange(len(wide)), cuts):
            n = wide[part]
            at = np.repeat(part, n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            width = (b1 - b0)[at]
            i, j = a0[at] + k // width, b0[at] + k % width
            near = (i < j) & (np.bitwise_count(self.values[i] ^ self.values[j]) <= budget)
            self.link(i[near], j[near])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.roots != np.arange(len(self.roots)))
        return moved, self.roots[moved]


def _turn(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rotate to the right, to undo the rotation to the left by as much."""
    by = by.astype(np.uint64)
    return np.where(by == 0, values, (values >> by) | (values << ((np.uint64(64) - by) % np.uint64(64))))


def _walked(groups: np.ndarray, turns: np.ndarray, values: np.ndarray, max_bits: int) -> pa.RecordBatch:
    forest = Forest(groups, values)
    for budget in range(1, max_bits + 1):
        forest.walk(budget)
    own = _turn(values, turns * (64 // QUARTERS)).view(np.int64)
    i, j = forest.links()
    return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], ["u", "v"])


def _join_subtries(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by group and value; whole groups are walked as soon as a block of rows is there."""
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            if sum(len(x[0]) for x in held) >= BLOCK:
                groups, turns, values = map(np.concatenate, zip(*held, strict=True))
                end = np.searchsorted(groups[::-1] != groups[-1], True)
                if end < len(groups):
                    cut = len(groups) - end
                    yield _walked(groups[:cut], turns[:cut], values[:cut].view(np.uint64), max_bits)
                    groups, turns, values = groups[cut:], turns[cut:], values[cut:]
                held = [(groups, turns, values)]
        if held:
            groups, turns, values = map(np.concatenate, zip(*held, strict=True))
            yield _walked(groups, turns, values.view(np.uint64), max_bits)

    return run


def near_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fps: distinct fp (long). Returns spanning links (u, v) of all pairs within max_bits (3 at most)."""
    if not 1 <= max_bits < QUARTERS:
        raise ValueError("max_bits must be 1, 2 or 3")
    step = 64 // QUARTERS
    turned = lambda k: F.expr(f"shiftleft(fp, {k * step}) | shiftrightunsigned(fp, {64 - k * step})") if k else F.col("fp")
    spread = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), turned(k).alias("value")) for k in range(QUARTERS)))).alias("x")).select("x.*")
    spread = spread.withColumn("head", F.expr(f"cast(shiftrightunsigned(value, {64 - step}) as int)"))
    # A quarter shared by more than a block of fingerprints goes to pairs of salted blocks instead.
    sizes = spread.groupBy("turn", "head").count().filter(F.col("count") > BLOCK).select("turn", "head", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    if sizes.isEmpty():
        keyed = spread.withColumn("pair", F.lit(0))
    else:
        salted = spread.join(sizes, ["turn", "head"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = salted.withColumn("own", F.expr("cast(pmod(xxhash64(value), blocks) as int)"))
        other = own.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, blocks - 1), x -> x <> own)"))))
        keyed = other.withColumn("pair", F.expr("least(own, other) * blocks + greatest(own, other)"))
    group = F.xxhash64("turn", "head", "pair")
    dealt = keyed.select(group.alias("group"), "turn", "head", "value").repartition(common.partitions(fps.sparkSession), "group")
    rows = dealt.sortWithinPartitions("group", "turn", "head", "value").select("group", F.col("turn").cast("long").alias("turn"), "value")
    return rows.mapInArrow(_join_subtries(max_bits), "u long, v long")


def _ids(docs: DataFrame) -> list[Column]:
    text = common.text_or_empty(docs)
    return [docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_key")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp), written to the shared folder."""
    return common.written(docs.select(*_ids(docs), fingerprint(common.text_or_empty(docs)).alias("fp")), "fingerprints")


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, text_key, fp, component_id, first_key.

    docs: doc_id, text; other columns are ignored. Fingerprints link at max_bits or fewer differing bits, and
    component_id is the smallest doc_id that links reach, the document's own included; first_key is the text_key
    of that document. Null and empty texts have fingerprint 0 and link like any other. Copies share a fingerprint
    and are compared once. Repeated rows get equal rows. A null doc_id counts as the largest: component_id is null
    only where a whole component has no id. A bit set in exactly half of the hashes is 0. Texts may have any length. An
    empty table gives no rows.
    """
    fps = fingerprints(docs)
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("lowest")
    distinct = common.written(fps.groupBy("fp").agg(lowest), "distinct-fingerprints")
    found = components(near_fingerprints(distinct.select("fp"), max_bits))
    classes = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "lowest", F.coalesce("root", "fp").alias("class"))
    least = classes.groupBy("class").agg(F.min("lowest").alias("least"))
    named = classes.join(least, "class").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_key").alias("first_key"))
    return fps.join(named, "fp").select("doc_id", "text_key", "fp", "component_id", "first_key")


def keep_one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that come first in their group; of equal rows with one doc_id, a single one."""
    groups = simhash_groups(docs, max_bits)
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    firsts = firsts.select(_plain_id("doc_id").alias("id_key"), "text_key").distinct()
    packed = docs.select(F.struct("*").alias("row"), _plain_id("doc_id").alias("id_key"), F.xxhash64(common.text_or_empty(docs)).alias("text_key"))
    kept = packed.join(firsts, ["id_key", "text_key"], "left_semi").groupBy("id_key", "text_key").agg(F.first("row").alias("row"))
    return kept.select("row.*")


def _plain_id(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(-(2**63)))


def op4_simhash_near_dedup(spark, sf_dir):
    groups = simhash_groups(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
