"""Embedding near-dedup: all pairs of vectors above a cosine, by dual traversal of cover trees.

Unit vectors link where their distance is at most EPS = sqrt(2 - 2 * cosine). Three trees lie above each other:

1. A cover tree of sampled pivots, which grow with the table, sends each vector down to a leaf (its cell), nearest child
   by nearest child. The covering radius of every node is then measured over all vectors, and a vector also visits each
   leaf that covering radii and the bisectors between siblings do not rule out.
2. Cells are cut into blocks, so a hot cell is dealt over many tasks. A block's own cover tree (nested levels, halving
   radii) is built once; each vector carries its path in it.
3. Blocks that follow each other are gathered into groups, and each vector is sent once for each group that it visits. A task takes
   a pair of groups, and of each pair of blocks in it only the vectors that visit the other, and walks their trees together: a pair
   of nodes too far apart for their radii is dropped, one that lies within EPS as a whole is linked as a whole, all
   others open into their children. Nodes of one vector meet in single precision first, and in double precision where
   that is too near the threshold to tell.

Counts are exact; tasks return sums per vector and spanning links, never pairs. Where vectors have no clusters and many
dimensions, no covering radius rules anything out, and the work is that of all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

COSINE = 0.9
#: Vectors for each sampled pivot, and the most pivots of all lengths together (they are broadcast: 512 bytes each at 64
#: dimensions). Beyond it cells hold more vectors; they are cut into blocks all the same, so results never depend on it.
CELL, MAX_PIVOTS = 4_000, 65_536
#: Vectors of a block, on average (fewer where they are long: about NUMBERS numbers), and rows of it that are compared at a time.
BLOCK, NUMBERS, CHUNK = 6_000, 1_000_000, 500
#: Most blocks of a group, and (vector, block) visits worked out at a time. A vector is sent once for each group of blocks that it
#: visits, not once for each block, and a task holds two groups of vectors, of which it works through one pair of blocks at a time.
GATHER, VISITS = 8, 4_000_000
SLACK = 1e-9
#: Error of a dot product in single precision, for each dimension.
SINGLE = 2.4e-7


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


class Node:
    """Members (row numbers) within radius of a centre; below it, members that are nodes of their own, and larger nodes."""

    def __init__(self, centre: int, members: np.ndarray, radius: float):
        self.centre, self.members, self.radius = centre, members, radius
        self.single: np.ndarray | None = None
        self.larger: list[Node] = []

    @property
    def is_leaf(self) -> bool:
        return self.single is None

    def parts(self) -> tuple[np.ndarray, list[Node]]:
        return (np.zeros(0, np.int64), [self]) if self.single is None else (self.single, self.larger)


def cover(x: np.ndarray, members: np.ndarray, radius: float) -> tuple[np.ndarray, list[Node]]:
    """Greedy centres so that every member lies within radius of one, with their true covering radii: single members, and nodes."""
    single, found = [np.zeros(0, np.int64)], []
    left = members
    while len(left):
        head = left[:256]
        near = distance(x[head] @ x[head].T) <= radius
        chosen, free = [], np.ones(len(head), bool)
        for k in range(len(head)):
            if free[k]:
                chosen.append(k)
                free &= ~near[k]
        d = distance(x[left] @ x[head[chosen]].T)
        d[np.array(chosen), np.arange(len(chosen))] = 0
        best = d.argmin(1)
        dist = d[np.arange(len(left)), best]
        inside = dist <= radius
        order = np.argsort(best[inside], kind="stable")
        mine, whose, far = left[inside][order], best[inside][order], dist[inside][order]
        cuts = np.searchsorted(whose, np.arange(len(chosen) + 1))
        size = np.diff(cuts)
        single.append(mine[cuts[:-1][size == 1]])
        for k in np.flatnonzero(size > 1).tolist():
            part = slice(cuts[k], cuts[k + 1])
            found.append(Node(int(head[chosen[k]]), mine[part], float(far[part].max()) + SLACK))
        left = left[~inside]
    return np.concatenate(single), found


def grow(x: np.ndarray, node: Node, least: float) -> Node:
    """Nested levels below node, each with half the radius of the one above."""
    if len(node.members) > 1 and node.radius > least:
        node.single, found = cover(x, node.members, node.radius / 2)
        node.larger = [grow(x, child, least) for child in found]
    return node


def tree(x: np.ndarray, members: np.ndarray, least: float) -> Node:
    d = distance(x[members] @ x[members[0]])
    return grow(x, Node(int(members[0]), members, float(d.max()) + SLACK), least)


def paths(top: Node, n: int) -> list[list[int]]:
    """For each of n rows the numbers of the children that lead to it."""
    out: list[list[int]] = [[] for _ in range(n)]
    stack = [top]
    while stack:
        node = stack.pop()
        for k, child in enumerate(node.larger):
            for m in child.members.tolist():
                out[m].append(k)
            stack.append(child)
        if not node.is_leaf:
            for k, m in enumerate(node.single.tolist(), len(node.larger)):
                out[m].append(k)
    return out


def regrown(x: np.ndarray, rows: np.ndarray, path: list[list[int]], depth: int = 0) -> Node:
    """The tree that the paths of some rows describe; rows may lack the old centres, so radii are measured anew."""
    d = distance(x[rows] @ x[rows[0]])
    node = Node(int(rows[0]), rows, float(d.max()) + SLACK if len(rows) > 1 else 0.0)
    if len(rows) == 1:
        return node
    listed = rows.tolist()
    while all(len(path[r]) > depth for r in listed):
        parts: dict[int, list[int]] = {}
        for r in listed:
            parts.setdefault(path[r][depth], []).append(r)
        depth += 1
        if len(parts) > 1:
            node.single = np.array([p[0] for p in parts.values() if len(p) == 1], np.int64)
            node.larger = [regrown(x, np.array(p), path, depth) for p in parts.values() if len(p) > 1]
            break
    return node


class Links:
    """Exact sums of partners' weights and spanning links, from walking pairs of trees."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float):
        self.x, self.weight, self.cosine = x, weight, cosine
        self.small = x.astype(np.float32)
        self.error = SINGLE * max(8, x.shape[1])
        self.eps = float(np.sqrt(2 - 2 * cosine))
        self.count = np.zeros(len(x), np.int64)
        self.roots = np.arange(len(x))

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots[i], self.roots[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.roots, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.roots[self.roots], self.roots):
                self.roots = up

    def block(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """All pairs of two sets of rows, directly."""
        all_b = b
        for at in range(0, len(a), CHUNK):
            part, b = a[at : at + CHUNK], all_b[at:] if same else all_b
            cos = self.small[part] @ self.small[b].T
            i, j = np.nonzero(cos >= np.float32(self.cosine - self.error))
            if same:
                later = j > i
                i, j = i[later], j[later]
            unsure = np.flatnonzero(cos[i, j] < np.float32(self.cosine + self.error))
            if len(unsure):
                exact = np.einsum("ij,ij->i", self.x[part[i[unsure]]], self.x[b[j[unsure]]]) >= self.cosine
                keep = np.ones(len(i), bool)
                keep[unsure] = exact
                i, j = i[keep], j[keep]
            if len(i):
                p, q = part[i], b[j]
                np.add.at(self.count, p, self.weight[q])
                np.add.at(self.count, q, self.weight[p])
                self.unite(p, q)

    def whole(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Every pair links."""
        self.count[a] += self.weight[b].sum() - (self.weight[a] if same else 0)
        if not same:
            self.count[b] += self.weight[a].sum()
        self.unite(np.r_[a, b][1:], np.full(len(a) + len(b) - 1, a[0]))

    def walk(self, p: Node, q: Node) -> None:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            same = p is q
            if p.is_leaf and q.is_leaf or len(p.members) * len(q.members) <= 4096:
                self.block(p.members, q.members, same)
                continue
            (one, many), (other, more) = p.parts(), q.parts()
            if len(one) and len(other):
                self.block(one, other, same)
            self.singles(one, more)
            if not same:
                self.singles(other, many)
            if not len(many) or not len(more):
                continue
            cos = self.x[[n.centre for n in many]] @ self.x[[n.centre for n in more]].T
            reach = self.eps + np.array([n.radius for n in many])[:, None] + np.array([n.radius for n in more])
            open_ = cos >= 1 - reach * reach / 2 - SLACK
            open_ |= reach >= 2
            if same:
                open_ &= np.arange(len(more)) >= np.arange(len(many))[:, None]
            for i, j in zip(*np.nonzero(open_), strict=True):
                u, v = many[i], more[j]
                if 2 * u.radius <= self.eps - SLACK if u is v else distance(cos[i, j]) + u.radius + v.radius <= self.eps - SLACK:
                    self.whole(u.members, v.members, u is v)
                else:
                    stack.append((u, v))

    def singles(self, rows: np.ndarray, nodes: list[Node]) -> None:
        """Single vectors against nodes: what a node's radius cannot rule out meets its members."""
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            if not nodes:
                return
            reach = self.eps + np.array([n.radius for n in nodes])
            floor = np.where(reach >= 2, -2, 1 - reach * reach / 2) - SLACK
            near = self.x[part] @ self.x[[n.centre for n in nodes]].T >= floor
            for k in np.flatnonzero(near.any(0)).tolist():
                mine, node = part[near[:, k]], nodes[k]
                if node.is_leaf or len(node.members) <= 64:
                    self.block(mine, node.members, False)
                else:
                    one, more = node.parts()
                    if len(one):
                        self.block(mine, one, False)
                    self.singles(mine, more)


class Router:
    """The cover tree of the pivots of one vector length; its leaves are cells."""

    def __init__(self, pivots: np.ndarray, eps: float):
        self.nodes: list[tuple[np.ndarray, list[int]] | None] = []  # centres and numbers of the children; None for a leaf
        self.eps = eps
        self._add(pivots, tree(pivots, np.arange(len(pivots)), eps))

    def _add(self, pivots: np.ndarray, node: Node | None) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if node is not None and not node.is_leaf:
            kids = [self._add(pivots, c) for c in node.larger] + [self._add(pivots, None) for _ in node.single]
            self.nodes[me] = (pivots[[*(c.centre for c in node.larger), *node.single.tolist()]], kids)
        return me

    def _steps(self, x: np.ndarray, descend) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows); descend(node, rows, centres, distances) gives (child, which rows)."""
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            if self.nodes[at] is None:
                yield at, rows
                continue
            centres, kids = self.nodes[at]
            few = max(1, (1 << 21) // len(kids))
            for start in range(0, len(rows), few):
                part = rows[start : start + few]
                for k, mine in descend(kids, centres, part, distance(x[part] @ centres.T)):
                    stack.append((kids[k], part[mine]))

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The leaf of each row; and (row, node, distance to its centre) for the nodes on the way."""
        leaf, way = np.zeros(len(x), np.int32), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def descend(kids, centres, rows, d):
            best = d.argmin(1)
            way.append((rows, np.array(kids)[best], d[np.arange(len(d)), best]))
            return [(k, best == k) for k in np.unique(best).tolist()]

        for at, rows in self._steps(x, descend):
            leaf[rows] = at
        return leaf, *map(np.concatenate, zip(*way, strict=True))

    def visits(self, x: np.ndarray, radius: dict[int, float]) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows): where each row may have a partner. radius: of all nodes that hold vectors."""

        def descend(kids, centres, rows, d):
            best = d.argmin(1)
            apart = distance(centres[best] @ centres.T)
            bisector = (d * d - d[np.arange(len(d)), best][:, None] ** 2) / np.maximum(2 * apart, 1e-12)
            near = (d <= np.array([radius.get(k, -10.0) for k in kids]) + self.eps + SLACK) & (bisector <= self.eps + SLACK)
            return [(k, near[:, k]) for k in np.flatnonzero(near.any(0)).tolist()]

        return self._steps(x, descend)


def block_rows(length: int) -> int:
    return min(BLOCK, max(500, NUMBERS // max(1, length)))


def gathered(blocks: int, tasks: int) -> int:
    """Blocks of a group: as many as leave each task sixteen pairs of groups or more, if all meet all."""
    return max(1, min(GATHER, int(blocks / np.sqrt(32 * tasks))))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    length = batch.column("length").to_numpy()
    for n in np.unique(length):
        yield batch.filter(pa.array(length == n))


def e_type(vectors: DataFrame) -> str:
    return vectors.schema["embedding"].dataType.simpleString()


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Usable rows (vec_id, k1, k2); other rows (vec_id); distinct usable vectors (node, k1, k2, weight, vec_id, length, embedding)."""
    e = vectors["embedding"]
    if e_type(vectors) != "array<float>":  # single precision stays as it is, to travel light
        e = e.cast("array<double>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(e, lambda v: v != 0)
    rows = vectors.select(vectors["vec_id"].alias("vec_id"), e.alias("embedding"), F.coalesce(~bad, F.lit(False)).alias("usable"))
    keyed = rows.filter("usable").select("vec_id", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit("second"), "embedding").alias("k2"), "embedding")
    per = keyed.groupBy("k1", "k2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"), F.first("embedding").alias("embedding"))
    nodes = per.select(F.xxhash64("k1", "k2").alias("node"), "k1", "k2", "weight", "vec_id", F.size("embedding").alias("length"), "embedding")
    return keyed.drop("embedding"), rows.filter("not usable").select("vec_id"), common.written(nodes, "vectors")


def _routers(nodes: DataFrame, eps: float) -> dict[int, Router]:
    """A router for each length that has more vectors than a block, so for one length a block of vectors at most."""
    more = F.col("n") > F.least(F.lit(BLOCK), F.greatest(F.lit(500), F.floor(NUMBERS / F.greatest("length", F.lit(1)))))
    sizes = {r["length"]: r["n"] for r in nodes.groupBy("length").agg(F.count("*").alias("n")).filter(more).collect()}
    if not sizes:
        return {}
    total = sum(sizes.values())
    rate = min(1.0 / CELL, MAX_PIVOTS / total)
    wanted = F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, max(rate, 4 / n)))))
    draw = F.expr("shiftrightunsigned(xxhash64('pivot', node), 11)") / float(1 << 53)
    found = nodes.filter(draw < F.element_at(wanted, F.col("length"))).select("node", "length", "embedding").orderBy("node").toArrow().combine_chunks()
    routers = {}
    for batch in found.to_batches():
        for part in _by_length(batch):
            routers[part.column("length")[0].as_py()] = unit(_vectors(part.column("embedding")))
    return {k: Router(x, eps) for k, x in routers.items()}


def _row(nodes: DataFrame) -> str:
    return f"node long, weight long, length int, embedding {nodes.schema['embedding'].dataType.simpleString()}"


def _placed(nodes: DataFrame, routers: dict[int, Router]) -> DataFrame:
    """Each vector's leaf, and its distance to the centre of each node on the way."""

    def home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _by_length(batch):
                router = routers.get(b.column("length")[0].as_py())
                leaf, row, at, d = router.homes(unit(_vectors(b.column("embedding")))) if router else (np.zeros(len(b), np.int32), *(np.zeros(0, np.int64),) * 3)
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(len(b) + 1)).astype(np.int32)
                steps = pa.StructArray.from_arrays([pa.array(at[order], pa.int32()), pa.array(d[order], pa.float64())], ["at", "d"])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.ListArray.from_arrays(pa.array(ends), steps)], [*b.schema.names, "leaf", "far"])

    schema = f"{_row(nodes)}, leaf int, far array<struct<at:int,d:double>>"
    return common.written(nodes.select("node", "weight", "length", "embedding").mapInArrow(home, schema), "cells")


def _grown(batches: Iterable[pa.RecordBatch], eps: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length and block: each with its path in its block's cover tree."""
    for b in _groups(batches, ("length", "block")):
        x = unit(_vectors(b.column("embedding")))
        found = paths(tree(x, np.arange(len(x)), eps / 8), len(x))
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("node", "weight", "length", "embedding", "block")] + [pa.array(found, pa.list_(pa.int32()))], ["node", "weight", "length", "embedding", "block", "path"])


def _groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != now:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _paired(nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Rows for each pair of groups of blocks that may share a link: of either group the vectors that visit blocks of the other; the table
    they come from; and for each length the number of blocks of a group."""
    eps, n = float(np.sqrt(2 - 2 * cosine)), common.partitions(nodes.sparkSession)
    routers = _routers(nodes, eps)
    placed = _placed(nodes, routers)
    # One row a node of the routers, as many as pivots twice over at most.
    far = placed.select("length", F.explode("far").alias("x")).groupBy("length", "x.at").agg(F.max("x.d").alias("d")).collect()
    leaves = placed.filter(F.size("far") > 0).groupBy("length", "leaf").agg(F.count("*").alias("n")).orderBy("length", "leaf").collect()
    radius: dict[int, dict[int, float]] = {k: {} for k in routers}
    for r in far:
        radius[r["length"]][r["at"]] = r["d"]
    # Of each leaf the number of its first block, and how many it has.
    blocks: dict[int, dict[int, tuple[int, int]]] = {k: {} for k in routers}
    next_block = dict.fromkeys(routers, 0)
    for r in leaves:
        parts = -(-r["n"] // block_rows(r["length"]))
        blocks[r["length"]][r["leaf"]] = (next_block[r["length"]], parts)
        next_block[r["length"]] += parts

    def own_block(b: pa.RecordBatch) -> np.ndarray:
        where = blocks.get(b.column("length")[0].as_py())
        if not where:
            return np.zeros(len(b), np.int32)
        leaf, at = np.unique(b.column("leaf").to_numpy(), return_inverse=True)
        first, parts = np.array([where[k] for k in leaf.tolist()]).T
        return (first[at] + b.column("node").to_numpy() % parts[at]).astype(np.int32)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _by_length(batch):
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("node", "weight", "length", "embedding")] + [pa.array(own_block(b))], ["node", "weight", "length", "embedding", "block"])

    dealt = placed.mapInArrow(deal, f"{_row(nodes)}, block int")
    dealt = dealt.repartition(n, "length", "block").sortWithinPartitions("length", "block")
    treed = common.written(dealt.mapInArrow(lambda it: _grown(it, eps), f"{_row(nodes)}, block int, path array<int>"), "blocks")
    common.drop(placed)

    gather = {length: gathered(k, n) for length, k in next_block.items()}

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pair of groups of blocks that a vector takes part in; its bits say which blocks of the other group it visits."""
        for batch in batches:
            for whole in _by_length(batch):
                length = whole.column("length")[0].as_py()
                g, router, where = gather.get(length, 1), routers.get(length), blocks.get(length, {})
                few = max(1, VISITS // max(1, next_block.get(length, 1)))  # rows at a time, so that their visits fit
                for start in range(0, len(whole), few):
                    b = whole.slice(start, few)
                    own = b.column("block").to_numpy().astype(np.int64)
                    rows, others = [np.arange(len(b))], [own]
                    for leaf, found in router.visits(unit(_vectors(b.column("embedding"))), radius[length]) if router else ():
                        if leaf in where:
                            for k in range(where[leaf][0], sum(where[leaf])):
                                rows.append(found[own[found] != k])
                                others.append(np.full(len(rows[-1]), k))
                    row, other = np.concatenate(rows), np.concatenate(others)
                    groups = next_block.get(length, 1) // g + 1
                    met, at_met = np.unique(row * groups + other // g, return_inverse=True)
                    bits = np.bincount(at_met, weights=2.0 ** (other % g)).astype(np.int32)  # a row visits a block once, so bits add up
                    row, group = met // groups, met % groups
                    low, high = np.minimum(own[row] // g, group), np.maximum(own[row] // g, group)
                    pair = high * (high + 1) // 2 + low
                    slot = (pair + length * 7919) % n
                    for at in range(0, len(row), 10_000):  # keeps batches small where rows visit many groups
                        s = slice(at, at + 10_000)
                        taken = b.take(pa.array(row[s]))
                        numbers = [pa.array(pair[s]), *(pa.array(v.astype(np.int32)) for v in (slot[s], own[row[s]], bits[s]))]
                        kept = ["path", "node", "weight", "length", "embedding"]
                        yield pa.RecordBatch.from_arrays([*numbers, *(taken.column(c) for c in kept)], ["pair", "slot", "block", "bits", *kept])

    schema = f"pair long, slot int, block int, bits int, path array<int>, {_row(nodes)}"
    return treed.mapInArrow(meet, schema).repartitionById(n, F.col("slot")).sortWithinPartitions("length", "pair", "block"), treed, gather


def _block_pairs(pair: int, block: np.ndarray, bits: np.ndarray, g: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Of a pair of groups each pair of blocks: the rows of either that visit the other (None: a block with itself). block is sorted."""
    at = {k: np.flatnonzero(block == k) for k in np.unique(block).tolist()}
    groups = {k // g for k in at}
    high = max(groups)
    alone = len(groups) == 1 and pair == high * (high + 1) // 2 + high  # a group with itself
    for p, ps in at.items():
        for q, qs in at.items():
            if p == q and alone:
                yield ps, None
            elif p < q and (alone or p // g != q // g):
                one, two = ps[bits[ps] >> (q % g) & 1 == 1], qs[bits[qs] >> (p % g) & 1 == 1]
                if len(one) and len(two):
                    yield one, two


def _walk_pairs(cosine: float, gather: dict[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair of groups and block; pairs of blocks are worked through one after another."""
        for group in _groups(batches, ("length", "pair")):
            length, pair = group.column("length")[0].as_py(), group.column("pair")[0].as_py()
            for one, two in _block_pairs(pair, group.column("block").to_numpy(), group.column("bits").to_numpy(), gather.get(length, 1)):
                b = group.take(pa.array(one if two is None else np.r_[one, two]))
                x, node = unit(_vectors(b.column("embedding"))), b.column("node").to_numpy()
                path = b.column("path").to_pylist()
                links = Links(x, b.column("weight").to_numpy(), cosine)
                first = regrown(x, np.arange(len(one)), path)
                links.walk(first, first if two is None else regrown(x, np.arange(len(one), len(x)), path))
                some = (links.count > 0) | (links.roots != np.arange(len(x)))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[links.roots[some]]), pa.array(links.count[some])], ["node", "root", "count"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding (an array of numbers); other columns are ignored. Vectors link at a cosine of at least
    `cosine`, in double precision; n_links counts all other rows linked directly, copies included; component_id is
    the smallest vec_id that links reach. Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing, and neither do vectors of unequal length; there may be any number of lengths, of any size. A null
    vec_id is never smallest, so component_id is null only where no id is in reach. Rows that repeat a vec_id count as
    vectors each. An empty table gives no rows.
    """
    usable, rest, nodes = _classes(vectors)
    pairs, blocks, gather = _paired(nodes, cosine)
    walked = common.written(pairs.mapInArrow(_walk_pairs(cosine, gather), "node long, root long, count long"), "walked")
    common.drop(blocks)
    counts = walked.groupBy("node").agg(F.sum("count").alias("count"))
    found = components(walked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    classes = nodes.select("node", "k1", "k2", "weight", F.col("vec_id").alias("lowest")).join(found, "node", "left").join(counts, "node", "left")
    classes = classes.withColumn("class", F.coalesce("root", "node"))
    least = classes.groupBy("class").agg(F.min("lowest").alias("component_id"))
    named = classes.join(least, "class").select("k1", "k2", (F.coalesce("count", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    done = usable.join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    lone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding_near_dedup(spark, sf_dir):
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT w.vec_id, (SELECT count(*) FROM links l WHERE l.a = w.vec_id) AS n_links, w.component_id, w.vec_id = w.component_id AS kept FROM lowest w
"""
