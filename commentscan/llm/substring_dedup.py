"""Substring dedup: words inside a passage that an earlier document holds too.

A passage is WINDOW words long at least. Hashes only say where to look; every word that goes has been matched by the
suffix automaton of an earlier document's words. Each window has an anchor, the SHINGLE-word run of smallest hash in it, so
equal windows have equal anchors, and an anchor's context (all windows around it) is SPAN words at most. Four steps:

1. Anchors are range-partitioned and sorted by (anchor, context, document). A streaming pass names an earlier document,
   the owner, for each later row of a context, with no text moved. A range may end inside a group: rows at its ends
   count as contexts of their own, so hot anchors spread over as many tasks as they need.
2. The owners' contexts make the reference. It is cut into shards: one for each stretch of BLOCK words of an owner, and
   one for each anchor that has several contexts. A shard with many documents is repeated, and they are dealt over its
   copies. An anchor with over MAX_CONTEXTS contexts would make a large automaton; its shards are single windows.
3. A shard's documents stream, in order of id, through the suffix automaton of what came before: matching statistics of
   WINDOW or more words mark windows. A shard's automaton lives where its documents are sent, as no broadcast could hold
   all text that repeats in a large corpus.
4. The marked spans of a document are united and taken out of its text.

Texts travel compressed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, SHINGLE = 13, 6
#: Windows around an anchor, and the words they cover.
AROUND = WINDOW - SHINGLE + 1
SPAN = WINDOW + AROUND - 1
#: Contexts of an anchor that one automaton holds.
MAX_CONTEXTS = 2_000
#: log2 of the words of an owner that one automaton holds; contexts that a copy of a shard matches, about; and shards with
#: copies, or anchors of too many contexts, that are broadcast (past it Spark joins them by shuffle).
BLOCK, LOAD, BROADCAST_ROWS = 12, 20_000, 200_000
#: Words that a process remembers, and bytes of texts that it splits at a time.
MEMO, HELD = 200_000, 1 << 20
LAST_ID = 2**63 - 1

_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Hasher:
    """Polynomial hashes of word runs; remembers the hashes of words it has seen."""

    def __init__(self, bits: int = 64):
        self.memo: dict[bytes, int] = {}
        self.mask = np.uint64((1 << bits) - 1)
        self.powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _STEP]  # of each step and of its inverse

    def words(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w, 42)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def sums(self, hashes: np.ndarray, k: int = 0) -> np.ndarray:
        """Prefix sums of hash * step**position; `runs` divides by the step's power at the start of a run."""
        n = len(hashes)
        while len(self.powers[k][0]) <= n:
            for up, base in enumerate((_STEP[k], pow(_STEP[k], -1, 1 << 64))):
                own = self.powers[k][up]
                self.powers[k][up] = np.concatenate([own, own * np.uint64(pow(base, len(own), 1 << 64))])
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.powers[k][0][:n], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        """Hashes of the runs first:end, mixed so that their order looks random."""
        got = (sums[end] - sums[first]) * self.powers[k][1][first] + (end - first).astype(np.uint64)
        got ^= got >> np.uint64(32)
        got *= np.uint64(0xD6E8FEB86659FD93)
        return (got ^ (got >> np.uint64(32))) & self.mask


class Anchored:
    """A document's anchors: positions, hashes, and bounds and hashes of their contexts."""

    def __init__(self, words: list[bytes], hasher: Hasher):
        self.words, self.hasher, n = words, hasher, len(words)
        self.at = np.zeros(0, np.int64)
        if n >= WINDOW:
            self.sums = hasher.sums(hasher.words(words))
            starts = np.arange(n - SHINGLE + 1)
            runs = hasher.runs(self.sums, starts, starts + SHINGLE)
            views = np.lib.stride_tricks.sliding_window_view(runs, AROUND)
            at = views.argmin(1) + np.arange(len(views))  # never falls
            self.at = at[np.r_[True, at[1:] != at[:-1]]]
            self.anchor = runs[self.at].view(np.int64)
        self.first = np.maximum(self.at - AROUND + 1, 0)
        self.end = np.minimum(self.at + WINDOW, n)
        self.context = hasher.runs(self.sums, self.first, self.end).view(np.int64) if n >= WINDOW else self.at
        if n < WINDOW:
            self.anchor = self.at


#: Stands for the position of a context that occurs in its document more than once.
REPEATED = (1 << 31) - 1


def _stamp(data: bytes) -> int:
    """Tells rows apart that share an id: a place is stamp << 31 | position."""
    return zlib.crc32(data)


def _anchor_rows(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(bits)
    for batch in _slices(batches):
        found = []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            data = text.as_buffer().to_pybytes()
            doc = Anchored(data.split(), hasher)
            if len(doc.at):
                _, once, times = np.unique(doc.anchor ^ (doc.context * 3), return_index=True, return_counts=True)
                place = np.where(times == 1, doc.at[once], REPEATED) | (_stamp(data) << 31)
                found.append(np.stack([doc.anchor[once], doc.context[once], np.full(len(once), i), place], 1))
        if found:
            rows = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], ["anchor", "context", "id", "place"])


#: What a row of step 1 asks of its document: to be matched against its owner, to be in its own shard's reference, or both
#: for the shard of its anchor, which may have too many contexts. Numbers that a role has no use for are 0.
MEMBER, OWNER, OPEN, WIDE = 0, 1, 2, 3
WIDE_KEY = -2
JUDGED = "role int, id long, place long, context long, anchor long, owner long, owner_place long"


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, context, id) to rows of JUDGED.

    A member is a row whose context an earlier document holds, its owner. Open rows are the first of one of several
    contexts of an anchor, those of the same id beside it, and those at an end of the range.
    """
    held = None  # the last row's anchor and context, and the id and place of that context's first row
    waiting = None  # the last open candidate, and whether it is open already

    def batch(role: int, rows: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(rows), np.int64)
        context = np.where(rows[:, 3] & REPEATED == REPEATED, rows[:, 1], 0)
        columns = [rows[:, 2], rows[:, 3], context, rows[:, 0] if role == OPEN else none, *((owners[:, 0], owners[:, 1]) if role == MEMBER else (none, none))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), role, np.int32)), *map(pa.array, columns)], ["role", "id", "place", "context", "anchor", "owner", "owner_place"])

    for part in batches:
        if not len(part):
            continue
        rows = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in range(4)], 1)
        a, c, i = rows[:, 0], rows[:, 1], rows[:, 2]
        starts = held is None or (a[0], c[0]) != held[:2]
        new = np.r_[starts, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
        at = np.flatnonzero(new)
        which = np.cumsum(new)
        firsts = np.concatenate([np.array([held[2:] if held else (0, 0)], np.int64), rows[at, 2:]])[which]
        later = ~new & (i > firsts[:, 0])
        yield batch(MEMBER, rows[later], firsts[later])
        owned = np.unique(which[later], return_index=True)[1]
        heads = rows[later][owned].copy()
        heads[:, 2:] = firsts[later][owned]
        yield batch(OWNER, heads, heads)
        at = np.flatnonzero(~later)
        if len(at):
            owners, mark = rows[at], np.zeros(len(at), bool)
            if waiting is None:
                mark[0] = True  # the range may begin inside a group
            else:
                owners, mark = np.concatenate([waiting[0][None], owners]), np.r_[waiting[1], mark]
            same = owners[1:, 0] == owners[:-1, 0]
            mark[1:] |= same
            mark[:-1] |= same
            done = owners[:-1][mark[:-1]]
            yield batch(OPEN, done, done)
            waiting = (owners[-1], mark[-1])
        held = (a[-1], c[-1], *firsts[-1].tolist())
    if waiting is not None:
        yield batch(OPEN, waiting[0][None], waiting[0][None])  # and end inside one


class SuffixAutomaton:
    """Over words, of several passages."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The state after word from p, where its state q is longer than that."""
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, passage: list) -> None:
        last = 0
        for word in passage:
            p = last
            if word in self.next[p]:
                last = self._split(p, self.next[p][word], word)
                continue
            last = self._new(self.length[p] + 1, 0, {})
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                self.link[last] = self._split(p, self.next[p][word], word)

    def matching(self, passage: list) -> Iterator[int]:
        """For each word, how long a suffix of the passage up to it occurs in what was added."""
        state = n = 0
        for word in passage:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            yield n


def _spans(automaton: SuffixAutomaton, words: list[bytes], first: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches of words, numbered from first, that lie in windows that the automaton holds."""
    start = end = None
    for at, n in enumerate(automaton.matching(words), first + 1):
        if n >= WINDOW:
            if end is not None and at - WINDOW > end:
                yield start, end
                start = None
            start, end = at - WINDOW if start is None else start, at
    if end is not None:
        yield start, end


def _marks(out: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    ids, stamps, spans = zip(*out, strict=True) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(stamps, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["id", "stamp", "spans"])


MARKS = "id long, stamp long, spans array<int>"
PASSAGES = "k1 long, k2 long, id long, stamp long, adds boolean, firsts array<int>, texts array<binary>"
WINDOWS = "k1 long, k2 long, id long, stamp long, at int, words binary"


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PASSAGES, sorted by shard and id, to marks. What rows with `adds` say joins the automaton for later ids."""
    key = last = automaton = None
    fresh: list[list[bytes]] = []
    for batch in _slices(batches):
        out = []
        for k1, k2, i, stamp, adds, firsts, texts in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if (k1, k2) != key:
                key, automaton, fresh = (k1, k2), SuffixAutomaton(), []
            elif i != last and fresh:
                for x in fresh:
                    automaton.add(x)
                fresh = []
            last = i
            words = [t.split() for t in texts]
            found = [v for first, w in zip(firsts, words, strict=True) for span in _spans(automaton, w, first) for v in span] if len(automaton.next) > 1 else []
            if adds:
                fresh += words
            if found:
                out.append((i, stamp, found))
        yield _marks(out)


def _single_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, stamp, at, words, first): windows and the same window, by its hash, of an earlier document; to marks."""
    last = automaton = None
    for batch in batches:
        out = []
        for i, stamp, at, words, first in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if first != last:
                last, automaton = first, SuffixAutomaton()
                automaton.add(first.split())
            found = [v for span in _spans(automaton, words.split(), at) for v in span]
            if found:
                out.append((i, stamp, found))
        yield _marks(out)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, stamp, packed): texts compressed for the shuffle."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_buffer().to_pybytes() for t in b.column("text")]
            columns = [pa.array(list(map(_stamp, texts)), pa.int64()), pa.array([zlib.compress(t, 1) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), *columns], ["doc_id", "id", "stamp", "packed"])

    return _plain(docs).mapInArrow(pack, "doc_id long, id long, stamp long, packed binary")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"], F.lit(LAST_ID)).cast("long").alias("id"), common.text_or_empty(docs).alias("text"))


def _located(b: pa.RecordBatch, words: list[list[bytes]], hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(doc, row, first, end): where each wanted context stands in its document. Repeated ones are looked for again."""
    wanted = b.column("wanted")
    doc = np.repeat(np.arange(len(b)), np.diff(wanted.offsets.to_numpy()))  # of a slice too: flatten starts where it does
    rows, row = wanted.flatten(), np.arange(len(doc))
    at = rows.field("place").to_numpy() & REPEATED
    again = np.flatnonzero(at == REPEATED)
    if len(again):
        context = rows.field("context").to_numpy()
        more = []
        for d in np.unique(doc[again]).tolist():
            whole = Anchored(words[d], hasher)
            for r in again[doc[again] == d].tolist():
                more += [(r, x) for x in whole.at[whole.context == context[r]].tolist()]
        keep = at != REPEATED
        row = np.r_[row[keep], np.array([r for r, _ in more], np.int64)]
        at = np.r_[at[keep], np.array([x for _, x in more], np.int64)]
        doc = doc[row]
    return doc, row, np.maximum(at - AROUND + 1, 0), np.minimum(at + WINDOW, np.array([len(w) for w in words], np.int64)[doc])


def _united(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, and joined where they meet."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(stretches):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to HELD bytes or so, a row at least."""
    for b in batches:
        rows = max(1, int(len(b) * HELD / max(1, b.nbytes)))
        yield from (b.slice(at, rows) for at in range(0, len(b), rows))


def _passages(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Documents with what they are asked for, to rows of PASSAGES: of each shard all that it needs of a document."""
    hasher = Hasher(bits)
    for b in _slices(batches):
        ids, stamps = b.column("id").to_numpy(), b.column("stamp").to_numpy()
        words = [zlib.decompress(t.as_buffer()).split() for t in b.column("packed")]
        doc, row, first, end = _located(b, words, hasher)
        asked = b.column("wanted").flatten()
        role, anchor, owner, place, copies = (asked.field(k).to_numpy()[row] for k in ("role", "anchor", "owner", "owner_place", "copies"))
        # A member goes to one copy of its shard, an owner to all.
        times = np.where(role == OWNER, copies, 1)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        doc, first, end, role, anchor, owner, place, copies = (np.repeat(v, times) for v in (doc, first, end, role, anchor, owner, place, copies))
        salt = np.where(role == MEMBER, (stamps[doc] + ids[doc] % 1009) % copies, nth)
        owner, place = np.where(role == OWNER, ids[doc], owner), np.where(role == OWNER, asked.field("place").to_numpy()[row][np.repeat(np.arange(len(times)), times)], place)
        k1 = np.where(role == OPEN, anchor, np.where(role == WIDE, 0, owner))
        k2 = np.where(role == WIDE, WIDE_KEY, np.where(role == OPEN, -1, ((place >> 31) * 0x9E3779B1 + ((place & REPEATED) >> BLOCK) * 4096 + salt) & LAST_ID))
        adds = role != MEMBER
        order = np.lexsort((end, first, adds, k2, k1, doc))
        doc, k1, k2, adds, first, end = (v[order] for v in (doc, k1, k2, adds, first, end))
        new = np.ones(len(doc), bool)
        new[1:] = np.any([v[1:] != v[:-1] for v in (doc, k1, k2, adds)], axis=0)
        apart = new.copy()
        apart[1:] |= first[1:] > end[:-1]  # contexts that meet are one stretch; ends rise with starts
        at = np.flatnonzero(apart)
        first, end = first[at], end[np.r_[at[1:] - 1, len(end) - 1]] if len(at) else end
        texts = pa.array([b" ".join(words[d][s:e]) for d, s, e in zip(doc[at].tolist(), first.tolist(), end.tolist(), strict=True)], pa.binary())
        heads = np.flatnonzero(new)
        offsets = pa.array(np.searchsorted(at, np.r_[heads, len(doc)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(first.astype(np.int32))), pa.ListArray.from_arrays(offsets, texts)]
        columns = [*(pa.array(v) for v in (k1[heads], k2[heads], ids[doc[heads]], stamps[doc[heads]], adds[heads])), *lists]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PASSAGES.split(", ")])


def _windows(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of PASSAGES of anchors that have too many contexts, to rows of WINDOWS."""
    hasher = Hasher(bits)
    kinds = (*[pa.int64()] * 4, pa.int32(), pa.binary())
    for b in batches:
        out = []
        for i, stamp, firsts, texts in zip(*(b.column(c).to_pylist() for c in ("id", "stamp", "firsts", "texts")), strict=True):
            for first, text in zip(firsts, texts, strict=True):
                words = text.split()
                starts = np.arange(len(words) - WINDOW + 1)
                hashes = hasher.words(words)
                twice = (hasher.runs(hasher.sums(hashes, h), starts, starts + WINDOW, h).view(np.int64).tolist() for h in (0, 1))
                out += [(x, y, i, stamp, first + s, b" ".join(words[s : s + WINDOW])) for s, x, y in zip(starts.tolist(), *twice, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in WINDOWS.split(", ")])


def _asked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents (id, stamp, packed) with all that rows (id, place, ...) ask of them."""
    rest = [c for c in rows.columns if c != "id"]
    wanted = rows.select("id", F.shiftright("place", 31).alias("stamp"), F.struct(*rest).alias("x")).groupBy("id", "stamp").agg(F.collect_set("x").alias("wanted"))
    return _packed(docs).select("id", "stamp", "packed").join(wanted, ["id", "stamp"])


def repeated_spans(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(id, stamp, spans): [first, end) word numbers, flat, of words in windows that a document with a smaller id holds.

    id is doc_id, or LAST_ID for null; stamp tells texts of one id apart. hash_bits is for tests: with few bits hashes collide.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    rows = _plain(docs).select("id", "text").mapInArrow(lambda it: _anchor_rows(it, hash_bits), "anchor long, context long, id long, place long")
    rows = common.written(rows, "anchors")
    sorted_ = rows.repartitionByRange(n, "anchor", "context", "id").sortWithinPartitions("anchor", "context", "id")
    judged = common.written(sorted_.mapInArrow(_judge, JUDGED), "contexts")
    common.drop(rows)

    # Anchors of too many contexts, and stretches of owners with too many members: few, and counted before they are broadcast.
    open_ = judged.filter(F.col("role") == OPEN)
    wide = common.written(open_.groupBy("anchor").count().filter(F.col("count") > MAX_CONTEXTS).select("anchor"), "wide-anchors")
    n_wide = wide.count()
    wide = common.broadcast_if_small(wide, n_wide, BROADCAST_ROWS)
    stretch = lambda place: (F.shiftright(place, 31).alias("_stamp"), F.shiftright(F.col(place).bitwiseAND(REPEATED), BLOCK).alias("_block"))
    load = judged.filter(F.col("role") == MEMBER).groupBy(F.col("owner").alias("_owner"), *stretch("owner_place")).count().filter(F.col("count") > LOAD)
    busy = common.written(load.select("_owner", "_stamp", "_block", F.ceil(F.col("count") / LOAD).cast("int").alias("_copies")), "busy-owners")
    n_busy = busy.count()
    owned = judged.filter(F.col("role") != OPEN)
    if n_busy:
        is_owner = F.col("role") == OWNER
        keyed = owned.select("*", F.when(is_owner, F.col("id")).otherwise(F.col("owner")).alias("_owner"), F.when(is_owner, F.col("place")).otherwise(F.col("owner_place")).alias("_place"))
        keyed = keyed.select("*", *stretch("_place")).join(common.broadcast_if_small(busy, n_busy, BROADCAST_ROWS), ["_owner", "_stamp", "_block"], "left")
        owned = keyed.withColumn("copies", F.coalesce("_copies", F.lit(1))).select(*judged.columns, "copies")
    else:
        owned = owned.withColumn("copies", F.lit(1))
    if n_wide:
        open_ = open_.join(wide.withColumn("_wide", F.lit(True)), "anchor", "left").withColumn("role", F.when(F.col("_wide"), WIDE).otherwise(OPEN)).select(*judged.columns)
    asked = _asked(docs, owned.unionByName(open_.withColumn("copies", F.lit(1))))
    passages = asked.mapInArrow(lambda it: _passages(it, hash_bits), PASSAGES)
    if n_wide:
        passages = common.written(passages, "passages")
    shards = passages.filter(F.col("k2") != WIDE_KEY) if n_wide else passages
    marks = shards.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "id").mapInArrow(_shards, MARKS)
    if not n_wide:
        return marks
    windows = passages.filter(F.col("k2") == WIDE_KEY).mapInArrow(lambda it: _windows(it, hash_bits), WINDOWS)
    windows = common.written(windows, "windows")
    firsts = windows.groupBy("k1", "k2").agg(F.min(F.struct("id", "words")).alias("first"), F.max("id").alias("last")).filter("last > first.id").select("k1", "k2", "first")
    firsts = common.written(firsts, "first-windows")  # a table of its own, so that Spark can split the join where a window is hot
    meet = windows.join(common.broadcast_if_small(firsts, firsts.count(), BROADCAST_ROWS), ["k1", "k2"]).filter("id > first.id").select("id", "stamp", "at", "words", F.col("first.words").alias("first"))
    return marks.unionByName(meet.mapInArrow(_single_windows, MARKS))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        out = []
        for doc_id, packed, marks in zip(*(b.column(c).to_pylist() for c in ("doc_id", "packed", "marks")), strict=True):
            words = zlib.decompress(packed).split()
            if not marks:
                out.append((doc_id, len(words), 0, [], b" ".join(words)))
                continue
            gone = _united([(s, e) for spans in marks for s, e in zip(spans[::2], spans[1::2], strict=True)])
            kept, at = [], 0
            for s, e in gone:
                kept += words[at:s]
                at = e
            out.append((doc_id, len(words), sum(e - s for s, e in gone), gone, b" ".join(kept + words[at:])))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
        arrays = [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]
        arrays[4] = arrays[4].cast(pa.string())
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "removed", "kept_text"])


def dedup_substrings(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, removed, kept_text.

    docs: doc_id, text; other columns are ignored. Words are runs without white space, unchanged. A word goes if some
    WINDOW consecutive words around it also occur in a document with a smaller doc_id, judged on the input. removed
    lists the maximal spans taken out as [first, end) word numbers; kept_text has the other words, joined by spaces.
    A null text has no words; texts of under WINDOW words stay whole; texts may be of any length. A null doc_id counts as
    the largest (as LAST_ID, which should not be an id). Rows that share a doc_id count as one document: they do not
    remove from each other, and equal rows lose the same words. An empty table gives no rows.
    """
    marks = repeated_spans(docs, hash_bits).groupBy("id", "stamp").agg(F.collect_list("spans").alias("marks"))
    both = _packed(docs).join(marks, ["id", "stamp"], "left").select("doc_id", "packed", "marks")
    return both.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, removed array<array<bigint>>, kept_text string")


def op9_substring_dedup(spark, sf_dir):
    done = dedup_substrings(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words)
), firsts AS (
  SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS at FROM windows JOIN firsts USING (win) WHERE doc_id > first
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM words
), kept AS (
  SELECT e.doc_id, count(g.at) AS n_removed, string_agg(e.word, ' ' ORDER BY e.at) FILTER (g.at IS NULL) AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.at = g.at GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
