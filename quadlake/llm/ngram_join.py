"""Similarity self-join of documents by the Jaccard index of their word shingles, with count-vector R-trees.

1. A document is the set of its 64-bit shingle hashes; equal sets are one class, whatever their number.
2. Routing, without loss: in any order of all shingles, two sets with an index of t share one of the first n - ceil(t n) + 1 of
   each. The order puts shingles that many documents hold last. Documents that share such a shingle, directly or by way of
   others, form a block.
3. A block's sets are hashed into groups, and the groups' counts are the points of an R-tree. The sum of coordinate minima of a
   point and a box bounds the overlap with every set in the box; pairs that survive are verified on the sets themselves. Pairs
   that are connected already are skipped.
4. Blocks over a limit are cut into chunks that share some of their members; afterwards all members outside the block's
   largest component are searched in every chunk. Where these are many, the block hangs together by chains of shared passages rather
   than by likeness: its members then meet by each shared shingle instead, and sets are compared only with those that hold it. So do
   they where the search of all chunks would send out too many texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import read, stash, unstash
from quadlake.llm._components import components
from quadlake.llm._filter import Filter
from quadlake.llm._tokens import batches_of, mix, windows, words

#: Groups that shingles are hashed into, and the fan-out of the tree.
GROUPS, FANOUT = 256, 16
#: Shingles and sets of a chunk, and members that all chunks of a block share.
CHUNK_WEIGHT, CHUNK_ROWS, HUBS = 400_000, 512, 32
#: Members outside the largest component that are searched together, and so many times more that are searched in all chunks.
ASKED, MOST_PARTS = 1000, 8
#: Texts that the search of all chunks may send out, as a share of the table's rows, and so many in any case.
SENT_SHARE, SENT_LEAST = 0.25, 10_000
#: What all tasks are told of frequencies: a bit for each of 2**SLOTS slots of repeated shingles, and the counts of the FREQUENT
#: most frequent ones. Beyond these bounds the order is coarser and more candidates need verification; results are the same.
SLOTS, FREQUENT = 29, 1 << 20
#: Times the shingles sent out that should come before all marked ones, as texts differ.
SPARE = 1.25
#: Shingles that a task of the counting pass holds.
COUNTED = 1 << 20
#: Members whose texts are looked up by broadcasting their ids; more are joined by shuffle, without most of the texts of no member.
BROADCAST_ROWS = 500_000
FLUSH_ROWS = 1 << 18


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    w = words(texts)
    all_windows, out = windows(w.hashes, [1] * width), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(all_windows[a : b - width + 1]))
        else:
            out.append(windows(w.hashes[a:b], [1] * (b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return tuple(int(x) for x in np.array([np.sum(mix(s ^ np.uint64(k)), dtype=np.uint64) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]).view(np.int64))


def prefix_length(n: int, t: float) -> int:
    return n - math.ceil(t * n - 1e-9) + 1


def _sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for a, b in batches_of(batch.column("text")):
        part = batch.slice(a, b - a)
        yield part, shingle_sets(part.column("text"), width)


def _survey(width: int):
    """id, h, n, d1, d2 of each document."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets_of(batch, width):
                marks = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())], names=["id", "h", "n", "d1", "d2"])

    return look


def _spectrum(width: int, k: int):
    """bucket, data: the shingles of a task's classes by their first k bits, the 32 bits after them sorted and coded as differences, in
    four planes of bytes. What the coding leaves out can only make shingles look more frequent than they are."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(held)) >> np.uint64(32 - k)
            cut = np.searchsorted(keys, np.arange((1 << k) + 1, dtype=np.uint64) << np.uint64(32))
            full = [b for b in range(1 << k) if cut[b] < cut[b + 1]]
            data = [np.diff(keys[cut[b] : cut[b + 1]] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for _, sets in _sets_of(batch, width):
                for s in sets:
                    if len(s) and (mark := digest(s)) not in seen:
                        seen.add(mark)
                        held.append(s)
                        size += len(s)
                if size > COUNTED:
                    yield from out()
                    held, size, seen = [], 0, set()
        if held:
            yield from out()

    return look


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: the values that occur more than once and the powers of two of their counts; how many values have each
    power, those that occur once included."""

    def out(bucket: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        levels = np.floor(np.log2(counts)).astype(np.uint8)
        each = np.bincount(levels, minlength=64)[:64]
        values, levels = values[counts > 1], levels[counts > 1]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([values.astype("<u4").tobytes()], pa.binary()), pa.array([levels.tobytes()], pa.binary()), pa.array([each.tolist()], pa.list_(pa.int64()))], names=["bucket", "values", "levels", "each"])

    at, parts = None, []
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            if bucket != at and parts:
                yield out(at, parts)
                parts = []
            at = bucket
            planes = np.frombuffer(data.as_buffer(), np.uint8).reshape(4, -1)
            parts.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64).astype(np.uint32))
    if parts:
        yield out(at, parts)


def _bits(k: int, m: int, least: int):
    """bucket, bits: which of the bucket's share of 2**m slots hold a value of at least this level."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values, levels in zip(batch.column("values").to_pylist(), batch.column("levels").to_pylist(), strict=True):
                slots = np.zeros(1 << (m - k), bool)
                slots[np.frombuffer(values, "<u4")[np.frombuffer(levels, np.uint8) >= least] >> np.uint32(32 - (m - k))] = True
                out.append(np.packbits(slots).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(out, pa.binary())], names=["bucket", "bits"])

    return look


def _chosen(k: int, least: int):
    """key, level of the values of at least this level."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, values, levels in zip(*(batch.column(c).to_pylist() for c in ("bucket", "values", "levels")), strict=True):
                levels = np.frombuffer(levels, np.uint8)
                keys = (np.uint64(bucket) << np.uint64(32)) | np.frombuffer(values, "<u4")[levels >= least].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(levels[levels >= least].astype(np.int32))], names=["key", "level"])

    return look


def least_level(each: list[int], slots: int, share: float) -> int:
    """The level from which on shingles are marked, by the number of shingles of each level, so that the fewest of the `share` of a text
    that comes first are repeated. With all repeated ones marked, whatever is unmarked occurs once; that holds however full the slots
    are, as long as enough stay unmarked. Only where they don't is it better to mark the frequent ones alone."""
    held = [n * 1.5 * 2**i if i else n for i, n in enumerate(each)]
    every = max(1, sum(held))
    need = min(every, SPARE * share * every)

    def repeated(least: int) -> float:
        """The share of repeated ones among the first."""
        kept = math.exp(-sum(each[least:]) / slots)
        clear, bad = kept * sum(held[:least]), kept * sum(held[1:least])
        if clear >= need:
            return bad / max(1, clear)
        return (bad + (need - clear) * (sum(held[1:]) - bad) / (every - clear)) / need

    return min(range(1, 64), key=repeated)


class Order:
    """How late a shingle comes: 0 for one held once, as far as is known, else about the power of two of its count. It is the same
    function in all tasks, which is all that the results depend on; its size is bounded."""

    def __init__(self, docs: DataFrame, width: int, shingles: int, t: float):
        k = self.k = min(16, max(6, math.ceil(math.log2(max(1, shingles) / 500_000))))
        # Rows are whole blobs: a task has one bucket's at a time.
        spectrum = docs.select("text").mapInArrow(_spectrum(width, k), "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
        found = stash(spectrum.mapInArrow(_repeated, "bucket int, values binary, levels binary, each array<long>"), "repeated")
        sums = found.agg(*[F.coalesce(F.sum(F.col("each")[i]), F.lit(0)) for i in range(64)]).first()
        above = [sum(sums[i:]) for i in range(64)]
        least = least_level(sums, 1 << SLOTS, 1 - t)
        self.m = max(k + 3, min(SLOTS, math.ceil(math.log2(16 * max(1, above[least])))))
        size = 1 << (self.m - 3 - k)
        slots = bytearray(size << k)
        for r in found.select("bucket", "values", "levels").mapInArrow(_bits(k, self.m, least), "bucket int, bits binary").toLocalIterator():
            slots[r["bucket"] * size : (r["bucket"] + 1) * size] = r["bits"]
        self.slots = np.frombuffer(slots, np.uint8)
        top = next(i for i in range(2, 65) if i == 64 or above[i] <= FREQUENT)
        told = found.select("bucket", "values", "levels").mapInArrow(_chosen(k, top), "key long, level int").toArrow()  # FREQUENT rows at most
        keys = np.asarray(told.column("key").combine_chunks() if told.num_rows else pa.array([], pa.int64())).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.levels = keys[order], np.asarray(told.column("level").combine_chunks() if told.num_rows else pa.array([], pa.int32()))[order]
        unstash(found)

    def level(self, s: np.ndarray) -> np.ndarray:
        slot = (s >> np.uint64(64 - self.m)).astype(np.int64)
        out = (self.slots[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
        if len(self.keys):
            key = s >> np.uint64(32 - self.k)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.levels[at], out)
        return out


def _postings(width: int, t: float, order, only=None):
    """key, node, lead for the first shingles of each class; a task sends a class once.

    Rows without a lead are shingles (key) and their holders (node). A task already links the holders it knows to the first of them,
    which alone goes on as a holder; links have a node and its lead, and the node for a key. However many texts hold a
    shingle, only a row from each run of a task meets under it. With a filter of nodes, its nodes alone and all holders go on.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = order.value.level
        seen: set[int] = set()
        held, owners, size = [], [], 0

        def out() -> pa.RecordBatch:
            node = np.repeat(np.array(owners, np.int64), [len(h) for h in held]) if held else np.zeros(0, np.int64)
            token = np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64)
            link = np.zeros((0, 2), np.int64)
            if only is None and len(token):
                by = np.lexsort((node, token))
                token, node = token[by], node[by]
                first = np.concatenate([[True], token[1:] != token[:-1]])
                leader = node[first][np.cumsum(first) - 1]
                link = np.stack([node, leader], 1)[node != leader]
                link = np.unique(link, axis=0) if len(link) else link
                token, node = token[first], node[first]
            lead = pa.concat_arrays([pa.nulls(len(token), pa.int64()), pa.array(link[:, 1])])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([token, link[:, 0]])), pa.array(np.concatenate([node, link[:, 0]])), lead], names=["key", "node", "lead"])

        for batch in batches:
            for _, sets in _sets_of(batch, width):
                for s in sets:
                    if not len(s) or (node := digest(s)[0]) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    if only is not None and not len(only.value.passing(np.array([node], np.int64).view(np.uint64))):
                        continue
                    held.append(s[np.argsort(level(s), kind="stable")][: prefix_length(len(s), t)])
                    owners.append(node)
                    size += len(held[-1])
                if size > FLUSH_ROWS:
                    yield out()
                    held, owners, size = [], [], 0
        yield out()

    return look


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and node: the links among them, and a link from each further holder of a shingle to its first."""
    last_token = last_node = None
    for batch in batches:
        key, node = (np.asarray(batch.column(c)) for c in ("key", "node"))
        holder = np.asarray(batch.column("lead").is_null())
        links = [np.stack([node[~holder], np.asarray(batch.column("lead").drop_null(), np.int64)], 1)]
        token, node = key[holder], node[holder]
        if len(token):
            start = np.ones(len(token), bool)
            start[1:] = token[1:] != token[:-1]
            first = np.flatnonzero(start)
            leader = node[first].copy()
            if last_token is not None and token[0] == last_token:
                leader[0] = last_node
            leaders = leader[np.cumsum(start) - 1]
            last_token, last_node = token[-1], leaders[-1]
            links.append(np.stack([node, leaders], 1)[node != leaders])
        link = np.concatenate(links)
        if len(link):
            link = np.unique(link, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(link[:, 0]), pa.array(link[:, 1])], names=["a", "b"])


class CountTree:
    """R-tree over count vectors, packed bottom-up in the order of set size and of a coordinate sum."""

    def __init__(self, sets: list[np.ndarray], members: list[int], t: float):
        self.sets, self.t = sets, t
        self.sizes = np.array([len(s) for s in sets])
        self.points = np.zeros((len(sets), GROUPS), np.uint16)
        for i, s in enumerate(sets):
            self.points[i] = np.minimum(np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS), 65535)
        order = np.array(members, np.int64)
        half = self.points[order][:, : GROUPS // 2].sum(1, dtype=np.int64)
        # Tiles of equal size first, then by the coordinate sum inside a tile.
        order = order[np.argsort(self.sizes[order] + half / (half.max(initial=0) + 1.0), kind="stable")]
        self.levels = [(self.points[order], self.sizes[order], self.sizes[order])]
        self.order = order
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, q: int) -> np.ndarray:
        """Members whose overlap with q may reach the threshold, q's own position included."""
        n, point = len(self.sets[q]), self.points[q]
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[at] for x in self.levels[depth])
            fits = (high >= self.t * n - 1e-9) & (low * self.t <= n + 1e-9)
            at, top, low = at[fits], top[fits], low[fits]
            # The overlap has to be t / (1 + t) of the sum of the sizes, which is least for the smallest size in the box.
            need = self.t / (1 + self.t) * (n + np.maximum(low, self.t * n))
            at = at[np.minimum(top, point).sum(1, dtype=np.int64) >= need - 1e-6]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]

    def linked(self, a: int, b: int, percent: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)


def join_block(sets: list[np.ndarray], queries: list[int], members: list[int], groups: list[int], t: float) -> list[int]:
    """Labels of sets after linking queries with members; sets of equal groups count as connected from the start."""
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, g in enumerate(groups):
        parent[find(i)] = find(first.setdefault(g, i))
    tree, percent = CountTree(sets, members, t), round(100 * t)
    for q in queries:
        for x in tree.search(q).tolist():
            if x != q and (a := find(q)) != (b := find(x)) and tree.linked(q, x, percent):
                parent[a] = b
    return [find(i) for i in range(len(sets))]


def _join_chunks(width: int, t: float):
    """From rows sorted by key: a link from each set to the first of its component. Columns key, node, role, known, text; a row whose
    text has another set than the node's stems from a repeated id and is left out."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: dict[int, tuple]) -> pa.RecordBatch:
            nodes, found = list(rows), list(rows.values())
            members = [k for k, r in enumerate(found) if r[0] & {"member", "both"}]
            queries = [k for k, r in enumerate(found) if r[0] & {"query", "both"}]
            labels = join_block([r[2] for r in found], queries, members, [r[1] for r in found], t)
            pairs = [(nodes[k], nodes[x]) for k, x in enumerate(labels) if x != k]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

        at, rows = None, {}
        for batch in batches:
            for part, sets in _sets_of(batch, width):
                for key, node, role, known, s in zip(*(part.column(c).to_pylist() for c in ("key", "node", "role", "known")), sets, strict=True):
                    if rows and at != key:
                        yield done(rows)
                        rows = {}
                    at = key
                    if node in rows:  # the same set may be here as member and as query, or by a repeated row
                        rows[node][0].add(role)
                    elif digest(s)[0] == node:
                        rows[node] = ({role}, known, s)
        if rows:
            yield done(rows)

    return look


def _wanted(which):
    """id, text of the rows whose seed passes a filter."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["id", "text"]).take(pa.array(which.value.passing(np.asarray(batch.column("seed")).view(np.uint64))))

    return look


def _search(texts: DataFrame, plan: DataFrame, width: int, t: float) -> DataFrame:
    """Runs the chunks of plan (key, rep, node, role, known) on the texts (id, text) of their members."""
    plan = stash(plan, "plan")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    else:
        reps = stash(plan.select(F.xxhash64("rep").alias("seed")).distinct(), "reps")
        which = texts.sparkSession.sparkContext.broadcast(Filter(reps, reps.count()))
        texts = texts.select("id", "text", F.xxhash64("id").alias("seed")).mapInArrow(_wanted(which), "id long, text string")
    rows = texts.join(plan, F.col("rep") == F.col("id")).select("key", "node", "role", "known", "text")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_join_chunks(width, t), "a long, b long")


def _chunks() -> Column:
    return F.greatest(F.ceil(F.col("w") / CHUNK_WEIGHT), F.ceil(F.col("k") / CHUNK_ROWS)).cast("int")


def _by_shingle(postings: DataFrame, members: DataFrame) -> DataFrame:
    """A plan by which members (node, rep, known, n) meet under each shingle that some hold who are not connected yet. Shingles with the
    same holders count once. Holders over a chunk meet chunk by chunk, each pair of chunks under a key of its own, or, if that sends
    out fewer texts, those outside the holders' largest component are searched in every chunk."""
    held = stash(postings.select(F.col("key").alias("token"), "node").join(members, "node").distinct(), "held")
    mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "node"))
    groups = held.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"), mark(1).alias("m1"), mark(2).alias("m2"), F.min("known").alias("lo"), F.max("known").alias("hi")).filter("lo <> hi")
    groups = stash(groups.groupBy("k", "w", "m1", "m2").agg(F.min("token").alias("token")).select("token", _chunks().alias("chunks")), "groups")
    # Of each group over a chunk: its largest component, and the parts that all others are cut into.
    each = held.join(groups.filter("chunks > 1"), "token").groupBy("token", "chunks", "known").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    each = each.groupBy("token", "chunks").agg(F.sum("k").alias("all"), F.max_by(F.struct("known", "k", "w"), F.struct("k", "known")).alias("major"), F.sum("w").alias("w"))
    k, w = F.col("all") - F.col("major.k"), F.col("w") - F.col("major.w")
    parts = F.greatest(F.ceil(w / CHUNK_WEIGHT), F.ceil(k / ASKED)).cast("int")
    asym = each.withColumn("parts", parts).filter(F.col("all") * F.col("parts") + k * F.col("chunks") < F.col("all") * F.col("chunks"))
    asym = stash(asym.select("token", F.col("major.known").alias("major"), "parts"), "majors")

    groups = groups.join(asym, "token", "left")
    own = held.join(groups, "token").withColumn("x", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pairs = own.filter("parts IS NULL").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    role = F.when(F.col("x") == F.col("y"), "both").when(F.col("x") < F.col("y"), "query").otherwise("member")
    pairs = pairs.select(F.xxhash64("token", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "rep", "node", role.alias("role"), "known")
    own = own.filter("parts IS NOT NULL")
    key = F.xxhash64("token", "x", "y", F.lit("part")).alias("key")
    there = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(key, "rep", "node", F.lit("member").alias("role"), "known")
    asked = own.filter(F.col("known") != F.col("major")).withColumn("y", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("parts")).cast("int"))
    asked = asked.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(key, "rep", "node", F.lit("query").alias("role"), "known")
    return pairs.unionByName(there).unionByName(asked)


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.75) -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links reach), group_key (of the component itself, as an id on rows of different
    texts may be the smallest of several; null without shingles) and text_hash (xxhash64 of the text) for each row.

    Shingles are runs of `width` words, words being runs of anything but ASCII white space, A-Z in lower case. Two documents link
    when the Jaccard index of their shingle sets is `threshold` (in hundredths) or more. The result is exact but for
    collisions of the 64-bit hashes of shingles and of sets.

    Defined results: null texts and texts without words have no shingles and are their own component; rows that repeat an id
    are rows of their own, each with the links of its own text; null ids link with nothing and get a null
    component; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    t = threshold
    text = F.col(f"`{text_col}`").cast("string")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    rows = stash(docs.withColumn("h", F.xxhash64("text")).mapInArrow(_survey(width), "id long, h long, n long, d1 long, d2 long"), "survey")
    order = df.sparkSession.sparkContext.broadcast(Order(docs, width, rows.agg(F.sum("n")).first()[0] or 0, t))
    postings = lambda *only: docs.filter("id IS NOT NULL").select("text").mapInArrow(_postings(width, t, order, *only), "key long, node long, lead long")

    runs = postings().repartition("key").sortWithinPartitions("key", "node")
    blocks = stash(components(runs.mapInArrow(_runs, "a long, b long")), "blocks")

    # A class is known by the digest of its set, never by an id.
    classes = stash(rows.filter("id IS NOT NULL AND n > 0").groupBy(F.col("d1").alias("node")).agg(F.min("id").alias("rep"), F.max("n").alias("n")), "classes")
    inside = classes.join(blocks.select("node", F.col("component").alias("block")), "node")
    weights = inside.groupBy("block").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    inside = stash(inside.join(stash(weights.select("block", _chunks().alias("chunks")), "weights"), "block").select("node", "rep", "n", "block", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")), "members")
    key = lambda *c: F.xxhash64(*c)
    both = F.lit("both").alias("role")
    own = F.col("node").alias("known")
    alone = inside.filter("chunks = 1").select(key("block").alias("key"), "rep", "node", both, own)
    large = inside.filter("chunks > 1")
    # Some members of a large block, about HUBS, are in all of its chunks.
    sizes = large.groupBy("block").agg(F.count(F.lit(1)).alias("k"))
    hub = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("k")) < HUBS
    spread = F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))).alias("chunk")
    parts = large.join(stash(sizes, "sizes"), "block").withColumn("hub", hub).select("block", "rep", "node", spread).select(key("block", "chunk").alias("key"), "rep", "node", both, own)
    found = stash(_search(docs, alone.union(parts), width, t), "links")

    if not large.isEmpty():
        labels = stash(components(found), "labels")
        known = stash(large.join(labels, "node", "left").select("block", "chunks", "chunk", "rep", "node", "n", F.coalesce("component", "node").alias("known")), "known")
        major = stash(known.groupBy("block", "known").count().groupBy("block").agg(F.max_by("known", F.struct("count", "known")).alias("major")), "major")
        outside = F.col("known") != F.col("major")
        minors = known.join(major, "block").filter(outside)
        # Queries are cut into parts of their own, so that a group never holds more than a chunk and a part.
        share = known.join(major, "block").groupBy("block", "chunks").agg(F.count(F.lit(1)).alias("k"), F.count_if(outside).alias("q")).filter("q > 0")
        share = share.withColumn("parts", F.ceil(F.col("q") / ASKED).cast("int")).withColumn("sent", F.col("q") * F.col("chunks") + F.col("k") * F.col("parts"))
        share = stash(share.select("block", "parts", "sent"), "share")
        sent = share.filter(F.col("parts") <= MOST_PARTS).agg(F.sum("sent")).first()[0] or 0
        most = MOST_PARTS if sent <= max(SENT_LEAST, SENT_SHARE * rows.count()) else 0
        few = share.filter(F.col("parts") <= most).select("block", "parts")
        minors = minors.join(few, "block").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("parts")).cast("int"))
        asked = minors.select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "part", "rep", "node", "known")
        there = known.join(few, "block").select("block", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "node", "known")
        plan = asked.withColumn("role", F.lit("query")).unionByName(there.withColumn("role", F.lit("member"))).select(key("block", "chunk", "part").alias("key"), "rep", "node", "role", "known")
        loose = known.join(share.filter(F.col("parts") > most), "block", "left_semi").select("node", "rep", "known", "n")
        loose = stash(loose, "loose")
        if k := loose.count():
            # Only the shingles of these members are sent out again.
            only = df.sparkSession.sparkContext.broadcast(Filter(loose.select(F.col("node").alias("seed")), k))
            plan = plan.unionByName(_by_shingle(postings(only), loose))
        found = stash(found.union(_search(docs, plan, width, t)), "links")

    labels = stash(components(found), "labels")
    tagged = stash(classes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "tagged")
    smallest = stash(tagged.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")
    named = stash(tagged.join(smallest, "component").select(F.col("node").alias("d1"), "component_id", F.col("component").alias("group_key")), "named")
    linked = rows.join(named, "d1", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "group_key", F.col("h").alias("text_hash"))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("group_key", "text_hash")
