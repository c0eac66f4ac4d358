"""Benchmark decontamination by spaced-seed hashing: training and test texts are joined on hashes of fixed masks of words, and
substitution-tolerant overlaps are verified around each hit."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import put, read, stash
from quadlake.llm._filter import Filter
from quadlake.llm._tokens import batches_of, mix, words

#: By the least number of equal words that a leak has: masks (1: the word counts) of which one hits every run with that many equal
#: words where at most a quarter of the words differ, wherever they stand. The tests hold this against all patterns.
MASKS = {
    9: ("111011", "110111", "1001111", "110100011", "111000101"),
    6: ("11101", "100111", "1101001"),
    4: ("111", "1101"),
}
LEAST_IDENTITY = Fraction(3, 4)
#: Words on either side of a hit in which an overlap is looked for. 31 are enough to tell whether there is a leak.
REACH = 63
#: Hits whose first words are so near share the words around them.
STRIDE = 256
#: Texts of which a task remembers that it has searched them.
SEEN = 500_000
LEAKS = "array<struct<item:long,matched:int,words:int,at:int>>"


def needed(n: int, min_matched: int, identity: Fraction = LEAST_IDENTITY) -> int:
    """Equal words that a test text of n words asks for. Texts below five words are only found whole."""
    return n if n < 5 else min(min_matched, math.ceil(identity * n))


def masks_for(least: int) -> list[tuple[str, np.uint64]]:
    """The masks of leaks with `least` equal words, each with a number that keeps its hashes apart from those of others."""
    for m in sorted(MASKS, reverse=True):
        if least >= m:
            return [(x, np.uint64(100 * m + i)) for i, x in enumerate(MASKS[m])]
    return []


#: Odd multipliers of a mask's words, by their place in the mask.
_ODD = np.random.default_rng(20240307).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds_of(hashes: np.ndarray, mask: str, number: np.uint64) -> np.ndarray:
    """A hash for each place of the mask, of the words where it is 1."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, part = np.full(n, mix(np.array([number]))[0]), np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                np.multiply(hashes[i : i + n], _ODD[i], out=part)
                out += part
        np.right_shift(out, np.uint64(32), out=part)
        out ^= part
        out *= _ODD[-1]
        np.right_shift(out, np.uint64(29), out=part)
        out ^= part
    return out


def whole(hashes: np.ndarray) -> np.ndarray:
    """The seed of a text below five words."""
    return seeds_of(hashes, "1" * len(hashes), np.uint64(len(hashes)))


def _test_rows(min_matched: int, identity: Fraction):
    """Of each test text its words' hashes, and its seeds with their places."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of(batch.column("text")):
                part = batch.slice(a, b - a)
                w = words(part.column("text"), "symbol")
                data, seeds = [], []
                for i in range(b - a):
                    h = w.hashes[w.first[i] : w.first[i + 1]]
                    data.append(h.tobytes())
                    if len(h) < 5:
                        seeds.append([(s, 0) for s in whole(h).view(np.int64).tolist()] if len(h) else [])
                    else:
                        found = [seeds_of(h, *m).view(np.int64).tolist() for m in masks_for(needed(len(h), min_matched, identity))]
                        seeds.append([(s, k) for x in found for k, s in enumerate(x)])
                kind = pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.array(data, pa.binary()), pa.array([[{"seed": s, "place": k} for s, k in x] for x in seeds], kind)], names=["item", "test", "seeds"])

    return look


def _hits(masks: list[tuple[str, np.uint64]], shared):
    """Of each text with seeds that pass the filter: the words around them, in pieces of bounded length, and the seeds with their
    places in the piece. Columns key, base (the piece's first word), train, hits."""

    def find(w, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.diff(w.first)
        doc = np.repeat(np.arange(n), counts)
        at, seeds, ends = [], [], []
        for mask, number in masks:
            h = seeds_of(w.hashes, mask, number)
            near = shared.value.passing(h)
            near = near[doc[near] == doc[near + len(mask) - 1]]
            at.append(near)
            seeds.append(h[near])
            ends.append(near + len(mask))
        for i in np.flatnonzero((counts > 0) & (counts < 5)):
            s = whole(w.hashes[w.first[i] : w.first[i + 1]])
            if len(shared.value.passing(s)):
                at.append(w.first[i : i + 1])
                seeds.append(s)
                ends.append(w.first[i + 1 : i + 2])
        at, seeds, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, seeds, ends))
        order = np.argsort(at, kind="stable")
        return at[order], seeds[order].astype(np.uint64), ends[order]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        kind = pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())]))
        for batch in batches:
            keys = batch.column("key").to_pylist()
            fresh = []
            for i, k in enumerate(keys):
                if k not in seen:
                    fresh.append(i)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(k)
            texts, keys = batch.column("text").take(pa.array(fresh, pa.int64())), [keys[i] for i in fresh]
            for a, b in batches_of(texts):
                w = words(texts.slice(a, b - a), "symbol")
                at, seeds, ends = find(w, b - a)
                if not len(at):
                    continue
                doc = np.searchsorted(w.first, at, "right") - 1
                piece = doc.astype(np.int64) << 32 | (at - w.first[doc]) // STRIDE
                cut = np.flatnonzero(np.diff(piece, prepend=-1))
                out = []
                for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
                    d = int(doc[i])
                    start, stop = max(int(w.first[d]), int(at[i]) - REACH), min(int(w.first[d + 1]), int(ends[i:j].max()) + REACH)
                    hits = [{"seed": s, "pos": p} for s, p in zip(seeds[i:j].view(np.int64).tolist(), (at[i:j] - start).tolist(), strict=True)]
                    out.append((keys[a + d], start - int(w.first[d]), w.hashes[start:stop].tobytes(), hits))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], kind)], names=["key", "base", "train", "hits"])

    return look


def best_run(same: np.ndarray, least: int, identity: Fraction) -> tuple[int, int] | None:
    """From the places of equal words on a diagonal: equal words and first place of the run with most of them, the first of several,
    among the runs with `identity` of their words equal; none with fewer than `least`."""
    if len(same) < least:
        return None
    # A run from equal word i to equal word j is good if ends[j] >= begins[i].
    num, den = identity.as_integer_ratio()
    at = np.arange(len(same))
    begins, ends = den * at - num * same, den * (at + 1) - num * (same + 1)
    best = np.maximum.accumulate(ends[::-1])[::-1]
    matched = np.searchsorted(-best, -begins, "right") - at
    i = int(matched.argmax())
    return (int(matched[i]), int(same[i])) if matched[i] >= least else None


def _verify(min_matched: int, identity: Fraction):
    """From aligned words of both sides: the leaks among them."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, items, found = [], [], []
            for i, (n, a, b) in enumerate(zip(batch.column("n").to_pylist(), batch.column("train"), batch.column("test"), strict=True)):
                same = np.flatnonzero(np.frombuffer(a.as_buffer(), np.uint64) == np.frombuffer(b.as_buffer(), np.uint64))
                if run := best_run(same, needed(n, min_matched, identity), identity):
                    keys.append(batch.column("key")[i].as_py())
                    items.append(batch.column("item")[i].as_py())
                    found.append((n, run[0], batch.column("at")[i].as_py() + run[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.int64()), *[pa.array([x[k] for x in found], pa.int32()) for k in (0, 1, 2)]], names=["key", "item", "words", "matched", "at"])

    return look


def _key(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def search(texts: DataFrame, benchmark: DataFrame, *, item_col: str, item_text_col: str, min_matched: int, identity: Fraction) -> DataFrame:
    """key, leaks of each text (key, text) with any."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    items = stash(items.mapInArrow(_test_rows(min_matched, identity), "item long, test binary, seeds array<struct<seed:long,place:int>>").withColumn("test_key", F.xxhash64("test")).dropDuplicates(["item", "test_key"]), "test-texts")
    seeds = stash(items.select("item", "test_key", F.inline("seeds")), "test-seeds")
    lengths = items.select((F.octet_length("test") / 8).cast("int").alias("n")).filter("n >= 5").groupBy(F.least("n", F.lit(2 * min_matched)).alias("n")).count().collect()
    kinds = {masks_for(needed(r["n"], min_matched, identity))[0][0]: masks_for(needed(r["n"], min_matched, identity)) for r in lengths}
    masks = [m for x in sorted(kinds) for m in kinds[x]]
    shared = texts.sparkSession.sparkContext.broadcast(Filter(seeds, seeds.count()))
    pieces = stash(texts.mapInArrow(_hits(masks, shared), "key binary, base int, train binary, hits array<struct<seed:long,pos:int>>"), "training-hits")
    # Narrow rows meet on the seed, hot seeds being split by AQE; only diagonals that a hit proposes get their words.
    diagonals = pieces.select("key", "base", F.inline("hits")).join(seeds, "seed").select("key", "base", "item", "test_key", (F.col("pos") - F.col("place")).alias("start")).distinct()
    diagonals = stash(diagonals, "diagonals")
    # A text that many tasks have searched has one row here.
    once = pieces.select("key", "base", "train").join(diagonals.select("key", "base"), ["key", "base"], "left_semi").dropDuplicates(["key", "base"])
    pairs = diagonals.join(items.select("item", "test_key", "test"), ["item", "test_key"]).join(once, ["key", "base"])
    n, m = (F.octet_length("test") / 8).cast("int"), (F.octet_length("train") / 8).cast("int")
    first = F.greatest(F.lit(0), -F.col("start"))
    size = F.least(n, m - F.col("start")) - first
    aligned = pairs.select("key", "item", n.alias("n"), (F.col("base") + F.col("start") + first).alias("at"), F.substring("train", (F.col("start") + first) * 8 + 1, size * 8).alias("train"), F.substring("test", first * 8 + 1, size * 8).alias("test"))
    found = aligned.mapInArrow(_verify(min_matched, identity), "key binary, item long, words int, matched int, at int")
    best = found.groupBy("key", "item").agg(F.max(F.struct("matched", (-F.col("at")).alias("before"), "words")).alias("b"))
    leak = F.struct("item", F.col("b.matched").alias("matched"), F.col("b.words").alias("words"), (-F.col("b.before")).alias("at"))
    return best.groupBy("key").agg(F.sort_array(F.collect_list(leak)).alias("leaks"))


def find_leaks(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_matched: int = 12, min_identity: float = 0.75) -> DataFrame:
    """df with a column leaks, an array of (item, matched, words, at): a test text of `words` words of which `matched` stand at
    word `at` and after, on one diagonal, in a run with at least `min_identity` (0.75 or more) of its words equal.

    Words are runs of ASCII letters, digits and non-ASCII characters, without regard to case (A-Z). A test text of n words leaks with
    `min_matched` equal words or, if that is less, `min_identity` n of them; one below five words, which stands in many an innocent text,
    leaks into texts that are equal to it word by word. Every such leak is found, wherever the other words stand: the masks
    hit all patterns. `matched` is exact for test texts of up to 64 words; of longer ones it counts the words around a hit.

    Defined results: null and empty texts have no leaks; texts are known by their content, so repeated rows get the same leaks; test
    rows with the same id and words count once, those without id or text not at all; without test texts nobody leaks; very long
    texts are searched in whole; an empty table gives none; an input column named leaks gives way.
    """
    identity = Fraction(str(min_identity))
    if identity < LEAST_IDENTITY:
        raise ValueError("the masks find all leaks from an identity of 0.75 on")
    text = F.col(f"`{text_col}`").cast("string")
    found = search(df.select(_key(text).alias("key"), text.alias("text")).filter("text IS NOT NULL"), benchmark, item_col=item_col, item_text_col=item_text_col, min_matched=min_matched, identity=identity)
    # Written first, so that the planner knows how few texts leak and broadcasts them only below its limit.
    found = stash(found.select(F.col("key").alias("__ql_key"), F.col("leaks").alias("__ql_leaks")), "leaks")
    out = put(df, __ql_own=_key(text)).join(found, F.col("__ql_own") == F.col("__ql_key"), "left")
    return put(out, leaks=F.coalesce("__ql_leaks", F.array().cast(LEAKS))).drop("__ql_own", "__ql_key", "__ql_leaks")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read(spark, sf_dir, "benchmark"))
    best = F.array_max(F.transform("leaks", lambda x: F.struct(x["matched"].alias("m"), (-x["item"]).alias("i"))))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.col("leaks.item").alias("item_ids"), (-best["i"]).alias("item_id"), F.coalesce(best["m"], F.lit(0)).alias("matched"))
