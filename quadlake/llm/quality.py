"""Text quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature at a time, and then on the pairs that explain most of what is left. Their sum is
a lookup table for each feature and pair, so scoring adds one table entry for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import put, read
from quadlake.llm._labels import fold, labelled
from quadlake.llm._tokens import batches_of, windows, words

FEATURES = ["words", "word_length", "upper", "symbols", "exclaims", "bars", "digits", "stops", "lines", "distinct", "top", "short", "longest", "twice", "fresh"]


def _bytes_in(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars.encode())] = 1
    return table


_CLASSES = [_bytes_in(c) for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*@^~=+<>{}[]\\/_", "!", "|", "0123456789", ".,;:?", "\n")]


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null is the empty text."""
    texts = pa.concat_arrays([pa.compute.fill_null(texts.cast(pa.large_string()), "")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, n = offsets - offsets[0], len(texts)
    full = np.maximum(np.diff(offsets), 1)

    def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return run[first[1:]] - run[first[:-1]]

    upper, symbols, exclaims, bars, digits, stops, lines = (sums(t[raw], offsets) for t in _CLASSES)
    w = words(texts)
    counts = np.diff(w.first)
    some = np.maximum(counts, 1)
    lens = w.ends - w.starts
    longest, distinct, top, fresh = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    shingles = windows(w.hashes, [1] * 5)
    for i in np.flatnonzero(counts):
        a, b = w.first[i], w.first[i + 1]
        longest[i] = lens[a:b].max()
        each = np.unique(w.hashes[a:b], return_counts=True)[1]
        distinct[i], top[i] = len(each), each.max()
        if b - a >= 5:
            fresh[i] = len(np.unique(shingles[a : b - 4])) / (b - a - 4)
        else:
            fresh[i] = 1.0
    doc = np.repeat(np.arange(n), counts)
    same = np.zeros(len(w.hashes), np.uint8)
    if len(same) > 1:
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    columns = [np.log1p(counts), sums(lens, w.first) / some, upper / full, symbols / full, exclaims / full, bars / full, digits / full, stops / some, lines / some, distinct / some, top / some, sums(lens <= 3, w.first) / some, np.log1p(longest), sums(same, w.first) / some, fresh]
    return np.column_stack(columns)


@dataclass
class Model:
    edges: list[np.ndarray]  #: inner bin edges of each feature
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = self.base + sum(t[b[:, j]] for j, t in enumerate(self.tables))
        return z + sum((g[b[:, i], b[:, j]] for (i, j), g in zip(self.pairs, self.grids, strict=True)), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    return -g / (h + ridge)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values by bin of a tree of the given depth, from sums of gradients and Hessians by bin."""
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])
    return np.full(len(g), _leaf(g.sum(), h.sum()))


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by cell of the best cut of both axes, and how much it gains."""
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        ll = c[:-1, :-1]
        return [ll, c[:-1, -1:] - ll, c[-1:, :-1] - ll, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + ll]

    pg, ph = parts(cg), parts(ch)
    gain = sum(_gain(a, b) for a, b in zip(pg, ph, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    leaf = [float(_leaf(a[i, j], b[i, j])) for a, b in zip(pg, ph, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain[i, j] - _gain(g.sum(), h.sum()))


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 300, rate: float = 0.1, pairs: int = 6, patience: int = 20, seed: int = 5) -> Model:
    """Cyclic boosting with early stopping on a seventh of the rows."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
    model = Model(edges, tables=[np.zeros(len(e) + 1) for e in edges])
    if len(set(y.tolist())) < 2:
        model.base = 4.0 if len(y) and y[0] else -4.0 if len(y) else 0.0
        return model
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    b = model.bins(x)
    held = np.random.default_rng(seed).random(len(x)) < 1 / 7
    t, v = np.flatnonzero(~held), np.flatnonzero(held)
    z = np.full(len(x), model.base)

    def loss() -> float:
        return float(np.mean(np.logaddexp(0, np.where(y[v] > 0, -z[v], z[v])))) if len(v) else 0.0

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z[t], -30, 30)))
        return p - y[t], p * (1 - p)

    def boost(step) -> None:
        nonlocal z
        best, kept, since = loss(), (z.copy(), [a.copy() for a in model.tables], [a.copy() for a in model.grids]), 0
        for _ in range(rounds):
            step()
            now = loss()
            if now < best - 1e-6 or not len(v):
                best, kept, since = now, (z.copy(), [a.copy() for a in model.tables], [a.copy() for a in model.grids]), 0
            else:
                since += 1
                if since >= patience:
                    break
        z, model.tables, model.grids = kept

    def features_in_turn() -> None:
        for j in range(len(edges)):
            g, h = slopes()
            n = len(model.tables[j])
            add = rate * _tree(np.bincount(b[t, j], g, n), np.bincount(b[t, j], h, n), 2)
            model.tables[j] += add
            z[:] += add[b[:, j]]

    def grid(values: np.ndarray, i: int, j: int) -> np.ndarray:
        n, m = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[t, i] * m + b[t, j], values, n * m).reshape(n, m)

    def pairs_in_turn() -> None:
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            add = rate * _cross(grid(g, i, j), grid(h, i, j))[0]
            model.grids[k] += add
            z[:] += add[b[:, i], b[:, j]]

    boost(features_in_turn)
    g, h = slopes()
    ranked = sorted(((_cross(grid(g, i, j), grid(h, i, j))[1], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    model.grids = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    boost(pairs_in_turn)
    return model


def train(rows: DataFrame) -> Model:
    """rows: text and label of a bounded sample; their features, a few numbers a row, are fitted on the driver."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of(batch.column("text")):
                part = batch.slice(a, b - a)
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())), part.column("doc_id").cast(pa.int64())], names=["label", "x", "doc_id"])

    got = rows.mapInArrow(look, "label int, x array<double>, doc_id long").orderBy("doc_id").toArrow().to_pydict()
    return fit(np.array(got["x"], float).reshape(-1, len(FEATURES)), np.array(got["label"], float))


def score(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """df with quality (0 to 1). Null and empty texts share one score; repeated rows score alike; an input column of that name
    gives way; an empty table gives none."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.schema.get_field_index(text_col), batch.schema.get_field_index("quality")
            for a, b in batches_of(batch.column(i)):
                part = batch.slice(a, b - a)
                yield part.set_column(j, "quality", pa.array(shared.value.probability(features(part.column(i)))))

    out = put(df, quality=F.lit(None).cast("double"))
    return out.mapInArrow(look, out.schema)


def op6(spark, sf_dir: str, sample: int = 20000) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    rows = labelled(docs, labels.filter(fold(F.col("doc_id"), 5) != 0), label_col="quality", sample=sample)
    found = score(docs, train(rows))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))
