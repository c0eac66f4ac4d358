"""Toxicity by maximum-scoring segments of token log-odds.

Tokens score their log-odds between toxic and clean rows under a Dirichlet prior that follows the whole corpus. A linear-time
scan finds all maximal scoring segments of a text; the extreme-value law of clean texts' best segments turns scores into
significance, and significant segments are summed into the text's score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import put, read, stash
from quadlake.llm._counts import FLUSH, term_counts, terms
from quadlake.llm._labels import fold, labelled

SEGMENTS = "array<struct<start:int,end:int,score:double>>"


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time, by the rule of Ruzzo and Tompa."""
    run = np.concatenate([[0.0], np.cumsum(scores)])
    starts, ends, lefts, rights = [], [], [], []
    jump: list[int] = []  # for each candidate, the nearest earlier one with a smaller left sum
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    # Neighbouring positive tokens always belong together.
    cut = np.flatnonzero(np.diff(up) > 1)
    for a, b in zip(up[np.concatenate([[0], cut + 1])].tolist(), (up[np.concatenate([cut, [len(up) - 1]])] + 1).tolist(), strict=True):
        left, right = float(run[a]), float(run[b])
        while True:
            j = len(starts) - 1
            while j >= 0 and lefts[j] >= left:
                j = jump[j]
            if j < 0 or rights[j] >= right:
                break
            a, left = starts[j], lefts[j]  # joins everything from candidate j on
            del starts[j:], ends[j:], lefts[j:], rights[j:], jump[j:]
        starts.append(a)
        ends.append(b)
        lefts.append(left)
        rights.append(right)
        jump.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(starts, ends, lefts, rights, strict=True)]


def keys(text: str) -> set[str]:
    """What is counted once for each text: its tokens and, for tokens never seen before, their stems."""
    found = set(terms(text))
    return found | {stem(t) for t in found}


def stem(token: str) -> str:
    return f"^{token[:4]}"


class Scores(dict):
    """Scores of tokens, remembered once looked up: the token's own, else its stem's, else that of the rest."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        m = self.model
        found = m.tokens.get(token)
        if found is None:
            found = m.tokens.get(stem(token), m.rest)
        if len(self) < 2_000_000:
            self[token] = found
        return found


@dataclass
class Model:
    tokens: dict[str, float]  #: log-odds of the tokens that tell something
    rest: float  #: of all others
    decay: float = 1.0  #: lambda of the extreme-value law
    size: float = 0.1  #: K of the extreme-value law
    weights: tuple[float, float, float] = (-3.0, 1.0, 0.0)

    def find(self, text: str, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
        found = np.array([scores[t] for t in terms(text)], float)
        return len(found), segments(found) if len(found) else []

    def excess(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Bits in excess of the expected best of n tokens: of the best segment, of all significant ones, and those."""
        if not found:
            return -5.0, 0.0, []
        base = math.log(self.size * n)
        over = [self.decay * s - base for _, _, s in found]
        # Expected number of such segments in a clean text below 1 in 20.
        good = [(seg, x) for seg, x in zip(found, over, strict=True) if x > 3.0]
        return max(-5.0, min(30.0, max(over))), math.log1p(sum(x for _, x in good)), [seg for seg, _ in good]

    def probability(self, best: float, total: float) -> float:
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * total
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _count_by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[tuple[str, int]] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.string()), pa.array([y for _, y in held], pa.int32()), pa.array(held.values(), pa.int64())], names=["term", "label", "n"])

    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            held.update((t, y) for t in keys(text or ""))
            if len(held) > FLUSH:
                yield out()
                held.clear()
    yield out()


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a slight ridge, by Newton's method; the first is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.1] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -5, 5)
    return w


def train(rows: DataFrame, corpus: DataFrame, *, text_col: str = "text", strength: float = 0.1, min_z: float = 2.5) -> Model:
    """rows: text and label of the bounded sample; corpus: all rows, whose counts shape the prior.

    Counts are of texts, so that a text that repeats a token counts once. `strength` is the prior's weight in labelled tokens; tokens with a z of
    `min_z` or more keep scores of their own. These are tokens of the bounded sample.
    """
    by = rows.mapInArrow(_count_by_label, "term string, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("y0"))
    by = by.join(term_counts(corpus, F.col(f"`{text_col}`"), keys), "term", "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.col("y1") + F.col("y0")))
    by = stash(by, "token-counts")
    n1, n0, total = (float(x or 0) for x in by.agg(F.sum("y1"), F.sum("y0"), F.sum("n")).first())
    if not n1 or not n0:
        return Model({}, -0.1)
    weight = strength * (n1 + n0)
    a = F.lit(weight) * F.col("n") / F.lit(total)
    odds = lambda y, n: F.log((y + a) / (n + weight - y - a))
    delta = odds(F.col("y1"), F.lit(n1)) - odds(F.col("y0"), F.lit(n0))
    z = delta / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    top = by.select("term", "y1", "y0", delta.alias("delta"), z.alias("z")).filter(F.abs("z") >= min_z).orderBy("term").toArrow().to_pydict()
    q, p = (sum(top["y1"]) + 1) / (n1 + 2), (sum(top["y0"]) + 1) / (n0 + 2)
    # All other tokens share one score, which is below 0 so that the scan of a clean text drifts down.
    rest = min(-0.02, math.log((1 - q) / (1 - p)))
    model = Model(dict(zip(top["term"], top["delta"], strict=True)), rest)

    shared = rows.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for batch in batches:
            out = [(y, *shared.value.find(t or "", scores)) for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _, _ in out], pa.int32()), pa.array([n for _, n, _ in out], pa.int32()), pa.array([[s for _, _, s in f] for _, _, f in out], pa.list_(pa.float64()))], names=["label", "n", "scores"])

    # One row of the bounded sample each.
    got = rows.mapInArrow(look, "label int, n int, scores array<double>").toArrow().to_pydict()
    clean = [(n, max(s)) for y, n, s in zip(got["label"], got["n"], got["scores"], strict=True) if y == 0 and n and s]
    if clean:
        n, best = np.array([x for x, _ in clean], float), np.array([x for _, x in clean])

        def fit(decay: float) -> tuple[float, float]:
            size = len(n) / np.sum(n * np.exp(-decay * best))
            return float(len(n) * math.log(decay * size) + np.sum(np.log(n) - decay * best) - size * np.sum(n * np.exp(-decay * best))), size

        model.decay = max(np.arange(0.1, 2.01, 0.05).tolist(), key=lambda d: fit(d)[0])
        model.size = fit(model.decay)[1]
    x = np.array([model.excess(n, [(0, 0, v) for v in s])[:2] for n, s in zip(got["n"], got["scores"], strict=True)])
    model.weights = tuple(_logistic(x, np.array(got["label"], float)).tolist())
    return model


def score(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """df with toxicity (0 to 1) and passages, the significant segments as token ranges with scores.

    Defined results: null and empty texts have no passages and the score of a text without any; repeated rows score alike;
    an empty table gives none; input columns of the new names give way.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = Scores(m)
        for batch in batches:
            values, passages = [], []
            for t in batch.column(text_col):
                best, total, good = m.excess(*m.find(t.as_py() or "", scores))
                values.append(m.probability(best, total))
                passages.append([{"start": a, "end": b, "score": s} for a, b, s in good])
            i, j = batch.schema.get_field_index("toxicity"), batch.schema.get_field_index("passages")
            yield batch.set_column(i, "toxicity", pa.array(values, pa.float64())).set_column(j, "passages", pa.array(passages, kind))

    out = put(df, toxicity=F.lit(None).cast("double"), passages=F.array().cast(SEGMENTS))
    return out.mapInArrow(look, out.schema)


def op5(spark, sf_dir: str, sample: int = 20000) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    rows = labelled(docs, labels.filter(fold(F.col("doc_id"), 3) != 1), label_col="toxic", sample=sample)
    found = score(docs, train(rows, docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
