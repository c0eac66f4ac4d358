"""Places in chains: links a -> b of which each node has one out and one in at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlake._io import discard, materialise
from quadlake._ship import ship


def _runs(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each link of a batch the row of the first link of its run in the batch, the links before it there, and whether it is the last."""
    n = len(a)
    after = pc.fill_null(pc.index_in(b, value_set=a, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    at = np.arange(n)
    linked = after >= 0
    at[after[linked]] = np.flatnonzero(linked)
    inner = np.zeros(n, bool)
    inner[after[linked]] = True
    off = inner.astype(np.int64)
    for _ in range(n.bit_length() + 1):
        if not inner[at].any():
            break
        off, at = off + off[at], at[at]
    alone = inner[at]  # on a cycle: each link is a run of its own
    return np.where(alone, np.arange(n), at), np.where(alone, 0, off), alone | ~linked


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        groups = [t]
        if "graph_iri" in t.column_names:
            names = pc.unique(t["graph_iri"])
            groups = [t] if len(names) < 2 else [t.filter(pc.equal(t["graph_iri"], g) if g.is_valid else pc.is_null(t["graph_iri"])) for g in names]
        for g in groups:
            a, b = (g[c].combine_chunks() for c in ("a", "b"))
            if len(a):
                a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b))
                start, off, last = _runs(a, b)
                g = g.append_column("start", a.take(pa.array(start))).append_column("off", pa.array(off, pa.int64())).append_column("last", pa.array(last))
                yield from g.combine_chunks().to_batches()


def contracted(links: DataFrame) -> DataFrame:
    """Written links (a, b and perhaps graph_iri; b null where a chain ends) with start, off and last of the run that a batch of rows
    holds of their chain. Links that stand in order, as they mostly do, make few runs; in any order they make more."""
    kind = links.schema["a"].dataType
    schema = T.StructType([*links.schema, T.StructField("start", kind), T.StructField("off", T.LongType()), T.StructField("last", T.BooleanType())])
    ship(links.sparkSession)
    return materialise(links.mapInArrow(_contract, schema))


def simple(links: DataFrame) -> bool:
    """Whether all are chains or cycles. By hashes: nodes that share one are taken for the same, which costs the short way only."""
    by = [c for c in ("graph_iri",) if c in links.columns]
    ends = links.select(F.xxhash64(*by, "a").alias("h"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.filter("b IS NOT NULL").select(F.xxhash64(*by, "b"), F.lit(0), F.lit(1)))
    return ends.repartition("h").groupBy("h").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 OR into > 1").isEmpty()


def places(runs: DataFrame) -> tuple[DataFrame, bool]:
    """Contracted links that are simple with head and pos, their chain's first node and the links before it, and a row with b null for each
    last node that has no link out (further columns are null there); whether there are cycles, whose links have no head.

    Runs that follow another one jump back along runs, twice as far in each round; links themselves are not joined, and are shuffled only
    where the runs that follow others are many."""
    by = [c for c in ("graph_iri",) if c in runs.columns]
    extra = [c for c in runs.columns if c not in {*by, "a", "b", "start", "off", "last"}]
    exits = materialise(runs.filter("last AND b IS NOT NULL").select(*by, F.col("b").alias("start"), F.col("start").alias("at"), (F.col("off") + 1).alias("pos")))
    starts = runs.filter("off = 0").select(*by, F.col("a").alias("start"), F.lit(True).alias("linked")).join(exits.select(*by, "start"), [*by, "start"], "left_semi")
    linked = materialise(exits.join(starts, [*by, "start"], "left"))
    discard(exits)
    back = linked.filter("linked").select(*by, "start", "at", "pos", F.lit(True).alias("open"))
    rounds, n = 0, back.count()
    while rounds <= n.bit_length() and not back.filter("open").isEmpty():
        more = back.select(*by, F.col("start").alias("at"), F.col("at").alias("further"), F.col("pos").alias("more"))
        now = materialise(back.join(more, [*by, "at"], "left").select(*by, "start", F.coalesce("further", "at").alias("at"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.col("further").isNotNull().alias("open")))
        if rounds:
            discard(back)
        back, rounds = now, rounds + 1
    rings = not back.filter("open").isEmpty()
    ends = linked.filter("linked IS NULL").select(*by, F.col("start").alias("a"), F.col("at").alias("start"), F.col("pos").alias("off"))
    back = back.select(*by, "start", F.when(~F.col("open"), F.col("at")).alias("at"), "pos", F.lit(True).alias("moved"))
    placed = runs.drop("last").unionByName(ends, allowMissingColumns=True).join(back, [*by, "start"], "left")
    head = F.when(F.col("moved"), F.col("at")).otherwise(F.col("start"))
    return placed.select(*by, "a", "b", *extra, head.alias("head"), (F.col("off") + F.coalesce("pos", F.lit(0))).alias("pos")), rings
