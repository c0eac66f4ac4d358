"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.llm._common import WORD, put, read, stash
from quadlake.llm.sharding import bucket_count, bucket_of, shuffle_key


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(sources: DataFrame, budget: float, max_epochs: float) -> float:
    """The water level: with targets min(max_epochs * size, level * weight) the sum is the budget, or all are at their cap.

    Each round clamps the sources above their cap and deals the rest of the budget to the others by weight; a round
    brings one row to the driver, and rounds end when no source is newly clamped.
    """
    cap, level, held = F.col("source_size") * max_epochs, 0.0, -1
    while True:
        free = cap > F.col("weight") * level
        c, w, k = sources.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight"))), F.count(F.when(~free, 1))).first()
        if not w:
            return float("inf")
        if k == held:
            return level
        level, held = (budget - (c or 0.0)) / w, k


def mix(
    df: DataFrame,
    weigh: Callable[[DataFrame], DataFrame],
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Callable[[], Column] = lambda: word_count(F.col("text")),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 29,
) -> DataFrame:
    """Adds size, source_size, target and repeats (times the row enters the mix) to each row.

    `weigh` gets a table of distinct sources (column source) and returns it with a column weight above 0. Sources share
    `share` times the sum of all sizes by weight, none above `max_epochs` times its own. A source enters whole as often as its
    target holds its size; of the fraction left, it takes documents in the order of a seeded hash of their id while
    the middle of the next one is inside, so the sum misses the target by half a document at most.

    The decision is a threshold key for each source, found from sums of hash buckets and the rows of one bucket a source;
    whole rows are never shuffled or sorted.

    Defined results: null sources are a source; null texts have size 0; rows with equal ids are taken together; a source
    of size 0 has target 0 and no repeats; an empty table gives none; input columns of the new names give way.
    """
    src = F.col(f"`{source_col}`").cast("string")
    narrow = stash(df.select(src.alias("source"), shuffle_key(seed, F.col(f"`{id_col}`")).alias("k"), size().alias("size")), "sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stash(weigh(totals.select("source")).join(totals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "weight", "source_size"), "sources")
    whole, rows = narrow.agg(F.sum("size"), F.count(F.lit(1))).first()
    level = fill(sources, share * (whole or 0), max_epochs)
    target = F.least(F.col("source_size") * F.lit(float(max_epochs)), F.col("weight") * F.lit(level)).cast("double")
    plan = sources.select("source", "source_size", target.alias("target"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    b = bucket_count(rows)
    keyed = narrow.withColumn("b", bucket_of(F.col("k"), b))
    sums = keyed.groupBy("source", "b").agg(F.sum("size").alias("g"))
    run = Window.partitionBy("source").orderBy("b")
    sums = sums.select("source", "b", "g", (F.sum("g").over(run) - F.col("g")).alias("before"))
    p = plan.select(F.col("source").alias("s"), "rest")
    # The last bucket that starts inside the rest holds the threshold.
    edge = sums.join(p, F.col("source").eqNullSafe(F.col("s"))).filter(2 * F.col("before") <= 2 * F.col("rest")).groupBy("source").agg(F.max("b").alias("edge"), F.max_by("before", "b").alias("edge_before"), F.first("rest").alias("rest"))
    e = edge.select(F.col("source").alias("s"), F.col("edge"), "edge_before", "rest")
    near = keyed.join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("edge"))).groupBy("source", "k").agg(F.sum("size").alias("g"), F.first("edge_before").alias("before"), F.first("rest").alias("rest"))
    at = F.sum("g").over(Window.partitionBy("source").orderBy("k")) - F.col("g") + F.col("before")
    inside = near.select("source", "k", (2 * at + F.col("g") <= 2 * F.col("rest")).alias("inside"))
    top = inside.groupBy("source").agg(F.max(F.when(F.col("inside"), F.col("k"))).alias("top"))
    limits = edge.select("source", "edge").join(top.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "edge", "top")
    plan = stash(plan.join(limits, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("__ql_s"), "source_size", "target", "epochs", "edge", "top"), "plan")

    plan = plan.select("__ql_s", *[F.col(c).alias(f"__ql_{c}") for c in plan.columns[1:]])
    out = put(df, __ql_k=shuffle_key(seed, F.col(f"`{id_col}`")), __ql_size=size()).join(plan, src.eqNullSafe(F.col("__ql_s")))
    bucket = bucket_of(F.col("__ql_k"), b)
    extra = (bucket < F.col("__ql_edge")) | ((bucket == F.col("__ql_edge")) & (F.col("__ql_k") <= F.col("__ql_top")))
    repeats = F.col("__ql_epochs") + F.coalesce(extra & (F.col("__ql_source_size") > 0), F.lit(False)).cast("int")
    out = put(out, size=F.col("__ql_size"), source_size=F.col("__ql_source_size"), target=F.col("__ql_target"), repeats=repeats)
    return out.drop(*[c for c in out.columns if c.startswith("__ql_")])


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as its repeats say."""
    return mixed.filter("repeats > 0").withColumn("repeats", F.explode(F.sequence(F.lit(1), F.col("repeats"))))


def weights_313(sources: DataFrame) -> DataFrame:
    """3, 1, 2, repeating over the sources by code point, null last. One task ranks the distinct sources."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), ((n - 1) % 3 + 1).cast("int")).alias("weight"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, weights_313).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat('29:', coalesce(doc_id::VARCHAR, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS n FROM w),
b AS (SELECT 1.5::DOUBLE * sum(size)::BIGINT AS budget FROM d),
k AS (SELECT n, source_size, weight, (budget - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
             / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o, b),
l AS (SELECT n, level, 2.0::DOUBLE * source_size > weight * level AS free FROM k),
v AS (SELECT min_by(level, n) AS level FROM l WHERE free),
p AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * coalesce(level, 'inf'::DOUBLE)) AS target FROM w, v),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS epochs FROM p),
r AS (SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.epochs, q.target - q.epochs * q.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k RANGE UNBOUNDED PRECEDING) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.k) AS g
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
t AS (SELECT *, epochs + (source_size > 0 AND (2 * (upto - g) + g)::DOUBLE <= 2 * rest)::INT AS repeats FROM r)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken, source, repeats::INT AS repeats FROM t
"""
