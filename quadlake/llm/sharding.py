"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.llm._common import put, read

#: Mean rows of a bucket of the shuffle key, and the most buckets. Above 65,536 buckets' worth of rows the buckets grow.
ROWS_PER_BUCKET, MOST_BUCKETS = 1024, 65536


def shuffle_key(seed: int, *cols: Column) -> Column:
    """32 hex digits that order rows at random, the same on each run and in any SQL engine with MD5."""
    parts = [x for c in cols for x in (F.lit(":"), F.coalesce(c.cast("string"), F.lit("")))]
    return F.md5(F.concat(F.lit(str(seed)), *parts))


def bucket_count(rows: int) -> int:
    return min(MOST_BUCKETS, 16 ** max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET, 16))))


def bucket_of(key: Column, buckets: int) -> Column:
    """The key's leading hex digits as a number; buckets is a power of 16."""
    return F.conv(F.substring(key, 1, round(math.log(buckets, 16))), 16, 10).cast("int")


def interleave(df: DataFrame, *, shards: int, id_col: str = "doc_id", stratum_col: str = "source", seed: int = 17, tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (0, 1, ... in each shard): row counts of shards differ by at most one and each
    holds every stratum in its share of the whole.

    Rows of a stratum get ranks r in the order of a seeded hash of the id; all rows are then put in the order of
    (r + 1/2) / n, n being the stratum's size, and cut into equal runs. Ranks come from counts of hash buckets plus a
    rank inside a bucket, so that neither a stratum with a third of all rows nor the final order meets in one task.

    Defined results: null strata form a stratum, which sorts last; null ids hash as empty; repeated ids tie and take
    `tie_cols`, then the input's order; an empty table gives none; input columns named shard or slot give way.
    """
    rows = df.count()
    b = bucket_count(rows)
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(f"`{stratum_col}`").cast("string")), F.lit("~"))
    keyed = put(df, __ql_s=stratum, __ql_k=shuffle_key(seed, F.col(f"`{id_col}`")))
    keyed = put(keyed, __ql_b=bucket_of(F.col("__ql_k"), b))
    counts = keyed.groupBy("__ql_s", "__ql_b").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("__ql_s")
    before = counts.select("__ql_s", "__ql_b", (F.sum("c").over(whole.orderBy("__ql_b")) - F.col("c")).alias("__ql_before"), F.sum("c").over(whole).alias("__ql_n"))
    inside = Window.partitionBy("__ql_s", "__ql_b").orderBy("__ql_k", F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in tie_cols])
    ranked = keyed.join(before, ["__ql_s", "__ql_b"]).withColumn("__ql_r", F.col("__ql_before") + F.row_number().over(inside))
    placed = ranked.withColumn("__ql_f", (2 * F.col("__ql_r") - 1) / (2 * F.col("__ql_n"))).withColumn("__ql_g", F.floor(F.col("__ql_f") * b).cast("int"))
    spans = placed.groupBy("__ql_g").agg(F.count(F.lit(1)).alias("c"))
    # At most MOST_BUCKETS rows, whatever the input: the one window without a partition.
    starts = spans.select("__ql_g", (F.sum("c").over(Window.orderBy("__ql_g")) - F.col("c")).alias("__ql_start"))
    order = Window.partitionBy("__ql_g").orderBy("__ql_f", "__ql_s", "__ql_k", F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in tie_cols])
    at = placed.join(F.broadcast(starts), "__ql_g").withColumn("__ql_p", F.col("__ql_start") + F.row_number().over(order) - 1)
    shard = F.expr(f"(__ql_p * {shards}) div {max(rows, 1)}")
    at = at.withColumn("__ql_shard", shard)
    first = F.expr(f"(__ql_shard * {rows} + {shards - 1}) div {shards}")
    out = put(at, shard=F.col("__ql_shard").cast("int"), slot=F.col("__ql_p") - first)
    return out.drop(*[c for c in out.columns if c.startswith("__ql_")])


def digest(docs: DataFrame) -> DataFrame:
    """What the contract asks of each document besides its place."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    out = interleave(digest(docs), shards=shards, tie_cols=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8(spark, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
