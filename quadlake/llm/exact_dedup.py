"""Exact deduplication by 128-bit content hash with a comparison of the bytes inside each hash group.

Only DataFrame functions run here. The plan has one pass that shuffles whole texts, already reduced to one row for each
task and text by the map-side aggregation, so a text that fills a third of the table costs no more than any other, and one
narrow join that gives each row its class; AQE splits that join where one class is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import ascii_lower


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = ascii_lower,
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by `hash_of(normalised text)`; inside a hash group the texts themselves are grouping keys, so Spark
    compares their bytes and texts that merely collide get classes of their own. The row with the smallest
    (`keep="min"`) or largest (`"max"`) id stays.

    Defined results: a null text counts as empty; ids that occur on several rows of a class are all marked kept if that id
    is the one kept, as a row is known by its id only; a null id is never kept unless all ids of its class are null;
    an empty table gives no rows; other columns of the input are ignored, whatever their names.
    Two different texts of one hash group that also share their SHA-256 would stop the query with an error.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    hashed = rows.select("id", "t", hash_of(F.col("t")).alias("h"))
    classes = (
        hashed.groupBy("h", "t")
        .agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size")
        .groupBy("h", "text_sha256")
        .agg(F.count(F.lit(1)).alias("n"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .withColumn("group_size", F.when(F.col("n") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("long")).otherwise(F.col("group_size")))
        .drop("n")
    )
    narrow = hashed.select("id", "h", F.sha2("t", 256).alias("text_sha256"))
    return narrow.join(classes, ["h", "text_sha256"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op4(spark, sf_dir: str) -> DataFrame:
    from quadlake.llm._common import read

    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
