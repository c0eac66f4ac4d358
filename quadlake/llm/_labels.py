"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import stash


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, *, label_col: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and label (0 or 1) of about `sample` labelled rows, picked by a hash of the id; all rows if there are fewer.

    The picked labels are written first, so that the planner knows how small they are when it joins them.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, sample / max(1, usable.count()))
    picked = stash(usable.filter(F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 20)) < share * (1 << 20)), "labels")
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), id_col)
