"""Corpus counts of terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term: two letters or more of any script, lower-cased.
TERM = re.compile(r"[^\W\d_]{2,}")
#: Terms a task counts before it hands its counts on; the sums do not depend on it.
FLUSH = 100_000


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def term_counts(df: DataFrame, text: Column, keys: Callable[[str], Iterable[str]] = lambda t: set(terms(t))) -> DataFrame:
    """term, n: rows whose text has the key, over every row and whole text. Tasks count first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])

        for batch in batches:
            for x in batch.column(0):
                if t := x.as_py():
                    held.update(keys(t))
                    if len(held) > FLUSH:
                        yield out()
                        held.clear()
        yield out()

    return df.select(text.cast("string").alias("t")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
