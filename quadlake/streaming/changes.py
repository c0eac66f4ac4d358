"""Change feeds with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema=None, *, files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is taken from the files there, if not given."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)


def update_index(feed: DataFrame, target: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame], *, key: list[str], version: str) -> StreamingQuery:
    """Keeps a table of the newest derived row of each key. Each batch is written to its own folder under target, named by the
    batch, so a batch that runs twice replaces itself; `current` reads the table."""

    def put(batch: DataFrame, n: int) -> None:
        derive(batch).write.mode("overwrite").parquet(f"{target}/batch={n:012d}")

    return feed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: list[str], version: str) -> DataFrame:
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "batch")).alias("__row"))
    return newest.select(*key, "__row.*")


def flush(query: StreamingQuery) -> None:
    """Waits until all that has arrived is in the index."""
    query.processAllAvailable()
    query.awaitTermination()


def windowed_counts(feed: DataFrame, ts: str, by: str, *, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Rows of each value in tumbling windows; rows later than `late` are dropped by the watermark."""
    return feed.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
