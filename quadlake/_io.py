"""Materialised intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and executors run in the driver."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadlake-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage: a Parquet table in the shared folder, which survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/quadlake/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes by the planner's estimate that go to one partition, and estimates from which on it knows nothing, as over joins and local rows.
PART, UNKNOWN = 8 << 20, 1 << 50


def spread(df: DataFrame, *cols: str, part: int | None = None, most: int = 10_000) -> DataFrame:
    """df dealt out by columns, to partitions that grow in number with the input. Adaptive execution merges partitions by their compressed
    size, which is a small part of what statements take in memory; it does so only where the estimate is small or unknown."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(size // (part or PART), most) if size < UNKNOWN else 0
    return df.repartition(n, *cols) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*cols)
