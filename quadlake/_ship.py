"""Gives Python workers the package, wherever the driver has it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that goes to a Python worker, where the session does not say: two copies of it are held on either side.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, SPARKS_OWN = "4m", str(64 << 20)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors through Spark's file server, once for each application."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH, SPARKS_OWN).rstrip("b") == SPARKS_OWN:
        spark.conf.set(BATCH, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quadlake-code-"), "quadlake_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
