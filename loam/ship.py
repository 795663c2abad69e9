"""Readies a Spark application once: this package on the executors' import path, Arrow batches of a bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Spark's default of 10,000 whole documents a batch takes tens of MB outside the heap for each task.
ARROW_ROWS = 2000
#: Batches end at so many bytes if that is sooner: buffers of long rows stay in the executor's memory outside the heap, for each thread that held one.
ARROW_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ARROW_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "loam_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shipped(function):
    """The query ``function(spark, ...)`` with the package shipped first."""

    def run(spark, *args):
        ship(spark)
        return function(spark, *args)

    return run
