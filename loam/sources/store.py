"""Where derived tables live: a folder that the driver and all executors reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def workspace(spark: SparkSession) -> str:
    """A new folder in the session's ``spark.checkpoint.dir``; only a local session without one (tests) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="loam-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one if nothing has been written there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` so that only those partitions that it has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back: lineage ends there, and it isn't worked out again."""
    path = f"{workspace(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
