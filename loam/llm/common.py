"""What the training-data operators share: the shared folder, materialised tables and distributed prefix sums.

Intermediate tables are written as Parquet in the folder that ``spark.checkpoint.dir`` names, which the
driver and all executors can reach. That cuts lineage: a lost executor costs the tasks it ran, never a
table that is already written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[str] = []
_made: set[str] = set()
#: Small tables are written in so few files a core; larger ones keep their tasks unless a file would hold fewer than FILE_BYTES.
FILES_A_CORE, FILE_BYTES = 8, 16 << 20


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the application has ended and taken the way to the folder with it
        pass


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the application's own one in the session's shared checkpoint folder.

    Results read from it lazily; the application's folder goes when the driver ends. Only a local session that
    names no checkpoint folder (tests) gets a temporary one; on a cluster that is an error, as executors could not reach it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="loam-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    home = f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    if home not in _made:
        _made.add(home)
        atexit.register(_sweep, spark, home)
    return f"{home}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", whole_partitions: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema.

    Partitions of a small table are written together where they far outnumber the cores, unless ``whole_partitions`` (their
    numbers count). The planner's size of the table bounds that: its bytes a task don't grow with the input.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    if not whole_partitions:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        df = df.coalesce(min(max(FILES_A_CORE * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)), (1 << 31) - 1))
    # Row groups small enough that a writing task buffers little and a reading task can split the file.
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing will read again."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _remove(table.sparkSession, path)


#: Called after each task: empties what a module remembers from row to row.
forget: list = []
#: By name, what empties a memory that the tasks of one function share; other functions' tasks empty it first.
shared_memory: dict = {}


def lean(function, rows: int = 256, keep: str = ""):
    """For mapInArrow: hands ``function`` batches of at most ``rows`` rows and frees the task's memory when it ends, but for the shared memory named ``keep``.

    Spark reuses Python workers, whose leftovers would add up over the stages of a long job.
    """

    def run(batches):
        for name, clear in shared_memory.items():
            if name != keep:
                clear()
        try:
            yield from function(batch.slice(a, rows) for batch in batches for a in range(0, batch.num_rows, rows))
        finally:
            import ctypes

            import pyarrow as pa

            for clear in forget:
                clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return run


def doc_fold(doc_id) -> F.Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (materialised) table has at most ``rows`` rows, else the table for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, groups: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """Adds ``rank`` (gapless from 0 in each group) and, given ``weight``, ``before`` (the sum of weights ahead).

    No group is gathered in one task: rows are range-partitioned by group and order, so that a hot group
    spreads over many tasks; each task counts its own rows, and the counts of earlier tasks (one row per
    task and group it holds) are added afterwards. ``order`` should end in a key that tells rows apart;
    rows equal in all of it come in any order among themselves and may share a task.
    """
    fields = [f for f in df.schema.fields]
    added = [T.StructField("_pid", T.IntegerType()), T.StructField("_rank", T.LongType()), T.StructField("_before", T.LongType())]
    schema = T.StructType(fields + added)

    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, rank, total = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(g)).to_pylist() for g in groups]
            keys = list(zip(*keys)) if groups else [()] * n
            w = np.zeros(n, np.int64) if weight is None else batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks, before = np.empty(n, np.int64), np.empty(n, np.int64)
            starts = [i for i in range(n) if (keys[i] != keys[i - 1] if i else keys[0] != last)]
            bounds = sorted({0, *starts, n})
            for a, b in zip(bounds[:-1], bounds[1:]):
                if keys[a] != last:
                    last, rank, total = keys[a], 0, 0
                ranks[a:b] = rank + np.arange(b - a)
                sums = np.cumsum(w[a:b])
                before[a:b] = total + sums - w[a:b]
                rank, total = rank + b - a, total + int(sums[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(ranks), pa.array(before)],
                names=[*batch.schema.names, "_pid", "_rank", "_before"],
            )

    spread = df.repartitionByRange(n_parts(df.sparkSession), *groups, *order).sortWithinPartitions(*groups, *order)
    numbered = materialise(spread.mapInArrow(number, schema), "ranked", whole_partitions=True)
    # Range partitions are in order, so that a group's earlier rows are in partitions of smaller number.
    counts = numbered.groupBy(*groups, "_pid").agg(
        F.count("*").alias("_n"), (F.sum(weight) if weight else F.lit(0)).cast("long").alias("_w")
    )
    ahead = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_pid", F.sum("_n").over(ahead).alias("_on"), F.sum("_w").over(ahead).alias("_ow")).filter("_on > 0")
    offsets = materialise(offsets, "offsets")
    on = " and ".join(["x._pid = o._pid", *[f"x.`{g}` <=> o.`{g}`" for g in groups]])
    out = numbered.alias("x").join(small(offsets).alias("o"), F.expr(on), "left")
    picked = [F.col(f"x.`{f.name}`") for f in fields]
    picked.append((F.col("x._rank") + F.coalesce("o._on", F.lit(0))).alias("rank"))
    if weight is not None:
        picked.append((F.col("x._before") + F.coalesce("o._ow", F.lit(0))).alias("before"))
    return out.select(*picked)
