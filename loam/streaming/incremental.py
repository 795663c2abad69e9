"""Incremental indexing: each micro-batch's chunks, or texts, enter their index once.

No state is kept in the streams: an index tells which ids it has, by reading only the id buckets that a batch touches; what a batch writes
carries its number, so that a micro-batch that is replayed replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.text import chunk_id
from loam.operators import index
from loam.sources.store import overwrite_partitions, read_table


def _started(rows: DataFrame, merge, checkpoint: str):
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(chunks: DataFrame, path: str, checkpoint: str, buckets: int = index.BUCKETS):
    """chunks: a streaming DataFrame (path array<string>, text string, further columns), kept once by path and text in a table
    partitioned by the id's bucket and the batch. Returns the started query, which ends with what is there now."""
    keyed = chunks.withColumn("id", chunk_id(F.col("path"), F.col("text")))

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["id"]).withColumn("bucket", index.bucket_of("id", buckets)).withColumn("batch", F.lit(number).cast("long"))
        mine = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most ``buckets``
        known = read_table(batch.sparkSession, path, "id string, bucket int, batch long").filter(F.col("bucket").isin(mine) & (F.col("batch") < number))
        overwrite_partitions(batch.join(known.select("id"), "id", "left_anti"), path, "bucket", "batch")

    return _started(keyed, merge, checkpoint)


def text_index_stream(docs: DataFrame, path: str, checkpoint: str, buckets: int = index.BUCKETS):
    """docs: a streaming DataFrame (id, text), added to the inverted index at ``path``. Returns the started query, which ends with what is there now."""
    return _started(docs.select("id", "text"), lambda batch, number: index.add(batch, path, number, buckets), checkpoint)
