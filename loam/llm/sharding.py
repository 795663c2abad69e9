"""Operator 9, sharding: best-fit-decreasing packing of indivisible groups into shards of near-equal bytes.

Equal texts form a group and a group is never split. Groups are packed by size, the largest first, each into
the open shard with the tightest remaining room that still takes it (a balanced tree of remaining
capacities); the capacity is the smallest, found by bisection, at which the wanted number of shards is
enough. Groups of one size are interchangeable, so the driver packs a histogram of sizes, not groups: sizes
are rounded up to ``PRECISION`` parts of their power of two, which bounds the histogram by
64 * PRECISION entries whatever the number of documents. A group larger than an even share gets a shard
of its own, and the rest is spread over the other shards.

Defined cases: a null text counts as empty (size 8) and is in the group of empty texts; repeated rows are
rows of one group, each with a slot of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import materialise, ranked, small

PRECISION = 256


class CapacityTree:
    """A treap of (remaining room, bin), asked for the tightest bin that still takes a size."""

    def __init__(self):
        self.root = None
        self.seed = 1

    def _priority(self) -> int:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        return self.seed >> 20

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, room: int, bin_id: int) -> None:
        key = (room, bin_id)
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, None, None, self._priority()]), right)

    def take(self, size: int):
        """Removes and returns the (room, bin) of least room that is at least ``size``, or None."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        parent, node = None, right
        while node[1] is not None:
            parent, node = node, node[1]
        if parent is None:
            right = node[2]
        else:
            parent[1] = node[2]
        self.root = self._merge(left, right)
        return node[0]


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most: int) -> list[tuple[int, int, int]] | None:
    """Packs (size, count) classes into at most ``most`` bins of ``capacity``: runs of (size, bin, count), or None.

    A class goes to the tightest bin as often as it fits there, then to the next one: just what placing its
    groups one by one does, as the bin that took one is the tightest still.
    """
    tree, opened, runs = CapacityTree(), 0, []
    for size, count in sorted(histogram, reverse=True):
        while count:
            got = tree.take(size)
            if got is None:
                if opened == most or size > capacity:
                    return None
                got, opened = (capacity, opened), opened + 1
            room, b = got
            n = min(count, room // size)
            runs.append((size, b, n))
            tree.add(room - n * size, b)
            count -= n
    return runs


def plan_shards(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs of (size, shard, count) that cover the histogram with the smallest capacity bisection finds."""
    classes = sorted(((s, n) for s, n in histogram if n > 0), reverse=True)
    own, left = [], shards
    total = sum(s * n for s, n in classes)
    while classes and left > 1 and classes[0][0] * left >= total:
        size, n = classes[0]
        own.append((size, shards - left, 1))
        total, left = total - size, left - 1
        classes = [(size, n - 1), *classes[1:]] if n > 1 else classes[1:]
    if not classes:
        return own
    low, high = max(classes[0][0], -(-total // left)), classes[0][0] + -(-total // left) + 1
    best = best_fit_decreasing(classes, high, left)
    while best is None:
        high *= 2
        best = best_fit_decreasing(classes, high, left)
    for _ in range(40):
        if high - low <= max(1, total // left // 10_000):
            break
        mid = (low + high) // 2
        got = best_fit_decreasing(classes, mid, left)
        if got is None:
            low = mid + 1
        else:
            best, high = got, mid
    return own + [(s, b + shards - left, n) for s, b, n in best]


def size_class(size):
    """Sizes rounded up to a multiple of their power of two's PRECISION-th part."""
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double")))) / PRECISION)
    return (F.ceil(size / step) * step).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, group (sha-256 of the text), shard and slot (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
    )
    rows = materialise(rows, "rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes")).withColumn("cls", size_class(F.col("bytes")))
    groups = materialise(groups.select("grp", "cls"), "groups")
    histogram = [(r["cls"], r["n"]) for r in groups.groupBy("cls").agg(F.count("*").alias("n")).collect()]
    placed: dict[int, list] = {}
    for size, shard, n in plan_shards(histogram, shards):
        ends = placed.setdefault(size, [[], []])
        ends[0].append((ends[0][-1] if ends[0] else 0) + n)
        ends[1].append(shard)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            cls, rank = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            shard = [placed[c][1][bisect.bisect_right(placed[c][0], r)] for c, r in zip(cls, rank)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard, pa.int32())], names=["grp", "shard"])

    owner = ranked(groups, ["cls"], ["grp"]).select("grp", "cls", "rank").mapInArrow(place, "grp binary, shard int")
    out = rows.join(owner, "grp")
    return ranked(out.select("doc_id", "size", "text_crc32", "grp", "shard"), ["shard"], ["doc_id", "grp"]).withColumnRenamed("rank", "slot")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
