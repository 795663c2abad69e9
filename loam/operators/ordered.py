"""Ranks, prefix sums and rotations over whole tables and hot groups: range partitions and the counts of those before, no window over a group.

Rows are range-partitioned by group and order and written once with their partition's number. A window then numbers
the rows of one partition only, however large a group is, and the few rows (one a partition and group in it) that say how much lies in earlier
partitions are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.sources.store import stored


def ranked(df: DataFrame, groups: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 0, gapless in each group) and, given ``weight``, ``before`` (the sum of weights ahead in the group).

    Null groups are one group. Rows equal in all of ``order`` come in any order among themselves.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(n, *groups, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("_part", *groups).orderBy(*order)
    amount = F.col(weight) if weight else F.lit(0)
    rows = rows.withColumn("_nth", F.row_number().over(here) - 1).withColumn("_sum", F.sum(amount).over(here.rowsBetween(Window.unboundedPreceding, 0)) - amount)
    counts = rows.groupBy(*groups, "_part").agg(F.count("*").alias("_n"), F.sum(amount).alias("_w"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only a partition's first group can have rows in earlier ones: at most one row a partition is left.
    ahead = counts.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_part").alias("_p"), F.sum("_n").over(earlier).alias("_an"), F.sum("_w").over(earlier).alias("_aw")).filter("_an > 0")
    met = F.col("_part") == F.col("_p")
    for g in groups:
        met = met & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = rows.join(F.broadcast(ahead), met, "left")
    added = [(F.col("_nth") + F.coalesce("_an", F.lit(0))).cast("long").alias("rank")]
    if weight:
        added.append((F.col("_sum") + F.coalesce("_aw", F.lit(0))).alias("before"))
    return out.select(*df.columns, *added)


def rotated(df: DataFrame, key: str, name: str = "other") -> DataFrame:
    """(key, name): each row with the key of the next one in order, the last with that of the first."""
    rows = stored(ranked(df.select(key), [], [key]), "ranked")
    total = rows.select(F.count("*")).scalar()
    following = rows.select(F.col(key).alias(name), (F.when(F.col("rank") == 0, total).otherwise(F.col("rank")) - 1).alias("rank"))
    return rows.join(following, "rank").select(key, name)


def at_share(df: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """(by, n, element): of each group's sorted values that of index min(int(share n), n - 1)."""
    rows = df.filter(F.col(value).isNotNull()).select(by, value)
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n"))
    placed = ranked(rows, [by], [value])
    return placed.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).filter(F.col("rank") == F.least(F.floor(F.col("n") * share), F.col("n") - 1)).select(by, "n", F.col(value).alias("element"))
