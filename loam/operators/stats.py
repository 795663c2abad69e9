"""Paired statistics as Column arithmetic, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def wilson(right: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval, clamped to 0..1; null without items."""
    p = right / n
    centre, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    scale = 1 + Z * Z / n
    return F.greatest(F.lit(0.0), (centre - half) / scale), F.least(F.lit(1.0), (centre + half) / scale)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p: twice the lower binomial tail of the discordant pairs, summed in logarithms."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    step = lambda acc, i: F.struct(
        (acc["term"] + F.when(i > 0, F.log(n - i + 1) - F.log(i.cast("double"))).otherwise(0.0)).alias("term"),
        (acc["total"] + F.exp(acc["term"] + F.when(i > 0, F.log(n - i + 1) - F.log(i.cast("double"))).otherwise(0.0))).alias("total"),
    )
    tail = F.aggregate(F.sequence(F.lit(0), k), F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total")), step)["total"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(pairs: DataFrame, p: str, order: list[str]) -> DataFrame:
    """Step-down adjusted p over all rows: a few pairs of systems, so one window."""
    ranked = pairs.withColumn("_j", F.row_number().over(Window.orderBy(p, *order))).withColumn("_m", F.count("*").over(Window.partitionBy()))
    adjusted = F.max((F.col("_m") - F.col("_j") + 1) * F.col(p)).over(Window.orderBy(p, *order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("holm", F.least(F.lit(1.0), adjusted)).drop("_j", "_m")


def paired(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Per group: n, right in both, only a, only b, neither, gain of b, its standard error and McNemar's p."""
    counts = df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("both"),
        F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"),
        F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"),
        F.count_if((F.col(a) == 0) & (F.col(b) == 0)).alias("neither"),
    )
    d = F.col("only_b") - F.col("only_a")
    return counts.select(
        "*",
        F.round(d / F.col("n"), 9).alias("gain"),
        F.round(F.sqrt(F.col("only_a") + F.col("only_b") - d * d / F.col("n")) / F.col("n"), 9).alias("se"),
        F.round(mcnemar(F.col("only_a"), F.col("only_b")), 6).alias("p"),
    )


def stratified(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """``n`` rows: an equal whole quota of each class, in the given order, and the rest of the places filled from all that is left.

    No class gives more than n rows, so that only n rows a class go beyond its window, whose limit each task applies before the shuffle.
    """
    classes = max(1, df.select(by).distinct().count())
    each = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n)
    return each.withColumn("by_quota", F.col("_n") <= n // classes).orderBy(F.desc("by_quota"), *order).limit(n).drop("_n")
