"""The journal of a search for better sketches: an append-only table of events, folded to what holds now.

An event is (run, event, kind, candidate, score): its number in its run, one of ``batch``, ``evaluate`` and ``apply``, and what was measured. An event
that is written again, by a replayed step or a second writer, has the run and number of the first and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.store import read_table

SCHEMA = "run long, event long, kind string, candidate string, score double"


def append(events: DataFrame, path: str) -> None:
    events.select(*[f.split(" ")[0] for f in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """Each event once; if copies differ, the smallest stands."""
    rows = read_table(spark, path, SCHEMA)
    kept = F.min(F.struct("kind", "candidate", "score")).alias("x")
    return rows.groupBy("run", "event").agg(kept).select("run", "event", "x.*")


def current(spark: SparkSession, path: str) -> DataFrame:
    """(run, n_events, applied, tried, best, best_score): the candidate applied last, how many were evaluated, and the best of them, of equal
    ones the first, as only a better one would replace it."""
    at = lambda kind: F.when(F.col("kind") == kind, F.col("candidate"))
    order = lambda kind, x: F.when(F.col("kind") == kind, x)
    return events(spark, path).groupBy("run").agg(
        F.count("*").alias("n_events"), F.max_by(at("apply"), order("apply", F.col("event"))).alias("applied"), F.count_distinct(at("evaluate")).alias("tried"),
        F.max_by(at("evaluate"), order("evaluate", F.struct("score", -F.col("event")))).alias("best"), F.max(order("evaluate", F.col("score"))).alias("best_score"),
    )
