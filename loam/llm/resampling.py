"""Operator 13, target-distribution importance resampling over hashed runs of words.

One scan of a text yields the buckets of all its features: the running zlib states of the last n starts are kept in a ring; each
word opens a start of its own and extends the others by a space and itself, so that no feature's text is ever built. A text is
cut into words a piece at a time, and the ring goes on from piece to piece, so that memory does not grow with the text.

The first scan counts buckets of corpus and target, a row a task and bucket, added up by bucket: the driver sees the two
histograms of ``BUCKETS`` numbers. The second weighs each text by the gains of its features. Draws are the highest scores
(Gumbel top-k), found by a range sort and partition counts, as their number grows with the corpus.

Defined cases: a null or empty text has no features and weight 0; it is never drawn, as are all texts below the least number of words;
a null id counts as the empty text in the draw's hash and comes after all ids in a tie; repeated rows are rows of their own with
equal scores, in any order among themselves; a benchmark without features has T = 0 and still gives weights; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import lean, materialise, ranked
from loam.llm.words import word_lists

BUCKETS = 10_000
ORDER = 3
LEAST_WORDS = 20
PERCENT = 5


def bucket_runs(text: bytes | None, order: int = ORDER, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of all features that end in them) for one piece of the text after another."""
    ring: list[list[int]] = [[] for _ in range(order)]  # ring[k]: the state over the last k + 1 words so far
    for some in word_lists(text):
        if not some:
            continue
        spaced = [b" " + w for w in some]
        found = [list(map(crc32, some))]
        for k in range(1, order):
            # The state over k words that ends a word earlier, extended by a space and this word.
            before = ring[k - 1] + found[k - 1]
            found.append(list(map(crc32, spaced[len(spaced) - len(before) + 1 :], before)))
        ring = [f[-1:] for f in found]
        yield len(some), np.concatenate([np.array(f, np.int64) for f in found]) % buckets


def histogram(texts: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, found in bucket_runs(text, order, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    parts = texts.select(F.col(f"`{text_col}`").cast("binary")).mapInArrow(lean(run), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    m = float(len(source))
    s_all, t_all = float(source.sum()) + m, float(target.sum()) + m
    return np.array([math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def luck(doc_id: int | None, seed: int = 42) -> int:
    """A Gumbel variate, times 1000 and floored, that the id decides."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, seed: int = 42) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight and score."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1).to_pylist()):
                n_words = n_features = weight = 0
                for n, found in bucket_runs(text, order, len(gains)):
                    n_words, n_features, weight = n_words + n, n_features + len(found), weight + int(gains[found].sum())
                rows.append((n_words, n_features, weight, weight + luck(i, seed)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows)]], names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary"))
    return narrow.mapInArrow(lean(run), f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``weigh`` gives it, with its rank (from 1) if it is among the drawn ``percent`` of the eligible rows, else null."""
    gains = gains_of(histogram(docs, text_col), histogram(target, text_col))
    # Rows equal in all are told apart by a stored number, so that a range may end among them.
    scored = weigh(docs, gains, id_col, text_col).withColumn("nth", F.monotonically_increasing_id())
    scored = materialise(scored.select("*", (-F.col("score")).alias("down"), F.isnull("doc_id").alias("nameless")), "scored")
    eligible = scored.filter(F.col("n_words") >= least_words)
    draws = percent * eligible.count() // 100
    placed = ranked(eligible, [], ["down", "nameless", "doc_id", "weight", "n_features", "nth"])
    rank = F.when(F.col("rank") < draws, F.col("rank") + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, rank.alias("rank")).unionByName(rest)


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
