"""Operator 2, approximate nearest neighbours by cross-polytope hashing.

A hash rotates unit vectors pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and
assigns each to the nearest signed axis. A table concatenates as many hashes as the number of vectors asks for: all but the
last use every axis, the last only as many as leave about ``FILL`` vectors to a bucket. A query probes, in each table, the
buckets whose axes lie nearest to it over all hashes together; candidates are the vectors in them, reranked
by exact Euclidean distance on the original vectors.

Vectors and queries meet in a shuffle on a bucket's first hashes (``route``), of which there are just enough that few
vectors share one; the hashes left choose among these vectors inside the unit of work. A route
with more than ``PART`` vectors or ``ASK_PART`` queries is split by salt on either side, so that copies of one vector, and
queries that all ask for it, spread over tasks. A unit compares in numpy and returns at most ``k`` rows per query; no pair table is made.
Queries that find fewer than ``k`` candidates are answered by an exact scan in blocks.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
part; components of any finite size do, a distance beyond the range of doubles being infinite; of rows with one vec_id the
smallest vector counts; equal distances go to the smaller vec_id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import materialise, small

TABLES, K, SEED = 12, 10, 3
#: A table's buckets hold about FILL vectors; those probed in it hold about BREADTH * n^GROWTH of n vectors.
FILL, BREADTH, GROWTH = 8, 7.0, 0.4
PART, ASK_PART = 8192, 2048
#: Combinations of near axes that a query weighs in a table, at least.
WEIGHED = 1 << 10
#: Queries that an exact scan takes at a time.
EXACT_BLOCK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    x, n, h = x.copy(), x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int = SEED, axes: int | None = None) -> np.ndarray:
    """Scores of the signed axes (all positive ones, then all negative ones) of unit rows; only the first ``axes`` / 2 of each sign if given."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    # The largest component first becomes 1, so that no norm overflows or vanishes.
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    y[:, : x.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    y = y[:, : (axes or 2 * width) // 2]
    return np.concatenate([y, -y], 1)


def hash_shape(n: int, dimensions: int) -> tuple[list[int], int, int]:
    """Axes of each hash of a table over n vectors, how many of the hashes make the route, and the buckets that a query probes."""
    full = 2 << max(0, dimensions - 1).bit_length()
    axes, goal = [full], n / FILL / full
    while goal > 1:
        axes.append(min(full, max(2, 1 << round(np.log2(goal)))))
        goal /= axes[-1]
    route = 1
    while route < len(axes) and n / np.prod(np.array(axes[:route], float)) > 4 * PART:
        route += 1
    buckets = np.prod(np.array(axes, float))
    return axes, route, int(min(buckets, max(4, round(BREADTH * n**GROWTH / max(n, 1) * buckets))))


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (double), one row for each id, only usable vectors, all of the most common length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and size(vector) > 0")
    fine = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x != 0)"
    rows = rows.filter(fine)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("vector") == (sizes[0]["d"] if sizes else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; rows whose squares leave its range are scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = x - query
        score = np.sqrt(np.einsum("ij,ij->i", d, d))
        odd = ~((score > 1e-140) & (score < 1e140))
        if odd.any():
            half = x[odd] / 2 - query / 2
            most = np.maximum(np.abs(half).max(1), np.finfo(float).tiny)
            half /= most[:, None]
            score[odd] = np.sqrt(np.einsum("ij,ij->i", half, half)) * most * 2
    return score


def _nearest(query: np.ndarray, qid: int, ids: np.ndarray, x: np.ndarray, k: int):
    """The k nearest of the rows by exact distance, but for the query's own; ties to the smaller id."""
    score, other = distances(x, query), ids != qid
    if not other.all():
        ids, score = ids[other], score[other]
    near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1]) if len(ids) > 4 * k else np.arange(len(ids))
    near = near[np.lexsort((ids[near], score[near]))][:k]
    return ids[near], score[near]


def _codes(scores: list[np.ndarray]) -> np.ndarray:
    """Each row's bucket: the nearest axes of its hashes as one number."""
    out = np.zeros(len(scores[0]), np.int64)
    for s in scores:
        out = out * s.shape[1] + s.argmax(1)
    return out


def _probed(scores: list[np.ndarray], row: int, probes: int) -> np.ndarray:
    """The buckets nearest to one row: least sum over the hashes of squared distance behind the nearest axis."""
    keep = max(2, int(np.ceil(max(WEIGHED, 4 * probes) ** (1 / len(scores)))))
    codes, cost = np.zeros(1, np.int64), np.zeros(1)
    for s in scores:
        behind = (s[row].max() - s[row]) ** 2
        best = np.argsort(behind, kind="stable")[:keep]
        codes, cost = (codes[:, None] * s.shape[1] + best).ravel(), (cost[:, None] + behind[best]).ravel()
    return codes[np.argsort(cost, kind="stable")[:probes]]


def _hashed(kind: str, axes: list[int], route: int, probes: int, tables: int):
    """vec_id, vector and for each table its routes, each with the rest of the bucket's code (index: one) or codes (query)."""
    inner = int(np.prod(axes[route:], dtype=np.int64)) if route < len(axes) else 1
    routes = int(np.prod(axes[:route], dtype=np.int64))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(n, -1)
            scores = [[rotated(x, t * 16 + level, axes=a) for level, a in enumerate(axes)] for t in range(tables)]
            if kind == "index":
                code = np.stack([t * routes * inner + _codes(s) for t, s in enumerate(scores)], 1)
                each, first, code = np.full(n, tables), np.arange(n * tables), code.ravel()
            else:
                rows = [np.concatenate([t * routes * inner + np.sort(_probed(s, i, probes)) for t, s in enumerate(scores)]) for i in range(n)]
                starts = [np.flatnonzero(np.diff(r // inner, prepend=-1)) for r in rows]
                each, size = np.array([len(s) for s in starts]), np.array([len(r) for r in rows])
                first, code = np.concatenate(starts) + np.repeat(np.cumsum(size) - size, each), np.concatenate(rows)
            codes = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(code % inner))
            found = pa.StructArray.from_arrays([pa.array(code[first] // inner), codes], names=["route", "codes"])
            ends = pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, found)], names=["vec_id", "vector", "found"])

    return run


def _compare(k: int):
    def run(_, pdf):
        import pandas as pd

        asks = pdf["asks"].to_numpy()
        rows, queries = pdf[~asks], pdf[asks]
        code = rows["codes"].str[0].to_numpy().astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        code, ids, x, found = code[order], rows["vec_id"].to_numpy()[order], _matrix(rows["vector"])[order], []
        for q, v, codes in zip(queries["vec_id"].to_numpy(), _matrix(queries["vector"]), queries["codes"]):
            codes = np.asarray(codes, np.int64)
            low, high = np.searchsorted(code, codes), np.searchsorted(code, codes, "right")
            size = high - low
            if not size.any():
                continue
            at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            near, score = _nearest(v, q, ids[at], x[at], k)
            found.append((np.full(len(near), q), near, score))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def search(
    rows: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score (distance): for each query its k nearest rows found, its own id left out."""
    base = materialise(clean_vectors(rows, id_col, vector_col), "vectors")
    asked = materialise(clean_vectors(queries, id_col, vector_col), "queries")
    first, there = base.select(F.size("vector").alias("d")).first(), base.count()
    axes, route, probes = hash_shape(there, first["d"] if first else 1)
    kind = "vec_id long, vector array<double>, found array<struct<route: long, codes: array<long>>>"
    index = materialise(base.mapInArrow(_hashed("index", axes, route, probes, tables), kind), "index")
    probe = materialise(asked.mapInArrow(_hashed("query", axes, route, probes, tables), kind), "probes")
    spread = lambda df: df.select("vec_id", "vector", F.explode("found").alias("f")).select("vec_id", "vector", "f.route", "f.codes")
    counted = lambda df, name: df.select(F.explode("found.route").alias("route")).groupBy("route").agg(F.count("*").alias(name))
    # Routes that hold vectors and are asked for: the units of work are their salts on both sides.
    units = counted(index, "n").join(counted(probe, "m"), "route")
    units = materialise(units.select("route", F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.ceil(F.col("m") / ASK_PART).cast("int").alias("ask_parts")), "units")
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    units = small(units)
    held = spread(index).join(units, "route").withColumn("part", salt("parts")).withColumn("ask_part", every("ask_parts")).withColumn("asks", F.lit(False))
    asking = spread(probe).join(units, "route").withColumn("ask_part", salt("ask_parts")).withColumn("part", every("parts")).withColumn("asks", F.lit(True))
    unit = ["route", "part", "ask_part"]
    columns = [*unit, "vec_id", "asks", "codes", "vector"]
    found = held.select(columns).union(asking.select(columns)).groupBy(*unit).applyInPandas(_compare(k), "query_id long, vec_id long, score double")
    found = materialise(_top(found, k), "found")

    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, there - 1))
    short = materialise(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti"), "short")
    if short.limit(1).count():
        found = found.join(small(short.select(F.col("vec_id").alias("query_id"))), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").union(exact_search(base, short, k))
    return found


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; only k rows a query and unit are ever kept, so that no window over candidates is needed."""
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = one.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")


def exact_search(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The exact answer: a scan of all vectors for each block of at most EXACT_BLOCK queries, which are broadcast."""
    blocks = max(1, -(-asked.count() // EXACT_BLOCK))
    results = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()
        qs, qx = part["vec_id"].to_numpy(), _matrix(part["vector"])

        def scan(batches, qs=qs, qx=qx):
            import pandas as pd

            for pdf in batches:
                ids, x = pdf["vec_id"].to_numpy(), _matrix(pdf["vector"])
                for q, v in zip(qs, qx) if len(ids) else ():
                    near, score = _nearest(v, q, ids, x, k)
                    yield pd.DataFrame({"query_id": q, "vec_id": near, "score": score})

        got = _top(base.mapInPandas(scan, "query_id long, vec_id long, score double"), k)
        results = got if results is None else results.union(got)
    return results


def op2_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0)).select("query_id", "rank", "vec_id", "score")
