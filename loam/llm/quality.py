"""Operator 8, quality: histogram gradient-boosted trees over document statistics.

Statistics of each whole text (lengths, shares of character kinds, repetition of words and lines) are cut
into quantile bins; trees of fixed depth are grown on gradient histograms of the logistic loss. The fitted
ensemble is three arrays (feature, threshold, leaf value), through which numpy moves a batch of rows
level by level in all trees at once.

The trees are fitted on a bounded sample of labelled rows (``most``, chosen by a hash of the id), scores cover every text.

Defined cases: a null text counts as empty; empty texts get the score their statistics give; labels that are null, not 0 or
1, or contradict each other for a document are not learned from; with fewer than two classes all scores are
the prior (0.5 without labels); repeated rows give equal rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import doc_fold, lean, small

MOST = 20_000
TREES, DEPTH, BINS, RATE = 120, 4, 64, 0.15
NAMES = [
    "log_bytes", "log_words", "mean_word", "long_words", "upper", "digit", "space", "newline", "high", "stars", "bangs", "bars", "stops", "commas",
    "other_punct", "distinct_words", "top_word", "top_three", "distinct_lines", "mean_line", "short_lines", "adjacent_repeats", "letters_only", "all_caps", "entropy",
]


def _masks() -> np.ndarray:
    m = np.zeros((10, 256))
    for row, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", bytes(range(128, 256)), b"*&%$#@^~=<>_\\{}[]", b"!?", b"|", b".", b",")):
        m[row, list(chars)] = 1
    return m


_MASKS = _masks()
_PUNCT = np.array([chr(i) in "\"'()-/:;`+" for i in range(256)], float)


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return np.zeros(len(NAMES), np.float32)
    hist = np.zeros(256)
    for a in range(0, n, 1 << 20):
        hist += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 20, n - a), a), minlength=256)
    share = _MASKS @ hist / n
    p = hist[hist > 0] / n
    words = raw.split()
    w = max(1, len(words))
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)] + [0, 0, 0]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()] or [b""]
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    again = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    alpha = sum(map(bytes.isalpha, words))
    caps = sum(map(bytes.isupper, words))
    return np.array(
        [np.log1p(n), np.log1p(len(words)), lengths.mean(), (lengths > 12).mean(), *share[:10], _PUNCT @ hist / n, len(counts) / w, top[0] / w, sum(top[:3]) / w,
         len(set(lines)) / len(lines), line_lengths.mean(), (line_lengths < 30).mean(), again / w, alpha / w, caps / w, -(p * np.log2(p)).sum()],
        np.float32,
    )


class Forest:
    """Complete trees in arrays: node i's children are 2i+1 and 2i+2; a row goes right if above the threshold."""

    def __init__(self, feature, threshold, value, base):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if len(self.feature):
            trees, rows, node = np.arange(len(self.feature))[None], np.arange(len(x))[:, None], np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            raw += self.value[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    none = np.zeros((0, 2**DEPTH - 1), np.int64)
    if len(np.unique(y)) < 2:
        return Forest(none, none.astype(float), np.zeros((0, 2**DEPTH)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    d, inner = x.shape[1], 2**DEPTH - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**DEPTH))
    raw, offsets = np.full(len(y), base), np.arange(d) * BINS
    least = max(1.0, 0.002 * len(y) * prior * (1 - prior))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (d * BINS) + offsets[None] + bins).ravel()
            gs = np.bincount(cell, np.repeat(g, d), width * d * BINS).reshape(width, d, BINS).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, d), width * d * BINS).reshape(width, d, BINS).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[(hs < least) | (ht - hs < least)] = 0
            gain[:, :, -1] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        raw += value[t, leaf]
    return Forest(feature, threshold, value, base)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fits on at most ``most`` different labelled rows with a fold (crc32 of the id, modulo 3) other than 1."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(doc_fold(F.col("id")) % 3 != 1).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    n = known.count()
    luck = F.pmod(F.xxhash64(F.col("id"), F.lit("quality")), F.lit(1 << 24)) / float(1 << 24)
    known = known.filter(luck < min(1.0, most / max(1, n)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(small(known), "id")
    # An id may stand for any number of rows: of the different ones, a hash of id and text picks about ``most``, twice at first, as the count is an estimate.
    rows = rows.withColumn("row", F.xxhash64("id", F.coalesce("text", F.lit("")), F.lit("quality")))
    n_rows = rows.agg(F.approx_count_distinct("row")).first()[0]
    luck = F.pmod(F.col("row"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.filter(luck < min(1.0, 2.0 * most / max(1, n_rows))).withColumn("luck", luck).dropDuplicates(["row"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            blobs = [statistics(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(blobs, pa.binary()), batch.column(3)], names=["id", "y", "x", "luck"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = rows.select("id", "y", "text", "luck").mapInArrow(lean(run), f"id {kinds['id']}, y {kinds['y']}, x binary, luck double")
    got = found.orderBy("luck", "id", "x").limit(most).toPandas().sort_values(["id", "x"], kind="stable")
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(float) if len(got) else np.zeros((0, len(NAMES)))
    return grow(x, got["y"].to_numpy().astype(float))


def assess(docs: DataFrame, model: Forest, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, then score."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.stack([statistics(t) for t in batch.column(len(keep)).to_pylist()]).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.score(x))], names=[*keep, "score"])

    return docs.select(*keep, F.col(f"`{text_col}`").alias("_text")).mapInArrow(lean(run), schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = assess(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", (doc_fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    )
