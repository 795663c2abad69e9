"""Operator 10, n-gram Jaccard join: MinHash banding, candidates verified on full sets of word n-grams.

A text's set holds its n-grams of ``n`` lower-cased words (runs of letters, digits and underscores); a text of fewer words is one n-gram.
Texts with equal sets are copies: one node stands for them, and copies are never expanded into pairs. Rows
and bands are chosen so that a pair at the threshold shares a band with probability ``RECALL``. Nodes are
shuffled on band hashes:

* a bucket of up to ``SMALL`` nodes gives its pairs of ids, made distinct over all bands; the texts of both
  ends are then joined on, a text of more than ``HEAVY`` pairs salted, and the full sets compared;
* a larger bucket gives no pairs. Large buckets that share nodes form a hot group; its nodes are dealt into blocks of about
  ``BLOCK`` nodes or ``BLOCK_CHARS`` characters, whichever is less; each pair of blocks is one unit of work that compares full sets by matrix products
  and returns counts of links per node and a spanning forest, rows in proportion to its nodes. Every node of a hot group
  is thus compared with every other one once, on many tasks.

Links found give each document its class (connected components; the id is the class's smallest doc_id) and its
number of linked documents, copies counted.

Defined cases: a null text counts as empty; ``class_id`` is a doc_id, so that classes with a null or shared id can have the same one, while their
``root`` tells them apart; texts without words are linked to equal texts only; repeated rows are
copies of each other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import forget, lean, materialise, small
from loam.llm.components import components

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 200
SMALL, BLOCK, BLOCK_CHARS, HEAVY = 16, 512, 1 << 21, 64
_WORD = re.compile(r"\w+").findall


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest false candidates, that reach the recall with ``most`` hashes."""
    best = (max(1, most), 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class _Hashes(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hash_of = _Hashes()
forget.append(_hash_of.clear)


def ngram_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = _WORD((text or "").lower())
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def set_key(grams: np.ndarray, text: str | None) -> bytes:
    raw = b"n" + grams.tobytes() if len(grams) else b"t" + (text or "").encode("utf-8", "surrogatepass")
    return hashlib.blake2b(raw, digest_size=16).digest()


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    if not len(grams):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(10)
    mult = _multipliers.setdefault((bands, rows), rng.integers(0, 1 << 62, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1))
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for a in range(0, len(grams), 256):
        g = grams[a : a + 256, None] * mult[None]
        np.minimum(least, g.min(0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for col in least.reshape(bands, rows).T:
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + col
    return (out ^ (out >> np.uint64(33))).view(np.int64)


_multipliers: dict = {}


def linked(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def sketch(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, key of the set, band hashes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, hashes = [], []
            for text in batch.column(2).to_pylist():
                grams = ngram_set(text, n)
                keys.append(set_key(grams, text))
                hashes.append(band_hashes(grams, bands, rows))
            ends = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "text_hash", "key", "bands"],
            )

    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return narrow.mapInArrow(lean(run), f"doc_id {kind}, text_hash long, key binary, bands array<long>")


def _compare_blocks(n: int, threshold: float):
    def run(key, pdf):
        import pandas as pd

        _, lo, hi = key
        sets = [ngram_set(t, n) for t in pdf["text"]]
        sizes = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(pdf["blk"] == lo), np.flatnonzero(pdf["blk"] == hi)
        vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        # Grams that only one text has are in no intersection.
        shared = np.bincount(code, minlength=len(vocabulary)) > 1
        place = np.cumsum(shared) - 1
        owner, code = owner[shared[code]], place[code[shared[code]]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, int(shared.sum()), 4096):
            i, j = np.searchsorted(code, [a, a + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[owner[i:j], code[i:j] - a] = 1
            both += m[left] @ m[right].T
        near = both >= threshold * (sizes[left][:, None] + sizes[right][None] - both) - 1e-6
        if lo == hi:
            np.fill_diagonal(near, False)
        copies, keys = pdf["n_copies"].to_numpy(), pdf["key"].tolist()
        docs, texts = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        docs[left] += near @ copies[right]
        texts[left] += near.sum(1)
        if lo != hi:
            docs[right] += near.T @ copies[left]
            texts[right] += near.sum(0)
        root = np.arange(len(sets))
        while True:
            least = root.copy()
            for x, y, m in ((left, right, near), (right, left, near.T)):
                least[x] = np.minimum(least[x], np.where(m, root[y][None], len(sets)).min(1, initial=len(sets)))
            least = least[least]
            if (least == root).all():
                break
            root = least
        found = np.flatnonzero(texts)
        return pd.DataFrame({"key": [keys[i] for i in found], "near": [keys[root[i]] for i in found], "docs": docs[found], "texts": texts[found]})

    return run


def _hot_links(hot: DataFrame, nodes: DataFrame, texts_of, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, grp) of the hot nodes; (key, near, docs, texts) per pair of blocks."""
    star = materialise(hot.groupBy("h").agg(F.min("key").alias("v")), "stars")
    roots = components(hot.join(small(star), "h").select(F.col("key").alias("u"), "v"))
    members = materialise(roots.select(F.col("node").alias("key"), F.col("root").alias("grp")), "hot")
    rows = texts_of(members.select("key")).join(members, "key")
    need = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS))
    blocks = materialise(rows.groupBy("grp").agg(F.least(need, F.count("*")).cast("int").alias("nb")), "blocks")
    rows = rows.join(small(blocks), "grp")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("key", F.lit(BLOCK)), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("grp", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "key", "text", "n_copies")
    found = rows.groupBy("grp", "lo", "hi").applyInPandas(_compare_blocks(n, threshold), "key binary, near binary, docs long, texts long")
    return members, materialise(found, "hot_links")


def _verify(n: int, threshold: float):
    def run(batches):
        import pyarrow as pa

        held = [(None, None), (None, None)]  # rows come sorted by one end or the other
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(len(a)):
                for side, key, text in ((0, a[i], ta[i]), (1, b[i], tb[i])):
                    if held[side][0] != key:
                        held[side] = key, ngram_set(text, n)
                keep.append(linked(held[0][1], held[1][1], threshold))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(4), kept.column(5)], names=["a", "b", "na", "nb"])

    return run


def jaccard_classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, text_hash, class_id, root (the class's key, which no other class has), n_links (other documents linked, copies included), n_text_links (other sets), n_copies."""
    bands, rows = band_shape(threshold, recall)
    sketched = materialise(sketch(docs, n, bands, rows, id_col, text_col), "sketch")
    nodes = sketched.groupBy("key").agg(F.count("*").alias("n_copies"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.any_value("bands").alias("bands"))
    nodes = materialise(nodes.select("key", "n_copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "bands"), "nodes")

    band_rows = nodes.select("key", F.explode("bands").alias("h"))
    filled = band_rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = materialise(band_rows.join(filled, "h"), "buckets")

    whole = docs.select(F.col(f"`{id_col}`").alias("rep_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    whole = whole.withColumn("rep_hash", F.xxhash64("text"))

    def texts_of(keys: DataFrame) -> DataFrame:
        """key, n_copies, text of the nodes named."""
        wanted = materialise(keys.join(nodes.drop("bands"), "key"), "wanted")
        got = whole.alias("w").join(small(wanted).alias("n"), F.expr("w.rep_id <=> n.rep_id and w.rep_hash = n.rep_hash"))
        # Repeated rows of one document match alike; one of them is enough.
        got = got.select("n.key", "n.n_copies", "w.text", F.xxhash64("w.text").alias("rep_hash"))
        repeated = wanted.filter("n_copies > 1").limit(1).count() > 0
        return materialise(got.groupBy("key").agg(F.min("n_copies").alias("n_copies"), F.min("text").alias("text")) if repeated else got.drop("rep_hash"), "texts")

    members, hot_links = _hot_links(buckets.filter(F.col("n") > SMALL).select("h", "key"), nodes, texts_of, n, threshold)

    few = buckets.filter(F.col("n") <= SMALL).select("h", "key").join(members, "key", "left")
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.h = y.h and x.key < y.key and not coalesce(x.grp = y.grp, false)"))
    pairs = materialise(pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct(), "pairs")
    either = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    either = materialise(either.select("key", F.ceil(F.col("n") / HEAVY).cast("int").alias("parts")), "ends")
    ends = texts_of(either.select("key")).join(small(either), "key")
    ends = materialise(ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "salted")
    heavy = small(either.filter("parts > 1"))
    of = lambda x, other: F.pmod(F.xxhash64(other), F.coalesce(F.col(f"p{x}"), F.lit(1))).cast("int").alias(f"s{x}")
    salted = pairs.join(heavy.select(F.col("key").alias("a"), F.col("parts").alias("pa")), "a", "left").join(heavy.select(F.col("key").alias("b"), F.col("parts").alias("pb")), "b", "left")
    salted = salted.select("a", "b", of("a", "b"), of("b", "a"))
    side = lambda x: ends.select(F.col("key").alias(x), F.col("salt").alias(f"s{x}"), F.col("text").alias(f"t{x}"), F.col("n_copies").alias(f"n{x}"))
    sides = salted.join(side("a"), ["a", "sa"]).join(side("b"), ["b", "sb"]).select("a", "b", "ta", "tb", "na", "nb")
    links = materialise(sides.mapInArrow(lean(_verify(n, threshold)), "a binary, b binary, na long, nb long"), "links")

    degree = hot_links.select("key", "docs", "texts").union(links.select("a", "nb", F.lit(1))).union(links.select("b", "na", F.lit(1)))
    degree = degree.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    roots = components(hot_links.select(F.col("key").alias("u"), F.col("near").alias("v")).union(links.select("a", "b")))
    named = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = materialise(named.join(degree, "key", "left").select("key", "root", "rep_id", "n_copies", "docs", "texts"), "named")
    # Only classes of more than one node need a look at the others.
    joint = named.filter("docs is not null").groupBy("root").agg(F.min("rep_id").alias("class_id"))
    named = named.join(joint, "root", "left").select("key", "root", "rep_id", "class_id", "n_copies", "docs", "texts")
    return sketched.select("doc_id", "text_hash", "key").join(named, "key").select(
        "doc_id",
        "text_hash",
        F.coalesce("class_id", "rep_id").alias("class_id"),
        "root",
        (F.coalesce("docs", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        "n_copies",
    )


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "root")
