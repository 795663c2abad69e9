"""Bounds and brute force of earlier operators: hot ids in what is learned, sequences that survive coalescing, files that keep their tasks."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loam.llm import common, language, packing, quality
from test_llm import awkward, prose


HOT = next(i for i in range(3, 99) if zlib.crc32(str(i).encode()) % 3 != 1)


def hot(spark, n=6000):
    """Half of the rows have one id; of those a third have one text."""
    own = F.concat(F.lit("the words of row "), F.col("id"), F.lit(" and others"))
    text = F.when(F.col("id") < n // 6, F.lit("one text for them all")).otherwise(own)
    rows = spark.range(n).select(F.when(F.col("id") < n // 2, HOT).otherwise(F.col("id")).alias("doc_id"), text.alias("text"), F.when(F.col("id") % 20 == 19, "xx").otherwise("en").alias("lang"))
    return rows.repartition(8)


def test_languages_learned_from_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda x, y, names, steps=200: seen.append((len(x), dict(zip(names, np.bincount(y).tolist())))))
    docs = hot(spark)
    language.learn(docs, per_language=50)
    language.learn(docs.filter(f"doc_id = {HOT}"), per_language=50)
    language.learn(docs.repartition(3), per_language=50)
    language.learn(docs, per_language=50, languages=1)
    language.learn(docs.withColumn("lang", F.concat("lang", F.col("doc_id") % 100)), per_language=50, most=200, languages=40)
    assert seen[0] == (100, {"en": 50, "xx": 50}) and seen[2] == seen[0] and seen[3] == (50, {"en": 50})
    assert seen[1][0] == 100 and set(seen[1][1]) == {"en", "xx"}
    assert len(seen[4][1]) == 40 and seen[4][0] <= 200 and min(seen[4][1].values()) >= 1


def test_quality_learned_from_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.append(len(x)))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    for only in ("true", f"doc_id = {HOT}"):
        quality.learn(hot(spark).filter(only), labels.filter(only), most=100)
    assert 0 < seen[0] <= 100 and 0 < seen[1] <= 100


def test_nearest_codeword_by_hand():
    rng = np.random.default_rng(3)
    code = language.codewords(5)
    model = language.Model(list("abcde"), code, rng.normal(size=(8, code.shape[1])), rng.normal(size=code.shape[1]), rng.uniform(0.1, 1, code.shape))
    x = rng.normal(size=(40, 8))
    best, score, lead = model.predict(x)
    for i in range(len(x)):
        margins = [sum(x[i, k] * model.weights[k, b] for k in range(8)) + model.bias[b] for b in range(code.shape[1])]
        far = [sum(model.trust[c, b] * math.log(1 + math.exp(-margins[b] * code[c, b])) for b in range(code.shape[1])) for c in range(5)]
        odds = [math.exp(-2 * (f - min(far)) * math.sqrt(code.shape[1])) for f in far]
        first, second = sorted(odds, reverse=True)[:2]
        assert best[i] == far.index(min(far)) and abs(score[i] - first / sum(odds)) < 1e-5 and abs(lead[i] - (first - second) / sum(odds)) < 1e-5


def test_trees_walked_row_by_row():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6))
    forest = quality.grow(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float), trees=15)
    got = forest.score(x)
    for i in range(0, 600, 7):
        raw = forest.base
        for t in range(15):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if x[i, forest.feature[t, node]] > forest.threshold[t, node] else 1)
            raw += forest.value[t, node - (2**quality.DEPTH - 1)]
        assert abs(got[i] - 1 / (1 + math.exp(-raw))) < 1e-12


def whole(rows):
    """Sequences without gaps or overlaps, of at most 1024 tokens."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 1024
    return len(by)


def test_sequences_survive_coalescing_and_rereading(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(100 + i, prose(i, 30 + 37 * i % 900), "en", "a", 0, 9, "k", 7) for i in range(300)], awkward(spark).schema)).repartition(9)
    packed = packing.pack(docs, packing.tokenizer_path())
    n = whole(packed.collect())
    assert n == whole(packed.coalesce(2).collect()) == whole(packed.coalesce(1).collect()) == whole(common.materialise(packed).collect())
    other = packing.pack(docs.limit(50), packing.tokenizer_path())
    assert other.count()


def test_materialise_keeps_the_tasks_of_a_large_table(spark, monkeypatch):
    wide = spark.range(0, 4000, 1, 200).select("id", F.lit("x" * 100).alias("t"))
    few = common.FILES_A_CORE * spark.sparkContext.defaultParallelism
    assert len(common.materialise(wide).inputFiles()) == few
    monkeypatch.setattr(common, "FILE_BYTES", 1000)
    assert len(common.materialise(wide).inputFiles()) > few
    assert common.materialise(wide).count() == 4000


def test_packing_remembers_only_pieces_that_come_again(monkeypatch):
    enc = packing.Encoder(packing.tokenizer_path())
    rng, seen = random.Random(3), Counter()
    batches = [["the same words " + " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(200)) for _ in range(4)] for _ in range(5)]
    for texts in batches:
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(ids, np.uint32).tolist() for ids in enc.encode(texts)] == want
        seen.update({p for t in texts for p in enc.pieces(t)})
    assert {"the", " same", " words"} <= set(enc.known)
    assert len(seen) > 3900 and len(enc.known) < 40  # few words that came once share a hash with an earlier one
    monkeypatch.setattr(packing, "CACHE", len(enc.known) + 5)
    for _ in range(3):
        assert [np.frombuffer(ids, np.uint32).tolist() for ids in enc.encode(batches[0])] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in batches[0]]
    assert len(enc.known) == packing.CACHE


def test_batches_end_at_their_bytes(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "b"])

    found = spark.range(0, 1900, 1, 1).select(F.repeat(F.lit("x"), 5000)).mapInArrow(sizes, "n long, b long").collect()
    assert sum(r["n"] for r in found) == 1900 and max(r["b"] for r in found) < 3 << 20
