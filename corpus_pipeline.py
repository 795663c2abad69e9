"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again.

In all stages ids need not be unique nor known; a row is told by its id and its whole text, of which null counts as empty. Columns
other than those of documents are ignored, whatever their names, and an empty table gives no rows. No stage cuts a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import jaccard, language, mixing, packing, quality
from loam.llm.common import materialise
from loam.ship import shipped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has less than half of the odds is not prose of any of them.
LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (und; so null and empty texts) and those whose best language has a score below LEAST_LANGUAGE_SCORE.

    Repeated rows are all kept or all dropped; without any labelled language every text is und.
    """
    found = language.identify(docs, language.learn(docs), COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are likelier of quality 0 than 1.

    A score of exactly one half stays; repeated rows are all kept or all dropped; without usable labels all have one score and stay or go together.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.assess(docs, model, COLUMNS).filter("score >= 0.5").select(COLUMNS)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def _same(x: str, y: str):
    return F.expr(f"{x}.doc_id <=> {y}.doc_id and {x}.text_hash = {y}.text_hash")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, that with the smallest doc_id (a null id only if no other is there), once.

    Classes are told apart by their own key, so that different texts stay although they share an id or have none; of two texts of
    one class and id the smaller hash stays; rows that repeat whole become one.
    """
    rows = jaccard.jaccard_classes(docs).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash", "n")).alias("x"))
    kept = materialise(first.select("x.doc_id", "x.text_hash", "x.n"), "kept")
    out = _hashed(docs).alias("d").join(kept.alias("k"), _same("d", "k"), "left_semi")
    if kept.filter("n > 1").limit(1).count():  # rows that repeat, of which each task keeps one before they meet
        out = out.dropDuplicates(["doc_id", "text_hash"])
    return out.select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, in the order of the mix: blocks one after another, each in its permutation.

    Rows that repeat whole are one document, drawn as often as one. Whole blocks go to a task, which writes them in order of place.
    Stages hand on the columns of documents only, so that the next one plans its sequences over all blocks: it keeps the
    mix's shares, not its order.
    """
    draws = materialise(mixing.mix(docs).select("doc_id", "text_hash", "block", "place"), "draws")
    whole = _hashed(docs)
    n = whole.agg(F.count("*"), F.count_distinct(F.struct("doc_id", "text_hash"))).first()
    if n[0] > n[1]:
        whole = whole.dropDuplicates(["doc_id", "text_hash"])
    drawn = whole.alias("d").join(draws.alias("w"), _same("d", "w")).select(*[f"d.{c}" for c in COLUMNS], "w.block", "w.place")
    return drawn.repartition("block").sortWithinPartitions("block", "place").select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each row and their places in sequences of 1024 tokens, as op4 returns them.

    A null text is its end id; rows that repeat (drawn more than once) are packed once per row; nothing is left out.
    """
    return packing.digest(packing.pack(docs, packing.tokenizer_path()))


STAGES = [
    ("language_id", shipped(language_stage)),
    ("quality", shipped(quality_stage)),
    ("near_duplicates", shipped(near_duplicate_stage)),
    ("mixing", shipped(mixing_stage)),
    ("packing", shipped(packing_stage)),
]

#: Learned classifiers and MinHash have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
