"""Operator 1, mixing sources by temperature, realised as block permutations within token budgets.

A source's weight is its share of all tokens (words and one end per document) raised to an exponent between 0 and 1 and normalised.
The exponent is found by bisection: the largest whose weights have the target entropy (a fraction of the
even mix's), raised where needed so that no source is repeated more often than the limit. A pass over the sources' token sums tries
all midpoints of the next halvings at once and sends two sums for each to the driver, whatever the number of sources. The total budget defaults to the
smallest at which every document is drawn once, so that nothing is lost: the source most
under-weighted is seen once, others up to the limit. A source's budget is filled with seeded permutations of its documents, one per
epoch, the last one cut where the budget ends. Budgets are spread evenly over blocks of about
``block_tokens``, so that each block holds all sources at their weights, and each block is permuted again.

Defined cases: a null source is the source ''; a null text counts as empty (one token); repeated rows (same id, same text) are
one document; ties in the permutation fall to the id and the text's hash; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import materialise, ranked, small

TARGET_ENTROPY, MAX_REPEATS, BLOCK_TOKENS, SEED = 0.9, 2.0, 1 << 18, 1


def weights_of(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [math.exp(exponent * math.log(t / total)) if t else 0.0 for t in tokens]
    scale = sum(raised)
    return [r / scale for r in raised] if scale else raised


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def most_repeats(tokens: list[int], weights: list[float]) -> float:
    """Epochs of the most repeated source where the least repeated one is seen once."""
    rates = [w / t for t, w in zip(tokens, weights) if t]
    return max(rates) / min(rates) if rates else 1.0


#: Halvings of the exponent's range that one pass over the sources settles: it tries all 2^LOOK - 1 midpoints at once.
LOOK, PASSES = 5, 7


def bisected(goal_met, looks: int = LOOK, passes: int = PASSES) -> float:
    """The largest exponent in [0, 1] at which the goal, met at and below some point, is met, to 2^-(looks * passes).

    ``goal_met`` takes a list of exponents and returns a truth value for each; it is asked once a pass.
    """
    if goal_met([1.0])[0]:
        return 1.0
    low, width = 0.0, 1.0
    for _ in range(passes):
        width /= 1 << looks
        points = [low + width * i for i in range(1, 1 << looks)]
        met = goal_met(points)
        low = max([low, *(p for p, yes in zip(points, met) if yes)])
    return low


def least_exponent(most: int, least: int, max_repeats: float) -> float:
    """Where the smallest source is repeated ``max_repeats`` times as often as the largest: repeats are (most / least)^(1 - exponent)."""
    return max(0.0, 1.0 - math.log(max_repeats) / math.log(most / least)) if most > least else 0.0


def find_exponent(tokens: list[int], target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for sources whose tokens are at hand; ``mix`` takes the same steps over a table of them."""
    some = [t for t in tokens if t]
    if len(some) < 2:
        return 1.0
    goal = target_entropy * math.log(len(some))
    flat = bisected(lambda exponents: [entropy(weights_of(some, a)) >= goal for a in exponents])
    return max(flat, least_exponent(max(some), min(some), max_repeats))


def _power_sums(sources: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of s^a, sum of s^a log s) over the sources' shares s, for each exponent a: one row to the driver."""
    share = F.log(F.col("n") / float(total))
    sums = [f(F.exp(a * share) * x) for a in exponents for f, x in ((F.sum, F.lit(1.0)), (F.sum, share))]
    row = sources.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]


def mix(
    docs: DataFrame,
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row per draw: doc_id, text_hash, source, tokens, weight, exponent, epoch, block, place (gapless in its block)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"), (F.regexp_count(text, F.lit("\\S+")) + 1).cast("long").alias("tokens")
    )
    rows = rows.groupBy("doc_id", "text_hash").agg(F.min("source").alias("source"), F.min("tokens").alias("tokens"))
    rows = materialise(rows, "documents")
    sources = materialise(rows.groupBy("source").agg(F.sum("tokens").alias("n")), "sources")
    some = sources.agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    k, all_tokens = some["k"], int(some["total"] or 0)
    exponent = 1.0
    if k > 1:

        def spread_enough(exponents):
            # With weights s^a / Z the entropy is log Z - a / Z * sum of s^a log s; the rounding keeps sums taken in another order from deciding.
            return [round(math.log(z) - a / z * zs - target_entropy * math.log(k), 9) >= 0 for a, (z, zs) in zip(exponents, _power_sums(sources, all_tokens, exponents))]

        exponent = round(max(bisected(spread_enough), least_exponent(some["most"], some["least"], max_repeats)), 9)
    scale = round(_power_sums(sources, all_tokens, [exponent])[0][0], 12) if k else 1.0
    # The largest source is the most under-weighted; seen once, it sets the least budget at which every document is drawn.
    total = budget if budget is not None else scale * all_tokens * ((some["most"] or 0) / max(all_tokens, 1)) ** (1 - exponent)
    blocks = max(1, math.ceil(total / block_tokens))
    plan = sources.withColumn("weight", F.round(F.exp(exponent * F.log(F.col("n") / float(max(all_tokens, 1)))) / scale, 15)).withColumn("own", F.col("weight") * total)
    plan = plan.withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.col("own") / F.col("n") - 1e-9)).cast("int"))
    drawn = rows.join(small(plan), "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    drawn = drawn.withColumn("luck", F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash"))
    drawn = ranked(drawn, ["source", "epoch"], ["luck", "doc_id", "text_hash"], weight="tokens")
    at = F.col("epoch") * F.col("n") + F.col("before")
    drawn = drawn.filter(at < F.col("own") - 1e-6).withColumn("block", F.floor(at / F.col("own") * blocks).cast("long"))
    inside = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "luck"), "doc_id", "text_hash", "epoch")
    return drawn.withColumn("place", F.row_number().over(inside) - 1).select(
        "doc_id", "text_hash", "source", "tokens", "weight", F.lit(exponent).alias("exponent"), "epoch", "block", "place"
    )


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
