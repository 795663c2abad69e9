"""Comparisons of any number of systems over the items that all of them answered."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import fold
from loam.operators import stats


def universe_rows(answers: DataFrame) -> tuple[DataFrame, list[str]]:
    """(item, right) of answers (item, system, ok): items that every system answered, with a 0 or 1 for each, in the order of the systems' names.

    Of several answers of one system to an item a right one counts.
    """
    once = answers.groupBy("item", "system").agg(F.max(F.col("ok").cast("int")).alias("ok"))
    systems = [r["system"] for r in once.select("system").distinct().orderBy("system").collect()]  # a row a system
    rows = once.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("system", "ok"))).alias("x")).filter(F.size("x") == len(systems))
    return rows.select("item", F.transform("x", lambda r: r["ok"]).alias("right")), systems


def pair_counts(rows: DataFrame, systems: list[str]) -> DataFrame:
    """(first, second, n, only_first, only_second) of all pairs of systems.

    A task adds up one matrix of how often two systems are right together, a product of its items' rows with themselves; the
    tasks' matrices are added. No item is joined with itself.
    """
    k = len(systems)

    def run(batches):
        import pyarrow as pa

        together, n = np.zeros((k, k), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(-1, k).astype(np.float64)
                together += np.rint(x.T @ x).astype(np.int64)
                n += len(x)
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(together.ravel()), pa.array(np.full(k * k, n))], names=["i", "j", "both", "n"])

    cells = rows.select("right").mapInArrow(run, "i long, j long, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n"))
    own = cells.filter("i = j").select("i", F.col("both").alias("right"))
    pairs = cells.filter("i < j").join(F.broadcast(own.withColumnRenamed("right", "ri")), "i").join(F.broadcast(own.select(F.col("i").alias("j"), F.col("right").alias("rj"))), "j")
    name = lambda at: F.element_at(F.array(*map(F.lit, systems)), (F.col(at) + 1).cast("int"))
    return pairs.select(name("i").alias("first"), name("j").alias("second"), "n", (F.col("ri") - F.col("both")).alias("only_first"), (F.col("rj") - F.col("both")).alias("only_second"))


def compared(answers: DataFrame) -> DataFrame:
    """All pairs of systems with their gain, McNemar's p and Holm's: (first, second, n, only_first, only_second, gain, p, holm)."""
    rows, systems = universe_rows(answers)
    pairs = pair_counts(rows, systems)
    pairs = pairs.withColumn("gain", F.round((F.col("only_first") - F.col("only_second")) / F.col("n"), 9)).withColumn("p", F.round(stats.mcnemar(F.col("only_first"), F.col("only_second")), 6))
    return stats.holm(pairs, "p", ["first", "second"]).withColumn("holm", F.round("holm", 9))


def _spread(rows: DataFrame, systems: list[str], *more: str) -> DataFrame:
    names = F.array(*map(F.lit, systems))
    return rows.select(*more, F.explode(F.arrays_zip(names.alias("system"), F.col("right").alias("ok"))).alias("x")).select(*more, "x.system", "x.ok")


def standings(answers: DataFrame) -> DataFrame:
    """(system, n, right, accuracy, low, high, place) over the items that all answered, the best first."""
    rows, systems = universe_rows(answers)
    t = _spread(rows, systems).groupBy("system").agg(F.count("*").alias("n"), F.sum("ok").alias("right"))
    low, high = stats.wilson(F.col("right"), F.col("n"))
    place = F.row_number().over(Window.orderBy(F.desc("right"), "system")).cast("long")  # a row a system
    return t.select("system", "n", "right", F.round(F.col("right") / F.col("n"), 9).alias("accuracy"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), place.alias("place"))


def standings_by(answers: DataFrame, classes: DataFrame, missing: str = "?") -> DataFrame:
    """(class, system, n, accuracy) of classes (item, class); items without a class are of class ``missing``."""
    rows, systems = universe_rows(answers)
    classed = rows.join(classes, "item", "left").withColumn("class", F.coalesce("class", F.lit(missing)))
    return _spread(classed, systems, "class").groupBy("class", "system").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 9).alias("accuracy"))


def model_table(cells: DataFrame, by: str, order: list[str], score: str) -> DataFrame:
    """Cells with ``gain``: their score above that of the first cell of the same ``by`` in this order."""
    first = cells.groupBy(F.col(by).alias("_by")).agg(F.min_by(score, F.struct(*order)).alias("_first"))
    return cells.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn("gain", F.round(F.col(score) - F.col("_first"), 9)).drop("_by", "_first")


# What tells a question that hangs on a picture, and a claim that asks for a number.
IMAGE = (
    r"(?iu)(^|[^\p{L}\p{N}_])(nest[ea]|na|no)\s+(figura|imagem|corte|traçado|gráfico|esquema)([^\p{L}\p{N}_]|$)"
    r"|(^|[^\p{L}\p{N}_])estrutura\s+\d|(^|[^\p{L}\p{N}_])figura\s+\d|legenda|(^|[^\p{L}\p{N}_])seta([^\p{L}\p{N}_]|$)"
)
NUMBER = r"\d+[,.]\d+|(^|[^\p{L}\p{N}_])\d+\s*(mg|ml|mcg|µg|g|kg|%|mmHg|mEq|horas?|minutos?)([^\p{L}\p{N}_]|$)"


def question_kind(stem: F.Column, claim: F.Column) -> F.Column:
    """image, if stem or claim hangs on a picture; else numeric, if the claim asks for a number; else prose."""
    return F.when(F.concat_ws(" ", stem, claim).rlike(IMAGE), "image").when(claim.rlike(NUMBER), "numeric").otherwise("prose")


def error_rates(answers: DataFrame) -> DataFrame:
    """(kind, n, error_rate) of answers (stem, claim, ok)."""
    return answers.groupBy(question_kind(F.col("stem"), F.col("claim")).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(1 - F.col("ok")), 9).alias("error_rate"))


def term_coverage(questions: DataFrame, contexts: DataFrame, least: int = 8) -> DataFrame:
    """(ok, n, coverage) of questions (qid, text, ok) with contexts (qid, context): the mean share of a question's folded words of at least
    ``least`` letters that its folded context holds, as whole or part of a word. Questions without such words don't count."""
    terms = F.array_distinct(F.filter(F.split(fold(F.col("text")), " "), lambda t: F.length(t) >= least))
    rows = questions.join(contexts, "qid", "left").select("ok", terms.alias("terms"), fold(F.coalesce("context", F.lit(""))).alias("context")).filter(F.size("terms") > 0)
    share = F.size(F.filter("terms", lambda t: F.contains(F.col("context"), t))) / F.size("terms")
    return rows.groupBy("ok").agg(F.count("*").alias("n"), F.round(F.avg(share), 9).alias("coverage"))


def by_class(items: DataFrame, same_setup: bool, shared_route: str = "book") -> DataFrame:
    """Per class of items (class, route, a, b): n, accuracies, discordants, McNemar's p, the commonest route (of equal ones the first by name) and
    ``noise``: two arms of one setup run the same on the shared route, so that a small p there is chance."""
    routes = items.groupBy("class", "route").agg(F.count("*").alias("r")).groupBy(F.col("class").alias("_class")).agg(F.min_by("route", F.struct(-F.col("r"), "route")).alias("route"))
    t = items.groupBy("class").agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 9).alias("accuracy_a"), F.round(F.avg("b"), 9).alias("accuracy_b"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"),
    )
    t = t.join(routes, F.col("class").eqNullSafe(F.col("_class"))).drop("_class").withColumn("p", F.round(stats.mcnemar(F.col("only_a"), F.col("only_b")), 6))
    return t.withColumn("noise", F.lit(same_setup) & (F.col("route") == shared_route) & (F.col("p") < 0.05))


def by_destination(routed: DataFrame, base: DataFrame) -> DataFrame:
    """(route, normative, n, accuracy, base, gain) of routed answers (item, route, normative, ok) against those of a base system (item, ok) to the same items."""
    both = routed.join(base.select("item", F.col("ok").alias("was")), "item", "left")
    t = both.groupBy("route", "normative").agg(F.count("*").alias("n"), F.avg("ok").alias("x"), F.avg("was").alias("y"))
    return t.select("route", "normative", "n", F.round("x", 9).alias("accuracy"), F.round("y", 9).alias("base"), F.round(F.col("x") - F.col("y"), 9).alias("gain"))
