"""Batch search: exact dense top-k, BM25, rank fusion, quotas, restricted search and literal citations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import content_tokens, fold, tokens

#: Queries are broadcast in blocks of at most so many.
QUERY_BLOCK = 4096


def ranked_top(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """Rank by rounded score, ties to the smaller id. row_number under a limit keeps k rows a task before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def dense_topk(base: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Exact inner products of queries (qid, vector[, tag]) with rows (id, vector[, tag]); tags, if any, must agree.

    One scan of the rows for each block of queries; a batch of rows is one matrix product, and a task keeps and
    gives at most k rows a query.
    """
    tagged = "tag" in queries.columns
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for b in range(n_blocks):
        part = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b).toPandas()
        if not len(part):
            continue
        q = np.stack(part["vector"].to_numpy()).astype(np.float64)
        qid, qtag = part["qid"].to_numpy(), part["tag"].to_numpy() if tagged else None

        def scan(batches, q=q, qid=qid, qtag=qtag):
            import pandas as pd

            held = None
            for pdf in batches:
                if not len(pdf):
                    continue
                score = np.round(q @ np.stack(pdf["vector"].to_numpy()).astype(np.float64).T, 6)
                ids = pdf["id"].to_numpy()
                if qtag is not None:
                    score[qtag[:, None] != pdf["tag"].to_numpy()[None]] = -np.inf
                if score.shape[1] > k:
                    near = (score >= np.partition(score, -k, axis=1)[:, -k, None]) & np.isfinite(score)
                else:
                    near = np.isfinite(score)
                at, row = np.nonzero(near)
                new = pd.DataFrame({"qid": qid[at], "id": ids[row], "score": score[at, row]})
                held = new if held is None else pd.concat([held, new])
                held = held.sort_values(["qid", "score", "id"], ascending=[True, False, True]).groupby("qid").head(k)
            if held is not None:
                yield held

        got = base.mapInPandas(scan, "qid long, id long, score double")
        found = got if found is None else found.union(got)
    if found is None:
        found = base.sparkSession.createDataFrame([], "qid long, id long, score double")
    return ranked_top(found, k).select("qid", "id", "rank", "score")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi scores of docs (id, text) for queries (qid, text); only positive ones, repeated query words count again."""
    words = docs.select("id", tokens(F.col("text")).alias("w"))
    # The first pass over the texts gives three numbers; a document's size is added where its first distinct word is counted.
    n = float(docs.count())
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    df = words.select(F.size("w").alias("dl"), F.posexplode_outer(F.array_distinct("w")).alias("pos", "term")).groupBy("term")
    df = df.agg(F.count("*").alias("df"), F.sum(F.when(first, F.col("dl"))).alias("size"), F.count(F.when(first, F.col("dl"))).alias("sized"))
    idf0 = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    whole = df.agg(F.avg(F.when(F.col("term").isNotNull(), idf0)).alias("mean"), (F.sum("size") / F.nullif(F.sum("sized"), F.lit(0))).alias("avgdl")).first()
    mean, avgdl = whole["mean"] or 0.0, whole["avgdl"] or 1.0
    asked = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    terms = asked.select("term").distinct()
    # The second keeps the queries' words; how many documents hold each is counted on what is kept.
    tf = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.min("dl").alias("dl"))
    weight = tf.groupBy("term").agg(F.count("*").alias("df")).select("term", F.when(idf0 < 0, epsilon * mean).otherwise(idf0).alias("idf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scored = tf.join(weight, "term").join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return ranked_top(scored.filter("score > 0"), k).select("qid", "id", "rank", "score")


def rrf_fuse(lists: list[DataFrame], k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over ranked lists (qid, id, rank from 1)."""
    every = None
    for x in lists:
        part = x.select("qid", "id", "rank")
        every = part if every is None else every.unionAll(part)
    scored = every.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"))
    return ranked_top(scored, k).select("qid", "id", "rank", "score")


def interleave(ranked: DataFrame, k: int) -> DataFrame:
    """Round-robin over sources (qid, source, id, rank, score): slots by rank in the source, then the source."""
    order = Window.partitionBy("qid").orderBy("rank", "source", "id")
    return ranked.withColumn("slot", F.row_number().over(order).cast("long")).filter(F.col("slot") <= k)


def formula_search(formulas: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """Three points for each query word in name or synonyms, one for each in the notes; the best n above 0."""
    q = queries.select("qid", content_tokens(F.col("text")).alias("q"))
    f = formulas.select("id", content_tokens(F.concat_ws(" ", "name", "synonyms")).alias("strong"), content_tokens(F.col("notes")).alias("weak"))
    hits = q.select("qid", F.explode("q").alias("w")).join(
        f.select("id", F.explode("strong").alias("w"), F.lit(3).alias("p")).unionAll(f.select("id", F.explode("weak").alias("w"), F.lit(1).alias("p"))), "w"
    )
    return ranked_top(hits.groupBy("qid", "id").agg(F.sum("p").alias("score")), n).select("qid", "id", "rank", "score")


def citations(quotes: DataFrame, docs: DataFrame, least_words: int = 6) -> DataFrame:
    """(quote_id, id): folded quotes of at least ``least_words`` words found, word by word, in folded documents.

    No pair of every quote with every document: both meet on a hash of the quote's first words, of which each document
    offers every run; the whole quote is then verified on the full texts.
    """
    run = lambda words, i: F.xxhash64(F.slice(words, i, least_words))
    q = quotes.select("quote_id", fold(F.col("quote")).alias("q")).withColumn("w", F.split("q", " ")).filter(F.size("w") >= least_words)
    q = q.select("quote_id", "q", run(F.col("w"), F.lit(1)).alias("start"))
    d = docs.select("id", F.split(fold(F.col("text")), " ").alias("w")).filter(F.size("w") >= least_words)
    starts = d.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (least_words - 1)), lambda i: run(F.col("w"), i))).alias("start"))
    met = starts.join(q.select("quote_id", "start"), "start").select("quote_id", "id").distinct()
    # Only texts that meet a quote are folded again.
    both = met.join(q.select("quote_id", "q"), "quote_id").join(docs.select("id", "text"), "id")
    found = F.contains(F.concat(F.lit(" "), fold(F.col("text")), F.lit(" ")), F.concat(F.lit(" "), "q", F.lit(" ")))
    return both.filter(found).select("quote_id", "id")


def cited_pages(quotes: DataFrame, pages: DataFrame, least_words: int = 6, span: int = 4096) -> DataFrame:
    """(quote_id, id, page): the page on which the first occurrence of each quote begins in each text that holds it.

    Texts are pages (id, page, text) one after another; folded pages joined by spaces are the folded text, so that a quote's offset there is found among
    the running sums of the pages' folded lengths, met by stretches of ``span`` characters.
    """
    folded = pages.select("id", "page", fold(F.coalesce("text", F.lit(""))).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    texts = pages.groupBy("id").agg(whole.alias("text"))
    met = citations(quotes, texts, least_words)
    both = met.join(quotes.select("quote_id", fold(F.col("quote")).alias("q")), "quote_id").join(texts, "id")
    at = F.expr("instr(concat(' ', folded, ' '), concat(' ', q, ' ')) - 1")
    positions = both.withColumn("folded", fold(F.col("text"))).select(F.struct("quote_id", "id").alias("hit"), "id", at.alias("pos"))
    filled = folded.filter("t != ''").select("id", "page", (F.length("t") + 1).alias("chars"))
    upto = F.sum("chars").over(Window.partitionBy("id").orderBy("page"))
    ends = filled.withColumn("upto", upto).withColumn("since", F.col("upto") - F.col("chars"))
    ends = ends.withColumn("stretch", F.explode(F.expr(f"sequence(since div {span}, (upto - 1) div {span})")))
    found = positions.withColumn("stretch", F.expr(f"cast(pos as long) div {span}")).join(ends, ["id", "stretch"]).filter("pos >= since and pos < upto")
    return found.select("hit.quote_id", "hit.id", "page")
