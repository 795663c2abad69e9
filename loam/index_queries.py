"""Queries of the inverted index: built at once, grown by a stream, compacted, and what its tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import index
from loam.registry import BM25, TOKENS, T, doc_texts, query, searches, text_index
from loam.sources.store import workspace
from loam.streaming.incremental import text_index_stream

c = F.col

_WORDS = f"w AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents)"


@query("scan_index", f"WITH {_WORDS}, tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, max(tf) AS most FROM tf WHERE length(term) = 2 GROUP BY term")
def scan_index(spark, d):
    """Postings of the words of two letters."""
    rows = index.table(spark, text_index(spark, d), "postings").filter(F.length("term") == 2)
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


@query("scan_bm25", f"WITH {_WORDS} SELECT id AS doc_id, len(w) AS dl FROM w")
def scan_bm25(spark, d):
    return index.table(spark, text_index(spark, d), "docs").select(c("id").alias("doc_id"), "dl")


#: The stream's files have so many bytes by the planner's guess, so that their number grows with the table and no task writes or reads more.
FILE_BYTES = 16 << 20


def _streamed(spark, d) -> str:
    """An index of all documents that a stream made: the table is dealt to files, of which each micro-batch takes a quarter; every file comes twice."""
    at = workspace(spark)
    docs = doc_texts(spark, d)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = 4 * -(-size // (4 * FILE_BYTES)) or 4
    for _ in range(2):
        docs.repartition(n, "id").write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", n // 2).parquet(f"{at}/in")
    text_index_stream(stream, f"{at}/index", f"{at}/check", 16).awaitTermination()
    return f"{at}/index"


@query("incremental_index", f"WITH {BM25} SELECT qid, id, rank, score FROM b WHERE rank <= 10")
def incremental_index(spark, d):
    """The same search as on the index made at once."""
    return index.search(spark, _streamed(spark, d), searches(spark, d), 10)


@query("compact_index", f"WITH {_WORDS}, df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term) SELECT df, count(*) AS n_terms FROM df GROUP BY df")
def compact_index(spark, d):
    at = workspace(spark)
    index.compact(spark, _streamed(spark, d), f"{at}/index")
    return index.table(spark, f"{at}/index", "histogram").groupBy("df").agg(F.sum("n_terms").alias("n_terms"))
