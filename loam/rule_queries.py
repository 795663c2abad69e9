"""Queries of the rules on texts, of scans and sinks, and of the remaining filters, joins and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import rules
from loam.functions import text as tx
from loam.operators import structure
from loam.plans import flow
from loam.registry import BM25, SQL_LINES, TOKENS, T, bm25, doc_lines, doc_texts, folded, literal, query, searches, values

c = F.col

_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)


def _spelling(x: str) -> str:
    out = f"replace({folded(x)}, ' ', '')"
    for a, b in rules.COGNATE_SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace({out}, '[^a-z]', '', 'g')"


# Rules over whole documents and pages.
@query("cognates", f"SELECT doc_id, len(list_distinct(list_transform(list_filter(list_transform(list_filter(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}'), lambda w: lower(w) NOT IN ({_QUOTED(rules.EMPTY_WORDS)})), lambda w: {_spelling('w')}), lambda s: length(s) >= 5), lambda s: substr(s, 1, 5)))) AS n_stems FROM documents")
def cognates(spark, d):
    return T(spark, d, "documents").select("doc_id", F.size(rules.cognates(c("text"))).cast("long").alias("n_stems"))


@query("content_tokens", f"SELECT doc_id, len(list_distinct(list_filter(string_split({folded('text')}, ' '), lambda w: length(w) > 2 AND w NOT IN ({_QUOTED(tx.STOP_WORDS)})))) AS n_tokens FROM documents")
def content_tokens(spark, d):
    return T(spark, d, "documents").select("doc_id", F.size(tx.content_tokens(c("text"))).cast("long").alias("n_tokens"))


@query("heading_level", f"WITH {SQL_LINES}, v AS (SELECT doc_id, regexp_replace(line, '[^\\p{{L}}]', '', 'g') AS letters FROM l WHERE trim(line) <> '') SELECT doc_id, count(*) FILTER (WHERE letters <> '' AND upper(letters) = letters) AS level1, count(*) FILTER (WHERE letters = '' OR upper(letters) <> letters) AS level2 FROM v GROUP BY doc_id")
def heading_level(spark, d):
    level = tx.heading_level(c("line"))
    return doc_lines(spark, d).filter(F.trim("line") != "").groupBy(c("id").alias("doc_id")).agg(F.count_if(level == 1).alias("level1"), F.count_if(level == 2).alias("level2"))


@query("scan_page_range", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 200 AND 2000")
def scan_page_range(spark, d):
    return T(spark, d, "documents").filter(c("n_chars").between(200, 2000)).select("doc_id")


@query("empty_page", "SELECT page_id FROM pages WHERE length(html) >= 120")
def empty_page(spark, d):
    return T(spark, d, "pages").filter(F.length("html") >= 120).select("page_id")


@query("digits_only", "SELECT page_id, try_cast(regexp_replace(url, '[^0-9]', '', 'g') AS INT) AS number FROM pages")
def digits_only(spark, d):
    return T(spark, d, "pages").select("page_id", tx.digits_only(c("url")).alias("number"))


@query("reformulate", "SELECT doc_id, sha1(CASE WHEN q = '' THEN text ELSE q END) AS query FROM (SELECT doc_id, text, substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 400) AS q FROM documents)")
def reformulate(spark, d):
    q = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 400)
    return T(spark, d, "documents").select("doc_id", F.sha1(F.when(q == "", c("text")).otherwise(q)).alias("query"))


@query("flat_parents", "SELECT doc_id, substr(sha1('' || chr(10) || text), 1, 12) AS id, 0 AS depth FROM documents")
def flat_parents(spark, d):
    path = F.array().cast("array<string>")
    return T(spark, d, "documents").select("doc_id", tx.chunk_id(path, c("text")).alias("id"), F.size(path).alias("depth"))


# Joins and sets.
@query("lookup_id", "SELECT doc_id, sha1(text) AS text FROM labels JOIN documents USING (doc_id)")
def lookup_id(spark, d):
    return T(spark, d, "labels").select("doc_id").join(T(spark, d, "documents").select("doc_id", F.sha1("text").alias("text")), "doc_id")


@query("parent_of", "SELECT n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def parent_of(spark, d):
    return T(spark, d, "nation").join(T(spark, d, "region"), c("n_regionkey") == c("r_regionkey"), "left").select("n_name", "r_name")


@query("join_permitted", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def join_permitted(spark, d):
    return T(spark, d, "documents").select("doc_id").join(T(spark, d, "labels").filter("toxic = 0"), "doc_id", "left_semi")


@query("join_class", "SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '?') AS class, CASE WHEN quality IS NULL THEN 'ausente' ELSE 'label' END AS origin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_class(spark, d):
    both = T(spark, d, "documents").select("doc_id").join(T(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.select("doc_id", F.coalesce(c("quality").cast("string"), F.lit("?")).alias("class"), F.when(c("quality").isNull(), "ausente").otherwise("label").alias("origin"))


@query("set_union", "SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def set_union(spark, d):
    rows = T(spark, d, "labels")
    return rows.filter("quality = 0").select("doc_id").union(rows.filter("toxic = 1").select("doc_id")).distinct()


@query("set_intersect", "SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def set_intersect(spark, d):
    rows = T(spark, d, "labels")
    return rows.filter("quality = 0").select("doc_id").intersect(rows.filter("toxic = 1").select("doc_id"))


@query("set_except", "SELECT doc_id FROM labels WHERE quality = 0 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_except(spark, d):
    rows = T(spark, d, "labels")
    return rows.filter("quality = 0").select("doc_id").subtract(rows.filter("toxic = 1").select("doc_id"))


# Search and contexts.
_Q = f"asked AS (SELECT item_id AS qid, list_distinct({TOKENS}) AS q FROM benchmark)"


@query("rerank", f"WITH {BM25}, {_Q}, s AS (SELECT b.qid, id, round(len(list_intersect(asked.q, {TOKENS})) / len(asked.q), 6) AS score FROM b JOIN documents ON doc_id = id JOIN asked ON asked.qid = b.qid WHERE rank <= 20), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT qid::BIGINT AS qid, id, score::DOUBLE AS score, rank FROM r WHERE rank <= 8")
def rerank(spark, d):
    asked = searches(spark, d).withColumn("query", c("text"))
    docs = doc_texts(spark, d)
    start = flow.State(asked, docs, ranked=bm25(spark, d, 20).withColumn("source", F.lit("all")))
    return flow._rerank(start, flow.Options()).ranked.select("qid", "id", "score", "rank")


@query("context_child", f"WITH {BM25} SELECT qid::BIGINT AS qid, rank AS slot, id FROM b WHERE rank <= 8")
def context_child(spark, d):
    return bm25(spark, d, 8).select("qid", c("rank").alias("slot"), "id")


@query("context_provenance", f"WITH {BM25} SELECT source, count(*) AS n, count(DISTINCT qid) AS questions FROM b JOIN documents ON doc_id = id WHERE rank <= 8 GROUP BY source")
def context_provenance(spark, d):
    found = bm25(spark, d, 8).join(T(spark, d, "documents").select(c("doc_id").alias("id"), "source"), "id")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("qid").alias("questions"))


@query("cond_accuracy", "SELECT lang, round(avg(quality) FILTER (WHERE toxic = 1), 9) AS with_caveat, round(avg(quality) FILTER (WHERE toxic = 0), 9) AS without_caveat, count(*) FILTER (WHERE toxic = 1) AS n_caveats FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def cond_accuracy(spark, d):
    rows = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    right = lambda t: F.round(F.avg(F.when(c("toxic") == t, c("quality"))), 9)
    return rows.groupBy("lang").agg(right(1).alias("with_caveat"), right(0).alias("without_caveat"), F.count_if(c("toxic") == 1).alias("n_caveats"))


# Sinks as tables.


@query("sink_report", "WITH t AS (SELECT lang, count(*) AS n, round(100.0 * avg(quality), 1)::DOUBLE AS share FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT '| lang | n | % |' || chr(10) || '|-|-|-|' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' | ' || share || ' |', chr(10) ORDER BY lang) AS report FROM t")
def sink_report(spark, d):
    rows = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    t = rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(100.0 * F.avg("quality"), 1).alias("share"))
    line = F.concat(F.lit("| "), "lang", F.lit(" | "), "n", F.lit(" | "), "share", F.lit(" |"))
    lines = F.array_sort(F.collect_list(F.struct("lang", line.alias("line"))))
    return t.agg(F.concat(F.lit("| lang | n | % |\n|-|-|-|\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("report"))
