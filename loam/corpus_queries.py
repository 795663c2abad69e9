"""Further queries of the engine's operators: filters, contexts, catalogues, cell metrics and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators import structure
from loam.registry import BM25, SQL_HEADS, SQL_LINES, SQL_WORDS, T, bm25, doc_lines, doc_texts, facts, FACTS, folded, literal, query, values

c = F.col


# Filters and scalars over whole documents.
@query("noise_line", f"WITH {SQL_LINES} SELECT doc_id, count(*) AS n_kept FROM l WHERE length(regexp_replace(line, '[ \\t]', '', 'g')) >= 4 AND regexp_matches(line, '\\p{{L}}') GROUP BY doc_id")
def noise_line(spark, d):
    kept = doc_lines(spark, d).filter((F.length(F.regexp_replace("line", "[ \t]", "")) >= 4) & c("line").rlike(r"\p{L}"))
    return kept.groupBy(c("id").alias("doc_id")).agg(F.count("*").alias("n_kept"))


@query("short_document", "SELECT doc_id FROM documents WHERE length(text) >= 200")
def short_document(spark, d):
    return T(spark, d, "documents").filter(F.length("text") >= 200).select("doc_id")


@query("orphan_correlation", f"WITH {SQL_LINES} SELECT doc_id, count(*) FILTER (WHERE {SQL_WORDS.format(x='line')} < 6) AS n_short FROM l GROUP BY doc_id")
def orphan_correlation(spark, d):
    return doc_lines(spark, d).groupBy(c("id").alias("doc_id")).agg(F.count_if(structure.word_count("line") < 6).alias("n_short"))


@query("sql_like", "SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%rc1%'")
def sql_like(spark, d):
    return T(spark, d, "documents").filter(c("text").ilike("%license%") | c("source").ilike("%rc1%")).select("doc_id")


@query("fold_cite", f"SELECT doc_id, sha1({folded('text')}) AS folded FROM documents")
def fold_cite(spark, d):
    return T(spark, d, "documents").select("doc_id", F.sha1(tx.fold(c("text"))).alias("folded"))


@query("item_id", "SELECT doc_id, substr(sha1(source || '|' || lang || '|' || doc_id || '|'), 1, 8) AS item_id FROM documents")
def item_id(spark, d):
    return T(spark, d, "documents").select("doc_id", F.substring(F.sha1(F.concat_ws("|", "source", "lang", c("doc_id").cast("string"), F.lit(""))), 1, 8).alias("item_id"))


@query("embed_truncate", "SELECT doc_id, length(substr(text, 1, 6553)) AS n FROM documents")
def embed_truncate(spark, d):
    return T(spark, d, "documents").select("doc_id", F.length(F.substring("text", 1, 6553)).cast("long").alias("n"))


@query("html_escape", "SELECT page_id, sha1(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def html_escape(spark, d):
    return T(spark, d, "pages").select("page_id", F.sha1(tx.html_escape(c("html"))).alias("escaped"))


@query("clean_page", "SELECT doc_id, sha1(trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*[0-9]+\\s*$')), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS cleaned FROM documents")
def clean_page(spark, d):
    return T(spark, d, "documents").select("doc_id", F.sha1(tx.clean_page(c("text"))).alias("cleaned"))


# Catalogue and levels: a language is a book, a source a chapter.
@query("chapters", "SELECT lang, source, min(doc_id) AS first_page, max(doc_id) AS last_page, count(*) AS n_chunks FROM documents GROUP BY 1, 2")
def chapters(spark, d):
    return T(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page"), F.count("*").alias("n_chunks"))


@query("catalog", "SELECT lang, array_to_string(list_sort(list(DISTINCT source))[1:14], ', ') || CASE WHEN count(DISTINCT source) > 14 THEN ' …' ELSE '' END AS chapters FROM documents GROUP BY lang")
def catalog(spark, d):
    rows = T(spark, d, "documents").select("lang", "source").distinct().groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("s"))
    return rows.select("lang", F.concat(F.array_join(F.slice("s", 1, 14), ", "), F.when(F.size("s") > 14, " …").otherwise("")).alias("chapters"))


@query("count_level", f"WITH {SQL_HEADS} SELECT CASE WHEN is_heading THEN 'parent' ELSE 'child' END AS level, count(*) AS n FROM h GROUP BY 1")
def count_level(spark, d):
    h = structure.headings(doc_lines(spark, d))
    return h.groupBy(F.when(c("is_heading"), "parent").otherwise("child").alias("level")).agg(F.count("*").alias("n"))


@query("index_build", f"WITH {SQL_LINES}, k AS (SELECT substr(sha1('|' || chr(10) || line), 1, 12) AS id, doc_id, pos FROM l WHERE length(trim(line)) > 40) SELECT id, min(doc_id) AS doc_id, count(*) AS copies, count(DISTINCT doc_id) AS documents FROM k GROUP BY id")
def index_build(spark, d):
    kept = doc_lines(spark, d).filter(F.length(F.trim("line")) > 40)
    keyed = kept.select(tx.chunk_id(F.array(F.lit(""), F.lit("")), c("line")).alias("k"), c("id").alias("doc_id"))
    return keyed.groupBy(c("k").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.count_distinct("doc_id").alias("documents"))


# Contexts: a source is the parent of its documents.
def hits(spark, d, k=20):
    return bm25(spark, d, k)


@query("context_parent", f"WITH {BM25}, k AS (SELECT b.qid, d.source, b.rank, b.id FROM b JOIN documents d ON d.doc_id = b.id WHERE rank <= 8) SELECT qid::BIGINT AS qid, source, min(rank) AS rank FROM k GROUP BY qid, source")
def context_parent(spark, d):
    source = T(spark, d, "documents").select(c("doc_id").alias("id"), "source")
    return hits(spark, d, 8).join(source, "id").groupBy("qid", "source").agg(F.min("rank").alias("rank"))


@query("context_stats", f"WITH {BM25} SELECT qid::BIGINT AS qid, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT source) AS sources FROM b JOIN documents ON doc_id = id WHERE rank <= 8 GROUP BY qid")
def context_stats(spark, d):
    docs = T(spark, d, "documents").select(c("doc_id").alias("id"), "source", F.length("text").alias("n"))
    return hits(spark, d, 8).join(docs, "id").groupBy("qid").agg(F.count("*").alias("n"), F.sum(c("n").cast("long")).alias("chars"), F.count_distinct("source").alias("sources")).select("qid", "n", "chars", "sources")


@query("context_format", f"WITH {BM25} SELECT qid::BIGINT AS qid, string_agg('[' || rank || '] ' || source || ': ' || text, chr(10) ORDER BY rank) AS context FROM b JOIN documents ON doc_id = id WHERE rank <= 4 GROUP BY qid")
def context_format(spark, d):
    docs = T(spark, d, "documents").select(c("doc_id").alias("id"), "source", "text")
    line = F.concat(F.lit("["), c("rank"), F.lit("] "), "source", F.lit(": "), "text")
    rows = hits(spark, d, 4).join(docs, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("x"))
    return rows.select("qid", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("context"))


@query("append_trace", "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS trace FROM conversations GROUP BY conv_id")
def append_trace(spark, d):
    rows = T(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda r: r["role"]), ">").alias("trace"))


@query("train_val_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('fit:' || doc_id), doc_id) AS n FROM labels) SELECT doc_id, CASE WHEN n <= 50 THEN 'train' ELSE 'val' END AS part FROM r WHERE n <= 80")
def train_val_split(spark, d):
    first = T(spark, d, "labels").select("doc_id", F.sha1(F.concat(F.lit("fit:"), c("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(80)
    return first.withColumn("n", F.row_number().over(Window.orderBy("h", "doc_id"))).select("doc_id", F.when(c("n") <= 50, "train").otherwise("val").alias("part"))


# Cell metrics: quality is right or wrong, toxic the caveat.
@query("cell_metrics", f"WITH {FACTS} SELECT lang, count(*) AS n, round(avg(a), 9) AS accuracy, count(*) FILTER (WHERE a = 0) AS wrong, round(avg(a) FILTER (WHERE b = 0), 9) AS with_caveat, round(avg(a) FILTER (WHERE b = 1), 9) AS without_caveat FROM facts GROUP BY lang")
def cell_metrics(spark, d):
    return facts(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("a"), 9).alias("accuracy"), F.count_if(c("a") == 0).alias("wrong"), F.round(F.avg(F.when(c("b") == 0, c("a"))), 9).alias("with_caveat"), F.round(F.avg(F.when(c("b") == 1, c("a"))), 9).alias("without_caveat"))


@query("median_chunk", "SELECT count(*) AS n, median(length(text))::DOUBLE AS median_chars FROM documents")
def median_chunk(spark, d):
    return T(spark, d, "documents").agg(F.count("*").alias("n"), F.median(F.length("text")).alias("median_chars"))
