"""Queries over whole tables: scans of lines, outlines, answer sheets, catalogues, summaries and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators import structure
from loam.registry import T, folded, query
from loam.sources import io

c = F.col


@query("scan_jsonl", "SELECT conv_id, turn, role, sha1(text) AS text FROM conversations")
def scan_jsonl(spark, d):
    lines = T(spark, d, "conversations").select(F.explode(F.array(F.to_json(F.struct("conv_id", "turn", "role", "text")), F.lit("  "))).alias("line"))
    return io.parse_jsonl(lines, "conv_id long, turn long, role string, text string").withColumn("text", F.sha1("text"))


@query("bench_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def bench_filter(spark, d):
    return T(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn")


@query("fold_header", f"SELECT doc_id, sha1(translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}')) AS folded FROM documents")
def fold_header(spark, d):
    return T(spark, d, "documents").select("doc_id", F.sha1(tx.fold_header(c("text"))).alias("folded"))


@query("distinct_books", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source LIMIT 5")
def distinct_books(spark, d):
    return T(spark, d, "documents").select("source").filter("source is not null").distinct().orderBy("source").limit(5)


@query("sort_multi", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY lang, source DESC, n_chars, doc_id")
def sort_multi(spark, d):
    return T(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").orderBy("lang", F.desc("source"), "n_chars", "doc_id")


@query("dedup_id", "SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1")
def dedup_id(spark, d):
    return structure.first_of(T(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], "doc_id")


@query("join_answers", "SELECT doc_id AS id, CASE WHEN regexp_matches(text, '[0-9]') THEN 'V' ELSE 'F' END AS letter, CAST((quality = 1) = regexp_matches(text, '[0-9]') AS INT) AS correct FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL")
def join_answers(spark, d):
    docs, letter = T(spark, d, "documents"), lambda yes: F.when(yes, "V").otherwise("F")
    label = F.concat(F.lit("q"), F.lpad(c("doc_id").cast("string"), 12, "0")).alias("label")
    sheet = docs.filter("text is not null").select(label, letter(c("text").rlike("[0-9]")).alias("letter"))
    key = T(spark, d, "labels").filter("quality is not null").select(c("doc_id").alias("id"), letter(c("quality") == 1).alias("answer"))
    return structure.join_answers(sheet, docs.select(label, c("doc_id").alias("id")), key)


@query("summarize", f"""WITH w AS (SELECT lang, unnest(list_distinct(list_filter(string_split({folded('text')}, ' '), lambda w: length(w) > 2 AND w NOT IN ({', '.join(f"'{w}'" for w in tx.STOP_WORDS)})))) AS w FROM documents),
r AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS rank FROM w GROUP BY lang, w) SELECT lang AS chapter, string_agg(w, ', ' ORDER BY rank) AS topics FROM r WHERE rank <= 12 GROUP BY lang""")
def summarize(spark, d):
    return structure.chapter_topics(T(spark, d, "documents").select(c("lang").alias("chapter"), "text"))


@query("scan_outline", """WITH RECURSIVE o AS (SELECT r_regionkey AS id, NULL::BIGINT AS parent, r_name AS title, r_regionkey * 100 + 1 AS page FROM region UNION ALL SELECT 1000 + n_nationkey, n_regionkey, n_name, n_regionkey * 100 + 1 + n_nationkey FROM nation),
walk AS (SELECT id, 0 AS depth, title AS path, page FROM o WHERE parent IS NULL UNION ALL SELECT o.id, depth + 1, path || ' > ' || title, o.page FROM o JOIN walk ON o.parent = walk.id)
SELECT id, depth, path, page AS first_page, coalesce(greatest(page, lead(page) OVER (ORDER BY page, depth, id) - 1), 600) AS last_page FROM walk""")
def scan_outline(spark, d):
    roots = T(spark, d, "region").select(c("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), c("r_name").alias("title"), (c("r_regionkey") * 100 + 1).cast("long").alias("page"))
    leaves = T(spark, d, "nation").select((1000 + c("n_nationkey")).cast("long"), c("n_regionkey").cast("long"), "n_name", (c("n_regionkey") * 100 + 1 + c("n_nationkey")).cast("long"))
    return structure.outline_intervals(roots.union(leaves), 600)
