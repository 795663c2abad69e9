"""Queries of reports over any number of systems, of swapped contexts, the journal, batched embedding, page-correct citations and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators import embed, index, ordered, reports, search
from loam.plans import flow, journal, walk
from loam.registry import BM25, FACTS, MCNEMAR, T, bm25, doc_texts, facts, folded, query, sql_share, text_index
from loam.sources.store import workspace

c = F.col

# Ten systems answer the labelled documents, each but for a fiftieth; system k is right unless a share of the id's digests says no.
SYSTEMS = [f"s{k}" for k in range(10)]


def answers(spark, d):
    """(item, system, ok)."""
    share = lambda k, salt: tx.hash_share(f"{salt}{k}", c("doc_id"))
    cells = F.array(*[F.when(share(k, "gone") % 50 > 0, F.struct(F.lit(name).alias("system"), (share(k, "ok") % (k + 3) > 0).cast("int").alias("ok"))) for k, name in enumerate(SYSTEMS)])
    rows = T(spark, d, "labels").select("doc_id", F.explode(F.array_compact(cells)).alias("x"))
    return rows.select(c("doc_id").alias("item"), "x.system", "x.ok")


_ANSWERS = "ans AS (" + " UNION ALL ".join(f"SELECT doc_id AS item, '{name}' AS system, ({sql_share(f'ok{k}', 'doc_id')} % {k + 3} > 0)::INT AS ok FROM labels WHERE {sql_share(f'gone{k}', 'doc_id')} % 50 > 0" for k, name in enumerate(SYSTEMS)) + ")"
_UNIVERSE = f"{_ANSWERS}, uni AS (SELECT item FROM ans GROUP BY item HAVING count(DISTINCT system) = {len(SYSTEMS)}), once AS (SELECT item, system, max(ok) AS ok FROM ans JOIN uni USING (item) GROUP BY item, system)"
_WILSON = "(p + {s} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n)"


@query("scoreboard", f"""WITH {_UNIVERSE}, t AS (SELECT system, count(*)::DOUBLE AS n, sum(ok)::DOUBLE AS r, sum(ok) / count(*)::DOUBLE AS p FROM once GROUP BY system)
SELECT system, n::BIGINT AS n, r::BIGINT AS right, round(p, 9) AS accuracy, round(greatest(0.0, {_WILSON.format(s='-')}), 9) AS low, round(least(1.0, {_WILSON.format(s='')}), 9) AS high, row_number() OVER (ORDER BY r DESC, system) AS place FROM t""".replace("+ - 1.96", "- 1.96").replace("+  1.96 * sqrt", "+ 1.96 * sqrt"))
def scoreboard(spark, d):
    return reports.standings(answers(spark, d))


@query("system_pairs", f"""WITH {_UNIVERSE}, pr AS (SELECT x.system AS first, y.system AS second, count(*) AS n, count(*) FILTER (WHERE x.ok = 1 AND y.ok = 0) AS only_first, count(*) FILTER (WHERE x.ok = 0 AND y.ok = 1) AS only_second FROM once x JOIN once y ON x.item = y.item AND x.system < y.system GROUP BY 1, 2),
p AS (SELECT *, round((only_first - only_second) / n, 9) AS gain, round({MCNEMAR.format(b='only_first', c='only_second')}, 6) AS p FROM pr), j AS (SELECT *, row_number() OVER (ORDER BY p, first, second) AS j, count(*) OVER () AS m FROM p)
SELECT first, second, n, only_first, only_second, gain, p, round(least(1.0, max((m - j + 1) * p) OVER (ORDER BY p, first, second ROWS UNBOUNDED PRECEDING)), 9) AS holm FROM j""")
def system_pairs(spark, d):
    return reports.compared(answers(spark, d))


@query("scoreboard_by_class", f"WITH {_UNIVERSE} SELECT coalesce(lang, '?') AS class, system, count(*) AS n, round(avg(ok), 9) AS accuracy FROM once LEFT JOIN (SELECT doc_id, lang FROM documents) ON doc_id = item GROUP BY ALL")
def scoreboard_by_class(spark, d):
    return reports.standings_by(answers(spark, d), T(spark, d, "documents").select(c("doc_id").alias("item"), c("lang").alias("class")))


# A cell is a language's documents under one setup, the source; its model is the language.
@query("model_table", "WITH t AS (SELECT lang AS model, source AS setup, count(*) AS n, round(avg(quality), 9) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT *, round(accuracy - first_value(accuracy) OVER (PARTITION BY model ORDER BY setup), 9) AS gain FROM t")
def model_table(spark, d):
    rows = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", c("lang").alias("model"), c("source").alias("setup")), "doc_id")
    cells = rows.groupBy("model", "setup").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 9).alias("accuracy"))
    return reports.model_table(cells, "model", ["setup"], "accuracy")


# Questions are the benchmark's items, contexts the best three documents for each.
@query("perturbation", f"""WITH {BM25}, ctx AS (SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS context FROM b JOIN documents ON doc_id = id WHERE rank <= 3 GROUP BY qid),
qs AS (SELECT item_id AS qid, text, CASE WHEN {sql_share('key', 'item_id')} % 2 = 1 THEN 'V' ELSE 'F' END AS key, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark),
s AS (SELECT a.qid, a.text, a.key, o.qid AS other FROM qs a JOIN qs o ON o.i = (a.i + 1) % a.n),
p AS (SELECT 'right' AS scenario, key, coalesce(length(context) + 2, 0) + length(text) AS n FROM qs LEFT JOIN ctx USING (qid) UNION ALL SELECT 'swapped', key, coalesce(length(context) + 2, 0) + length(text) FROM s LEFT JOIN ctx ON ctx.qid = other UNION ALL SELECT 'empty', key, length(text) FROM qs)
SELECT scenario, count(*) AS n, round(avg(((CASE WHEN n % 2 = 1 THEN 'V' ELSE 'F' END) = key)::INT), 9) AS accuracy FROM p GROUP BY scenario""")
def perturbation(spark, d):
    texts = bm25(spark, d, 3).join(doc_texts(spark, d), "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    contexts = texts.select("qid", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("context"))
    key = F.when(tx.hash_share("key", c("item_id")) % 2 == 1, "V").otherwise("F").alias("key")
    return flow.perturbed(T(spark, d, "benchmark").select(c("item_id").alias("qid"), "text", key), contexts)


_EVENT = ("conv_id AS run", "turn AS event", "CASE turn % 3 WHEN 0 THEN 'batch' WHEN 1 THEN 'evaluate' ELSE 'apply' END AS kind", "concat(role, turn % 4) AS candidate", "CAST(length(text) % 100 AS DOUBLE) AS score")


@query("sink_journal", f"""WITH e AS (SELECT {', '.join(_EVENT)} FROM conversations) SELECT run, count(*) AS n_events, arg_max(candidate, event) FILTER (WHERE kind = 'apply') AS applied, count(DISTINCT candidate) FILTER (WHERE kind = 'evaluate') AS tried,
arg_max(candidate, score * 1000000 - event) FILTER (WHERE kind = 'evaluate') AS best, max(score) FILTER (WHERE kind = 'evaluate') AS best_score FROM e GROUP BY run""")
def sink_journal(spark, d):
    """All turns as events, some written twice."""
    path = f"{workspace(spark)}/journal"
    rows = T(spark, d, "conversations").selectExpr(*_EVENT)
    journal.append(rows, path)
    journal.append(rows.filter("event % 2 = 0"), path)
    return journal.current(spark, path)


#: What the stand-in service takes at most; it answers in the wrong order.
ROOM = 2000


def stub_service(texts: list[str]) -> list[tuple[int, list[float]]]:
    if any(len(t) > ROOM for t in texts):
        raise embed.TooLarge
    return [(i, [float(len(t)), float(ord(t[0])) if t else 0.0, float(ord(t[-1])) if t else 0.0]) for i, t in reversed(list(enumerate(texts)))]


@query("embed", f"SELECT doc_id AS id, n::DOUBLE AS chars, coalesce(ascii(text), 0)::DOUBLE AS first, coalesce(ascii(substr(text, n, 1)), 0)::DOUBLE AS last FROM (SELECT doc_id, text, CASE WHEN length(text) <= {ROOM} THEN length(text) ELSE 1414 END AS n FROM documents)")
def embed_documents(spark, d):
    """Vectors of all documents by a service that refuses long texts: those are cut to 6553, 3931, 2358 and then 1414 characters."""
    v = embed.embedded(doc_texts(spark, d), stub_service)
    return v.select("id", *[F.element_at("vector", i).alias(n) for i, n in ((1, "chars"), (2, "first"), (3, "last"))])


# An answer cites benchmark items, each as standing on a page; a page is a line.
_F = folded
_PAGES = f"fl AS (SELECT doc_id, pos, {_F('line')} AS t FROM (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))), up AS (SELECT doc_id, pos, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM fl WHERE t <> '')"
_CITED = f"""bq AS (SELECT item_id, {_F('text')} AS q FROM benchmark), dt AS (SELECT doc_id, {_F('text')} AS t FROM documents), hit AS (SELECT item_id, doc_id, strpos(' ' || t || ' ', ' ' || q || ' ') - 1 AS spot FROM bq JOIN dt ON contains(' ' || t || ' ', ' ' || q || ' ') WHERE len(string_split(q, ' ')) >= 6),
{_PAGES}, pg AS (SELECT item_id, doc_id, min(pos) AS page FROM hit JOIN up USING (doc_id) WHERE upto > spot GROUP BY item_id, doc_id), one AS (SELECT item_id, min(doc_id) AS doc_id, arg_min(page, doc_id) AS page FROM pg GROUP BY item_id)"""


def cited_pages(spark, d):
    docs = T(spark, d, "documents").select(c("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
    quotes = T(spark, d, "benchmark").select(c("item_id").alias("quote_id"), c("text").alias("quote"))
    return search.cited_pages(quotes, docs)


@query("cite_pages", f"WITH {_CITED} SELECT item_id, doc_id, page FROM pg")
def cite_pages(spark, d):
    return cited_pages(spark, d).select(c("quote_id").alias("item_id"), c("id").alias("doc_id"), "page")


@query("cite_fidelity", f"""WITH {_CITED} SELECT item_id % 10 AS answer, count(*) AS total, count(one.doc_id) AS literal, count(*) FILTER (WHERE page = item_id % 5) AS page_ok, round(count(one.doc_id) / count(*), 9) AS fidelity, coalesce(min(one.doc_id), -1) AS first_doc
FROM benchmark LEFT JOIN one USING (item_id) GROUP BY 1""")
def cite_fidelity(spark, d):
    """Of each answer's citations: how many are literal in the first document that holds them, and how many of those name the page they stand on."""
    first = cited_pages(spark, d).groupBy(c("quote_id").alias("item_id")).agg(F.min(F.struct("id", "page")).alias("x")).select("item_id", c("x.id").alias("first_doc"), "x.page")
    rows = T(spark, d, "benchmark").select("item_id").join(first, "item_id", "left")
    return rows.groupBy((c("item_id") % 10).alias("answer")).agg(
        F.count("*").alias("total"), F.count("first_doc").alias("literal"), F.count_if(c("page") == c("item_id") % 5).alias("page_ok"),
        F.round(F.count("first_doc") / F.count("*"), 9).alias("fidelity"), F.coalesce(F.min("first_doc"), F.lit(-1)).alias("first_doc"),
    )


# Ranks over hot groups and whole tables.
@query("occurrence_no", "SELECT doc_id, source || '_' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS name FROM documents")
def occurrence_no(spark, d):
    rows = ordered.ranked(T(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    return rows.select("doc_id", F.concat("source", F.lit("_"), c("rank") + 1).alias("name"))


@query("running_sum", "SELECT doc_id, source, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars)::BIGINT AS before FROM documents")
def running_sum(spark, d):
    """How many characters of its source lie before each document."""
    return ordered.ranked(T(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars").select("doc_id", "source", "before")


@query("join_rotate", "WITH o AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) SELECT a.item_id, b.item_id AS other_id FROM o a JOIN o b ON b.i = (a.i + 1) % a.n")
def join_rotate(spark, d):
    return ordered.rotated(T(spark, d, "benchmark"), "item_id", "other_id")


@query("sink_exam", "WITH r AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS n, count(*) OVER () AS total FROM benchmark) SELECT item_id, 'q' || lpad(CAST(n AS VARCHAR), 4, '0') AS label, CAST(floor((n - 1) / ceil(total / 4.0)) + 1 AS INT) AS part FROM r")
def sink_exam(spark, d):
    items = T(spark, d, "benchmark").select("item_id")
    each = items.select(F.ceil(F.count("*") / 4.0)).scalar()
    rows = ordered.ranked(items, [], ["item_id"])
    return rows.select("item_id", F.concat(F.lit("q"), F.lpad((c("rank") + 1).cast("string"), 4, "0")).alias("label"), (F.floor(c("rank") / each) + 1).cast("int").alias("part"))


@query("p95_index", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, n, value AS p95 FROM r WHERE i = least(floor(n * 0.95), n - 1) + 1")
def p95_index(spark, d):
    return ordered.at_share(T(spark, d, "events"), "event_type", "value").withColumnRenamed("element", "p95")


# Walks: books are languages, chapters sources.
def library(spark, d):
    return T(spark, d, "documents").select(c("doc_id").alias("id"), F.coalesce("lang", F.lit("?")).alias("book"), F.coalesce("source", F.lit("?")).alias("chapter"), "text")


@query("navigate")
def navigate(spark, d):
    """What each benchmark item has read after at most four rounds over all documents."""
    look = lambda docs, asked, k: index.search(spark, text_index(spark, d), asked, k)
    return walk.walk(T(spark, d, "benchmark").select(c("item_id").alias("qid"), "text"), library(spark, d), walk.Walk(suffices=flow.covers(0.7), search=look))


@query("catalogue", "SELECT coalesce(lang, '?') AS book, coalesce(source, '?') AS chapter, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def catalogue(spark, d):
    return walk.catalogue(library(spark, d)).select("book", "chapter", "n", "chars")


# Kinds of questions, coverage, classes and destinations. A question is a labelled document: quality says whether it was answered well.
_W = "translate(substr(sha1(text), 1, 8), '0123456789', 'ghijkmnopq')"


@query("error_rate_by_kind", f"SELECT CASE WHEN doc_id % 5 IN (0, 1) THEN 'image' WHEN doc_id % 5 IN (2, 3) THEN 'numeric' ELSE 'prose' END AS kind, count(*) AS n, round(avg(1 - quality), 9) AS error_rate FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL GROUP BY 1")
def error_rate_by_kind(spark, d):
    stem = f"concat(CASE doc_id % 5 WHEN 0 THEN 'NA  FIGURA abaixo ' WHEN 2 THEN 'Configura 7 ' ELSE '' END, {_W}) AS stem"
    claim = f"concat(CASE doc_id % 5 WHEN 1 THEN 'a seta, 5 mg, ' WHEN 2 THEN 'usar 2,5 de ' WHEN 3 THEN '10 horas e ' ELSE 'x9mg ' END, {_W}) AS claim"
    docs = T(spark, d, "documents").filter("text is not null").selectExpr("doc_id", stem, claim)
    return reports.error_rates(T(spark, d, "labels").join(docs, "doc_id").withColumnRenamed("quality", "ok"))


@query("term_coverage", f"""WITH {BM25}, ctx AS (SELECT qid, {folded("string_agg(text, chr(10) ORDER BY rank)")} AS context FROM b JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY qid),
qq AS (SELECT item_id AS qid, ({sql_share('right', 'item_id')} % 2)::INT AS ok, list_distinct(list_filter(string_split({folded('text')}, ' '), lambda t: length(t) >= 8)) AS terms FROM benchmark)
SELECT ok, count(*) AS n, round(avg(len(list_filter(terms, lambda t: contains(coalesce(context, ''), t))) / len(terms)), 9) AS coverage FROM qq LEFT JOIN ctx USING (qid) WHERE len(terms) > 0 GROUP BY ok""")
def term_coverage(spark, d):
    """Do rare words of a question stand in the best five documents, where it was answered well and where not?"""
    texts = bm25(spark, d, 5).join(doc_texts(spark, d), "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    contexts = texts.select("qid", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("context"))
    ok = (tx.hash_share("right", c("item_id")) % 2).cast("int").alias("ok")
    return reports.term_coverage(T(spark, d, "benchmark").select(c("item_id").alias("qid"), "text", ok), contexts)


_ROUTE = "CASE WHEN doc_id % 3 = 0 OR lang = 'de' THEN 'norms' ELSE 'book' END"


@query("by_class_paired", f"""WITH {FACTS}, r AS (SELECT lang, {_ROUTE} AS route, count(*) AS r FROM facts GROUP BY ALL), m AS (SELECT lang, route FROM r QUALIFY row_number() OVER (PARTITION BY lang ORDER BY r DESC, route) = 1),
t AS (SELECT lang, count(*) AS n, round(avg(a), 9) AS accuracy_a, round(avg(b), 9) AS accuracy_b, count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b FROM facts GROUP BY lang),
p AS (SELECT *, round({MCNEMAR.format(b='only_a', c='only_b')}, 6) AS p FROM t JOIN m USING (lang)) SELECT lang AS class, n, accuracy_a, accuracy_b, only_a, only_b, route, p, route = 'book' AND p < 0.05 AS noise FROM p""")
def by_class_paired(spark, d):
    rows = facts(spark, d).select(c("lang").alias("class"), F.expr(_ROUTE).alias("route"), "a", "b")
    return reports.by_class(rows, same_setup=True)


@query("routing_by_dest", f"""WITH {FACTS} SELECT {_ROUTE} AS route, lang IN ('de', 'fr') AS normative, count(*) AS n, round(avg(a), 9) AS accuracy, round(avg(CASE WHEN doc_id % 7 > 0 THEN b END), 9) AS base, round(avg(a) - avg(CASE WHEN doc_id % 7 > 0 THEN b END), 9) AS gain FROM facts GROUP BY 1, 2""")
def routing_by_dest(spark, d):
    """A route taken and the group a question is truly of, against a base system that left out every seventh."""
    rows = facts(spark, d).withColumn("item", c("doc_id"))
    routed = rows.select("item", F.expr(_ROUTE).alias("route"), c("lang").isin("de", "fr").alias("normative"), c("a").alias("ok"))
    return reports.by_destination(routed, rows.filter("doc_id % 7 > 0").select("item", c("b").alias("ok")))
