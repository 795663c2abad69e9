"""All queries of the engine's own operators on the driver's tables, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from loam.functions import rules
from loam.functions import text as tx
from loam.operators import index, search, stats, structure
from loam.plans import flow
from loam.sources.store import workspace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return put


def T(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def literal(rows: list[tuple], columns: list[str], casts: dict[str, str] | None = None) -> str:
    """SQL for expected rows worked out by hand."""
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    casts = casts or {}
    return "SELECT " + ", ".join(f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in columns) + f" FROM (VALUES {body}) t({', '.join(columns)})"


# Dense search: queries are all vectors whose id is divisible by 100, against all vectors.
DENSE = """q AS (SELECT vec_id AS qid, label AS tag, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.qid, q.tag, e.vec_id AS id, e.label, round(list_dot_product(q.v, e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""


def dense_sides(spark, d, tag=None):
    e = T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), *([F.col(tag).alias("tag")] if tag else []))
    return e, e.filter("id % 100 = 0").withColumnRenamed("id", "qid")


@query("dense_topk", f"WITH {DENSE} SELECT qid, id, rank, score FROM r WHERE rank <= 20")
def dense_topk(spark, d):
    return search.dense_topk(*dense_sides(spark, d), k=20)


@query("restricted_topk", f"WITH {DENSE}, f AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE tag = label) SELECT qid, id, rank, score FROM f WHERE rank <= 8")
def restricted_topk(spark, d):
    return search.dense_topk(*dense_sides(spark, d, "label"), k=8)


@query("quota_interleave", f"""WITH {DENSE}, f AS (SELECT qid, label % 2 AS source, id, score, row_number() OVER (PARTITION BY qid, label % 2 ORDER BY score DESC, id) AS rank FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, source, id) AS slot FROM f WHERE rank <= 4) SELECT qid, source::INT AS source, id, rank, score, slot FROM o WHERE slot <= 8""")
def quota_interleave(spark, d):
    e, q = dense_sides(spark, d)
    source = T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("source"))
    tagged = e.join(source, "id")
    halves = [search.dense_topk(tagged.filter(F.col("source") == s).drop("source"), q, k=4).withColumn("source", F.lit(s)) for s in (0, 1)]
    return search.interleave(halves[0].unionByName(halves[1]), 8).select("qid", "source", "id", "rank", "score", "slot")


@query("l2_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) + 1e-9))), 6) AS total FROM embeddings")
def l2_normalize(spark, d):
    v = F.col("embedding").cast("array<double>")
    rows = T(spark, d, "embeddings").select("vec_id", v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("n"))
    return rows.select("vec_id", F.round("n", 6).alias("norm"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x / (F.col("n") + 1e-9)), 6).alias("total"))


@query("recall_mrr", f"""WITH {DENSE}, f AS (SELECT qid, id, tag = label AS carries, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE id <> qid),
m AS (SELECT qid, min(rank) FILTER (WHERE carries AND rank <= 100) AS first FROM f GROUP BY qid)
SELECT count(*) AS n, round(avg(CASE WHEN first <= 4 THEN 1.0 ELSE 0 END), 9) AS recall4, round(avg(CASE WHEN first <= 8 THEN 1.0 ELSE 0 END), 9) AS recall8, round(avg(CASE WHEN first <= 20 THEN 1.0 ELSE 0 END), 9) AS recall20, round(avg(CASE WHEN first <= 50 THEN 1.0 ELSE 0 END), 9) AS recall50, round(avg(CASE WHEN first <= 100 THEN 1.0 ELSE 0 END), 9) AS recall100,
round(avg(coalesce(1.0 / first, 0)), 9) AS mrr, median(first)::DOUBLE AS median_rank, count(*) FILTER (WHERE first IS NULL) AS never FROM m""")
def recall_mrr(spark, d):
    e, q = dense_sides(spark, d)
    label = T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    found = search.dense_topk(e, q, k=101).filter("id != qid").drop("rank")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter("rank <= 100")
    found = found.join(label, "id").join(label.select(F.col("id").alias("qid"), F.col("label").alias("tag")), "qid")
    first = found.groupBy("qid").agg(F.expr("min(rank) filter (where label = tag)").alias("first"))
    at = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 9).alias(f"recall{k}")
    return first.agg(F.count("*").alias("n"), *map(at, (4, 8, 20, 50, 100)), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"), F.median("first").alias("median_rank"), F.count_if(F.col("first").isNull()).alias("never"))


# Text search over whole documents; the questions are the benchmark's items.
TOKENS = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) > 1)"
BM25 = f"""w AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM w),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term),
i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM df, n), idf AS (SELECT term, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM i0) ELSE idf0 END AS idf FROM i0),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT id, term, count(*) AS tf, min(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY id, term),
sc AS (SELECT qid, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), n GROUP BY qid, id),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0)"""


def doc_texts(spark, d):
    return T(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def searches(spark, d):
    return T(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


_indexes: dict[tuple[str, str], str] = {}


def text_index(spark, d) -> str:
    """The folder of an inverted index of all documents, built once an application and input."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        path = f"{workspace(spark)}/index"
        index.add(doc_texts(spark, d), path, 0)
        _indexes[key] = path
    return _indexes[key]


def bm25(spark, d, k: int):
    return index.search(spark, text_index(spark, d), searches(spark, d), k)


@query("tokenize_stats", f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {TOKENS} AS w FROM documents)")
def tokenize_stats(spark, d):
    w = T(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("bm25_topk", f"WITH {BM25} SELECT qid::BIGINT AS qid, id, rank, score FROM b WHERE rank <= 20")
def bm25_topk(spark, d):
    return bm25(spark, d, 20)


@query("rrf_hybrid", f"""WITH {BM25}, e AS (SELECT a.vec_id AS qid, c.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings c WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
er AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM e), u AS (SELECT qid, id, rank FROM b WHERE rank <= 20 UNION ALL SELECT qid, id, rank FROM er WHERE rank <= 20),
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY qid, id), g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) SELECT qid::BIGINT AS qid, id, rank, score FROM g WHERE rank <= 10""")
def rrf_hybrid(spark, d):
    e, _ = dense_sides(spark, d)
    q = e.join(searches(spark, d).select(F.col("qid").alias("id")), "id", "left_semi").withColumnRenamed("id", "qid")
    return search.rrf_fuse([bm25(spark, d, 20), search.dense_topk(e, q, 20)], 10)


def folded(c):
    return f"trim(regexp_replace(translate(lower({c}), '{tx.ACCENTED}', '{tx.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"


CITED = f"""b AS (SELECT item_id, {folded('text')} AS q FROM benchmark), dd AS (SELECT doc_id, {folded('text')} AS t FROM documents),
c AS (SELECT item_id, doc_id FROM b JOIN dd ON contains(' ' || t || ' ', ' ' || q || ' ') WHERE len(string_split(q, ' ')) >= 6)"""


def cited(spark, d):
    quotes = T(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return search.citations(quotes, doc_texts(spark, d)).select(F.col("quote_id").alias("item_id"), F.col("id").alias("doc_id"))


@query("cite_containment", f"WITH {CITED} SELECT item_id, doc_id FROM c")
def cite_containment(spark, d):
    return cited(spark, d)


# Sampling, splits and duplicates.
def sql_share(salt, key):
    return f"CAST('0x' || substr(sha1('{salt}:' || {key}), 1, 8) AS BIGINT)"


@query("hash_split", f"SELECT doc_id, CASE WHEN {sql_share('split', 'doc_id')} % 2 = 0 THEN 'dev' ELSE 'test' END AS side FROM documents")
def hash_split(spark, d):
    return T(spark, d, "documents").select("doc_id", F.when(tx.hash_share("split", F.col("doc_id")) % 2 == 0, "dev").otherwise("test").alias("side"))


KEYED = "sha1(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))))"


@query("dedup_content", f"SELECT {KEYED} AS content_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_content(spark, d):
    return T(spark, d, "documents").groupBy(tx.content_key(F.col("text")).alias("content_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY sha1('7:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, d):
    return T(spark, d, "documents").orderBy(F.sha1(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(100).select("doc_id")


@query("stratified_sample", "WITH h AS (SELECT doc_id, coalesce(lang, '?') AS lang, sha1('9:' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS n FROM h), q AS (SELECT *, 102 // (SELECT count(DISTINCT lang) FROM h) AS quota FROM r), o AS (SELECT *, n <= quota AS by_quota, row_number() OVER (ORDER BY n > quota, h, doc_id) AS place FROM q WHERE n <= 102) SELECT lang, doc_id, by_quota FROM o WHERE place <= 102")
def stratified_sample(spark, d):
    h = F.sha1(F.concat(F.lit("9:"), F.col("doc_id").cast("string")))
    return stats.stratified(T(spark, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), "doc_id", h.alias("h")), "lang", ["h", "doc_id"], 102).select("lang", "doc_id", "by_quota")


# Paired statistics: two arms per labelled document, classes are languages.
FACTS = "facts AS (SELECT doc_id, lang, quality AS a, 1 - toxic AS b, CAST('0x' || substr(sha1('arm:' || doc_id), 1, 8) AS BIGINT) % 2 AS c FROM labels JOIN documents USING (doc_id))"
MCNEMAR = "CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2.0))))) END"
PAIRED = "count(*) AS n, count(*) FILTER (WHERE a = 1 AND b = 1) AS both, count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b, count(*) FILTER (WHERE a = 0 AND b = 0) AS neither"
GAINS = f"round((only_b - only_a) / n, 9) AS gain, round(sqrt(only_a + only_b - (only_b - only_a) * (only_b - only_a) / n) / n, 9) AS se, round({MCNEMAR.format(b='only_a', c='only_b')}, 6) AS p"


def facts(spark, d):
    rows = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", "lang", F.col("quality").cast("int").alias("a"), (1 - F.col("toxic")).cast("int").alias("b"), (tx.hash_share("arm", F.col("doc_id")) % 2).cast("int").alias("c"))


@query("paired_mcnemar", f"WITH {FACTS}, t AS (SELECT {PAIRED} FROM facts) SELECT *, {GAINS} FROM t")
def paired_mcnemar(spark, d):
    return stats.paired(facts(spark, d), "a", "b")


@query("accuracy_rollup", f"WITH {FACTS} SELECT coalesce(lang, 'TOTAL') AS lang, count(*) AS n, sum(a)::BIGINT AS right_a, round(avg(a), 9) AS accuracy FROM facts GROUP BY ROLLUP (lang)")
def accuracy_rollup(spark, d):
    return facts(spark, d).rollup("lang").agg(F.count("*").alias("n"), F.sum("a").alias("right_a"), F.round(F.avg("a"), 9).alias("accuracy")).withColumn("lang", F.coalesce("lang", F.lit("TOTAL")))


@query("wilson_by_class", f"""WITH {FACTS}, t AS (SELECT lang, count(*)::DOUBLE AS n, sum(a) / count(*)::DOUBLE AS p FROM facts GROUP BY lang)
SELECT lang, n::BIGINT AS n, round(p, 9) AS accuracy, round(greatest(0.0, (p + 1.96*1.96/(2*n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 9) AS low, round(least(1.0, (p + 1.96*1.96/(2*n) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 9) AS high FROM t""")
def wilson_by_class(spark, d):
    t = facts(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum("a").alias("r"))
    low, high = stats.wilson(F.col("r"), F.col("n"))
    return t.select("lang", "n", F.round(F.col("r") / F.col("n"), 9).alias("accuracy"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("contingency", f"WITH {FACTS} SELECT a::INT AS a, b::INT AS b, count(*) AS n FROM facts GROUP BY a, b")
def contingency(spark, d):
    return facts(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("overlap_chance", f"WITH {FACTS} SELECT count(*) FILTER (WHERE a = 0 AND b = 0) AS both_wrong, round(count(*) FILTER (WHERE a = 0) * count(*) FILTER (WHERE b = 0) / count(*), 9) AS by_chance FROM facts")
def overlap_chance(spark, d):
    return facts(spark, d).agg(F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("both_wrong"), F.round(F.count_if(F.col("a") == 0) * F.count_if(F.col("b") == 0) / F.count("*"), 9).alias("by_chance"))


# Arms a and b answered the labelled documents, arm c all.
ARMS = "arms AS (SELECT doc_id, 'a' AS arm, a AS ok FROM facts UNION ALL SELECT doc_id, 'b', b FROM facts UNION ALL SELECT doc_id, 'c', CAST('0x' || substr(sha1('arm:' || doc_id), 1, 8) AS BIGINT) % 2 FROM documents)"


def arms(spark, d):
    two = facts(spark, d).select("doc_id", F.explode(F.array(*[F.struct(F.lit(x).alias("arm"), F.col(x).alias("ok")) for x in "ab"])).alias("x")).select("doc_id", "x.arm", "x.ok")
    return two.unionByName(T(spark, d, "documents").select("doc_id", F.lit("c").alias("arm"), (tx.hash_share("arm", F.col("doc_id")) % 2).cast("int").alias("ok")))


@query("universe", f"WITH {FACTS}, {ARMS} SELECT doc_id FROM arms GROUP BY doc_id HAVING count(DISTINCT arm) = 3")
def universe(spark, d):
    a = arms(spark, d)
    return a.groupBy("doc_id").agg(F.count_distinct("arm").alias("n")).filter("n = 3").select("doc_id")


@query("all_failed", f"WITH {FACTS}, {ARMS} SELECT doc_id FROM arms GROUP BY doc_id HAVING max(ok) = 0")
def all_failed(spark, d):
    return arms(spark, d).groupBy("doc_id").agg(F.max("ok").alias("m")).filter("m = 0").select("doc_id")


@query("error_union", f"WITH {FACTS} SELECT doc_id FROM facts WHERE a = 0 UNION SELECT doc_id FROM facts WHERE b = 0")
def error_union(spark, d):
    f = facts(spark, d)
    return f.filter("a = 0").select("doc_id").union(f.filter("b = 0").select("doc_id")).distinct()


@query("pairwise_holm", f"""WITH {FACTS}, {ARMS}, u AS (SELECT doc_id FROM arms GROUP BY doc_id HAVING count(DISTINCT arm) = 3),
pr AS (SELECT x.arm AS first, y.arm AS second, count(*) FILTER (WHERE x.ok = 1 AND y.ok = 0) AS only_first, count(*) FILTER (WHERE x.ok = 0 AND y.ok = 1) AS only_second FROM arms x JOIN arms y ON x.doc_id = y.doc_id AND x.arm < y.arm WHERE x.doc_id IN (SELECT doc_id FROM u) GROUP BY 1, 2),
p AS (SELECT *, round({MCNEMAR.format(b='only_first', c='only_second')}, 6) AS p FROM pr), j AS (SELECT *, row_number() OVER (ORDER BY p, first, second) AS j, count(*) OVER () AS m FROM p)
SELECT first, second, only_first, only_second, p, round(least(1.0, max((m - j + 1) * p) OVER (ORDER BY p, first, second ROWS UNBOUNDED PRECEDING)), 9) AS holm FROM j""")
def pairwise_holm(spark, d):
    a = arms(spark, d)
    wide = a.groupBy("doc_id").pivot("arm", ["a", "b", "c"]).agg(F.max("ok")).filter("a is not null and b is not null and c is not null")
    counts = wide.agg(*[F.count_if((F.col(x) == 1) & (F.col(y) == 0)).alias(f"{x}{y}") for x in "abc" for y in "abc" if x != y])
    pairs = counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), F.col(f"{x}{y}").alias("only_first"), F.col(f"{y}{x}").alias("only_second")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])).alias("p")).select("p.*")
    pairs = pairs.withColumn("p", F.round(stats.mcnemar(F.col("only_first"), F.col("only_second")), 6))
    return stats.holm(pairs, "p", ["first", "second"]).withColumn("holm", F.round("holm", 9))


@query("routing_confusion", """WITH r AS (SELECT lang = 'en' AS truth, regexp_matches(lower(text), '(^|[^a-z])(the|and)([^a-z]|$)') AS routed FROM documents)
SELECT count(*) FILTER (WHERE truth AND routed) AS tp, count(*) FILTER (WHERE NOT truth AND routed) AS fp, count(*) FILTER (WHERE truth AND NOT routed) AS fn, count(*) FILTER (WHERE NOT truth AND NOT routed) AS tn,
round(count(*) FILTER (WHERE truth AND routed) / count(*) FILTER (WHERE routed), 9) AS precision, round(count(*) FILTER (WHERE truth AND routed) / count(*) FILTER (WHERE truth), 9) AS recall FROM r""")
def routing_confusion(spark, d):
    r = T(spark, d, "documents").select((F.col("lang") == "en").alias("truth"), F.lower("text").rlike("(^|[^a-z])(the|and)([^a-z]|$)").alias("routed"))
    tp = F.count_if(F.col("truth") & F.col("routed"))
    return r.agg(tp.alias("tp"), F.count_if(~F.col("truth") & F.col("routed")).alias("fp"), F.count_if(F.col("truth") & ~F.col("routed")).alias("fn"), F.count_if(~F.col("truth") & ~F.col("routed")).alias("tn"), F.round(tp / F.count_if("routed"), 9).alias("precision"), F.round(tp / F.count_if("truth"), 9).alias("recall"))


def sql_ok(arm, rep):
    return f"CAST('0x' || substr(sha1('{arm}{rep}:' || doc_id), 1, 8) AS BIGINT) % 4 > 0"


REPS = "reps AS (SELECT doc_id, lang, " + ", ".join(f"{sql_ok(a, r)} AS {a}{r}" for a in ("control", "arm") for r in (1, 2)) + " FROM documents)"


def reps(spark, d):
    return T(spark, d, "documents").select("doc_id", "lang", *[(tx.hash_share(f"{a}{r}", F.col("doc_id")) % 4 > 0).alias(f"{a}{r}") for a in ("control", "arm") for r in (1, 2)])


@query("triage_stability", f"""WITH {REPS} SELECT lang, count(*) FILTER (WHERE arm1 AND arm2 AND NOT control1 AND NOT control2) AS recovered, count(*) FILTER (WHERE control1 AND control2 AND NOT arm1 AND NOT arm2) AS broke,
count(*) FILTER (WHERE arm1 AND arm2 AND NOT control1 AND NOT control2) - count(*) FILTER (WHERE control1 AND control2 AND NOT arm1 AND NOT arm2) AS net, count(*) FILTER (WHERE arm1 <> arm2) AS unstable, count(*) FILTER (WHERE arm1 AND arm2) AS all_right FROM reps GROUP BY lang""")
def triage_stability(spark, d):
    c = F.col
    recovered = F.count_if(c("arm1") & c("arm2") & ~c("control1") & ~c("control2"))
    broke = F.count_if(c("control1") & c("control2") & ~c("arm1") & ~c("arm2"))
    return reps(spark, d).groupBy("lang").agg(recovered.alias("recovered"), broke.alias("broke"), (recovered - broke).alias("net"), F.count_if(c("arm1") != c("arm2")).alias("unstable"), F.count_if(c("arm1") & c("arm2")).alias("all_right"))


@query("aa_noise", f"WITH {REPS}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE arm1 AND NOT arm2) AS lost, count(*) FILTER (WHERE arm2 AND NOT arm1) AS won FROM reps) SELECT n, lost, won, round((lost + won) / n, 9) AS flips, round({MCNEMAR.format(b='lost', c='won')}, 6) AS p FROM t")
def aa_noise(spark, d):
    t = reps(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("arm1") & ~F.col("arm2")).alias("lost"), F.count_if(F.col("arm2") & ~F.col("arm1")).alias("won"))
    return t.select("*", F.round((F.col("lost") + F.col("won")) / F.col("n"), 9).alias("flips"), F.round(stats.mcnemar(F.col("lost"), F.col("won")), 6).alias("p"))


@query("median_by_node", "SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY event_type")
def median_by_node(spark, d):
    return T(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"))


@query("label_distribution", "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY lang")
def label_distribution(spark, d):
    docs = T(spark, d, "documents")
    total = docs.count()
    return docs.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / total, 9))


# Structure.
SQL_LINES = "l AS (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"
SQL_WORDS = "len(list_filter(regexp_split_to_array(trim({x}), '[ \\t]+'), lambda w: w <> ''))"
SQL_HEADS = f"""{SQL_LINES}, nx AS (SELECT *, first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_line FROM l),
h AS (SELECT *, coalesce(regexp_matches(trim(line), '{structure.HEADING}') AND {SQL_WORDS.format(x='line')} <= 6 AND {SQL_WORDS.format(x='next_line')} > 6, false) AS is_heading FROM nx)"""


def doc_lines(spark, d):
    return structure.lines(doc_texts(spark, d))


@query("lines_posexplode", f"WITH {SQL_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE trim(line) <> '') AS n_filled, max(length(line))::BIGINT AS longest FROM l GROUP BY doc_id")
def lines_posexplode(spark, d):
    return doc_lines(spark, d).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") != "").alias("n_filled"), F.max(F.length("line")).cast("long").alias("longest"))


@query("headings", f"WITH {SQL_HEADS} SELECT doc_id, pos::INT AS pos, line FROM h WHERE is_heading")
def headings(spark, d):
    return structure.headings(doc_lines(spark, d)).filter("is_heading").select(F.col("id").alias("doc_id"), "pos", "line")


@query("parent_islands", f"WITH {SQL_HEADS}, i AS (SELECT doc_id, line, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM h) SELECT doc_id, island::BIGINT AS island, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM i GROUP BY 1, 2")
def parent_islands(spark, d):
    h = structure.islands(structure.headings(doc_lines(spark, d)), "id", "pos", "is_heading")
    return h.groupBy(F.col("id").alias("doc_id"), "island").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("sample_uniform", f"WITH {SQL_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM l), s AS (SELECT *, least(length(line), 700) AS chars FROM n WHERE i % greatest(1, n // 12) = 0 AND i // greatest(1, n // 12) < 12), b AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s) SELECT doc_id, count(*) AS n_taken, sum(chars)::BIGINT AS chars FROM b WHERE upto <= 6000 GROUP BY doc_id")
def sample_uniform(spark, d):
    w = Window.partitionBy("id")
    n = doc_lines(spark, d).withColumn("n", F.count("*").over(w)).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / 12)))
    s = n.filter((F.col("pos") % F.col("step") == 0) & (F.floor(F.col("pos") / F.col("step")) < 12)).withColumn("chars", F.least(F.length("line"), F.lit(700)))
    s = s.withColumn("upto", F.sum("chars").over(w.orderBy("pos"))).filter("upto <= 6000")
    return s.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_taken"), F.sum("chars").alias("chars"))


@query("chunk_ids", "SELECT doc_id, substr(sha1(lang || '|' || source || chr(10) || text), 1, 12) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    return T(spark, d, "documents").select("doc_id", tx.chunk_id(F.array("lang", "source"), F.col("text")).alias("chunk_id"))


@query("monotonicity", "WITH s AS (SELECT conv_id, CASE WHEN length(text) >= lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1.0 WHEN lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL THEN 0.0 END AS up FROM conversations) SELECT conv_id, count(*) AS n, round(CASE WHEN count(*) < 3 THEN 0.0 ELSE avg(up) END, 9) AS share FROM s GROUP BY conv_id")
def monotonicity(spark, d):
    return structure.monotonicity(T(spark, d, "conversations").withColumn("chars", F.length("text")), "conv_id", "turn", "chars")


@query("lost_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lost_documents(spark, d):
    return T(spark, d, "documents").select("doc_id").join(T(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("answer_quality", "SELECT count(d.doc_id) AS expected, count(l.doc_id) AS answered, count(d.doc_id) FILTER (WHERE l.doc_id IS NULL) AS missing, count(l.doc_id) FILTER (WHERE d.doc_id IS NULL) AS extra FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def answer_quality(spark, d):
    docs = T(spark, d, "documents").select(F.col("doc_id").alias("x"), F.lit(1).alias("d"))
    both = docs.join(T(spark, d, "labels").select(F.col("doc_id").alias("y")).distinct(), F.expr("x = y"), "full")
    return both.agg(F.count("x").alias("expected"), F.count("y").alias("answered"), F.count_if(F.col("y").isNull()).alias("missing"), F.count_if(F.col("x").isNull()).alias("extra"))


@query("asof_rate", "SELECT l_orderkey, l_linenumber, max(o_orderdate) AS o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderdate <= l_shipdate GROUP BY 1, 2")
def asof_rate(spark, d):
    marks = T(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(marks, "l_orderkey").filter("o_orderdate <= l_shipdate")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("o_orderdate").alias("o_orderdate"))


from loam import chunk_queries, corpus_queries, derived_queries, flow_queries, index_queries, report_queries, rule_queries, table_queries  # noqa: E402, F401  their queries register themselves
