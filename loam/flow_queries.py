"""Queries of the flows: every variant over all documents with stand-ins for the models, and the SQL of those that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.plans import flow
from loam.registry import TOKENS, T, folded, literal, query, text_index, values

c = F.col

#: The questions are the benchmark's items: a quarter names a norm, a quarter has an assertion of its own.
ASKED = """CASE item_id % 4 WHEN 1 THEN concat('estatuto ', text) WHEN 3 THEN concat(text, chr(10), chr(10), 'Assertiva: ', substr(text, 1, 80)) ELSE text END"""


def questions(spark, d):
    return T(spark, d, "benchmark").select(c("item_id").alias("qid"), F.expr(ASKED).alias("text"))


def sql_bm25(p: str, docs: str, asked: str) -> str:
    """CTEs, names prefixed by p, that rank all rows of ``docs`` (id, text) for ``asked`` (qid, text): the last is {p}b."""
    return f"""{p}w AS (SELECT id, {TOKENS} AS w FROM {docs}), {p}n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM {p}w),
{p}df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM {p}w) GROUP BY term),
{p}i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM {p}df, {p}n), {p}idf AS (SELECT term, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM {p}i0) ELSE idf0 END AS idf FROM {p}i0),
{p}q AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({TOKENS}) AS term FROM {asked}) GROUP BY ALL),
{p}tf AS (SELECT id, term, count(*) AS tf, min(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM {p}w) GROUP BY id, term),
{p}sc AS (SELECT qid, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {p}tf JOIN {p}idf USING (term) JOIN {p}q USING (term), {p}n GROUP BY qid, id),
{p}b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {p}sc WHERE score > 0)"""


def sql_dense(p: str, docs: str, asked: str) -> str:
    """The same by vectors: how often words begin with each letter, at length 1."""
    sides = [(f"{p}d", "id", docs), (f"{p}a", "qid", asked)]
    sides = [f"""{x}0 AS (SELECT {key}, substr(term, 1, 1) AS b, count(*)::DOUBLE AS x FROM (SELECT {key}, unnest({TOKENS}) AS term FROM {rows}) WHERE substr(term, 1, 1) BETWEEN 'a' AND 'z' AND ascii(term) BETWEEN 97 AND 122 GROUP BY ALL),
{x} AS (SELECT {key}, b, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {x}0)""" for x, key, rows in sides]
    return f"""{', '.join(sides)}, {p}b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(sum(d.x * a.x), 6) AS score FROM {p}d d JOIN {p}a a USING (b) GROUP BY qid, id) WHERE score > 0)"""


def sql_hybrid(p: str, docs: str, asked: str, k: int) -> str:
    return f"""{sql_bm25(p + 't', docs, asked)}, {sql_dense(p + 'v', docs, asked)}, {p}u AS (SELECT * FROM {p}tb WHERE rank <= {k} UNION ALL SELECT * FROM {p}vb WHERE rank <= {k}),
{p}b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM {p}u GROUP BY qid, id) QUALIFY rank <= {k})"""


#: Stand-ins: a model that rewords, and how much of a question its context must hold to be on its topic, or to suffice.
WORDS, ON_TOPIC, SUFFICES = {"und": "and", "que": "that", "les": "the"}, 0.8, 0.9
FORMULAS = [(1, "Média", "the that", "a + b", "of"), (2, "Soma", "una", "a - b", "dans")]

_REWORDED = f"array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda x: CASE x {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in WORDS.items())} ELSE x END), '')"
_REWORDED = f"substr(trim(regexp_replace({_REWORDED}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 400)"
_BASE = f"""WITH asked AS (SELECT item_id AS qid, {ASKED} AS text, item_id % 4 = 1 AS norm FROM benchmark),
focused AS (SELECT qid, CASE WHEN contains(text, 'Assertiva:') THEN trim(string_split(text, 'Assertiva:')[2]) ELSE text END AS text, norm FROM asked),
reworded AS (SELECT qid, {_REWORDED} AS text, norm FROM asked),
dd AS (SELECT doc_id AS id, text, CASE WHEN lang = 'en' THEN 'book' ELSE 'norms' END AS source, doc_id - doc_id % 3 AS parent FROM documents),
book AS (SELECT id, text FROM dd WHERE source = 'book'), norms AS (SELECT id, text FROM dd WHERE source = 'norms'), """


def _end(sketch: list[str]) -> str:
    """The answers, given ``picked`` (qid, id) and, in some flows, ``support`` (qid, chars, to be added to the prompt's)."""
    support = " LEFT JOIN support USING (qid)" if "formula" in sketch else ""
    return f"""SELECT qid, coalesce(n, 0) AS n_context, CASE WHEN (length(text) + coalesce(chars + n + 1, 0){' + coalesce(added, 0)' if support else ''}) % 2 = 1 THEN 'V' ELSE 'F' END AS answer, '{'>'.join(sketch)}' AS trace
FROM asked LEFT JOIN (SELECT qid, count(*) AS n, sum(length(dd.text)) AS chars FROM picked JOIN dd USING (id) GROUP BY qid) USING (qid){support}"""


def _overlap(question: str, text: str) -> str:
    q, t = (f"list_distinct({TOKENS.replace('text', x)})" for x in (question, text))
    return f"round(len(list_intersect({q}, {t})) / greatest(len({q}), 1), 6)"


def _rerank(p: str, source: str, asked: str = "asked") -> str:
    return f"""{p}r AS (SELECT c.qid, c.id, c.source, {_overlap('a.text', 'dd.text')} AS score FROM {source} c JOIN {asked} a USING (qid) JOIN dd USING (id)),
{p} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {p}r QUALIFY rank <= 8)"""


def _turns(ranked: str) -> str:
    return f"""turned AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank, id) AS turn FROM {ranked}),
picked AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, source DESC, id) AS slot FROM turned) WHERE slot <= 8)"""


def _gated(least: float, picked: str, name: str) -> str:
    """Of ``picked``, the rows of questions whose whole context holds this share of their words."""
    return f"""{name}c AS (SELECT qid, string_agg(dd.text, chr(10)) AS context FROM {picked} JOIN dd USING (id) GROUP BY qid),
{name}q AS (SELECT qid FROM {name}c JOIN asked a USING (qid) WHERE {_overlap('a.text', 'context')} >= {least}), {name} AS (SELECT qid, id FROM {picked} WHERE qid IN (SELECT qid FROM {name}q))"""


def _parents(chosen: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT qid, parent AS id FROM {chosen} JOIN dd USING (id))"


def _quota(asked: str) -> str:
    return f"""{sql_dense('k', 'book', asked)}, {sql_dense('m', 'norms', asked)}, quota AS (SELECT qid, id, rank, 'norms' AS source FROM mb JOIN asked USING (qid) WHERE norm AND rank <= 10
UNION ALL SELECT qid, id, rank, 'book' FROM kb JOIN asked USING (qid) WHERE rank <= CASE WHEN norm THEN 10 ELSE 20 END)"""


def _reranked(asked: str, name: str) -> str:
    """Hybrid search, the best by the scorer, and their parents."""
    return f"{sql_hybrid('h', 'dd', asked, 20)}, found AS (SELECT qid, id, 'all' AS source FROM hb), {_rerank('top', 'found', asked)}, {_parents('top', name)}"


_FIRST8 = f"{sql_dense('g', 'dd', 'ASKED')}, NAME AS (SELECT qid, id FROM gb WHERE rank <= 8)"
_ROUTED = f"""{sql_dense('k', 'book', 'asked')}, {sql_dense('m', 'norms', 'asked')}, picked AS (SELECT qid, id FROM kb JOIN asked USING (qid) WHERE NOT norm AND rank <= 8 UNION ALL SELECT qid, id FROM mb JOIN asked USING (qid) WHERE norm AND rank <= 8)"""
_WALK = f"""{sql_bm25('g', 'dd', 'asked')}, deep AS (SELECT gb.*, source, text, first_value(source) OVER (PARTITION BY qid ORDER BY rank) AS home FROM gb JOIN dd USING (id) WHERE rank <= 16),
walk AS (SELECT *, CASE WHEN rank <= 4 THEN 1 WHEN source = home THEN ceil(rank / 4.0) END AS round FROM deep), kept AS (SELECT * FROM walk WHERE round IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 8),
read AS (SELECT qid, r, string_agg(text, chr(10)) AS context FROM kept JOIN range(1, 4) t(r) ON round <= r GROUP BY qid, r),
stop AS (SELECT qid, coalesce(min(r) FILTER (WHERE {_overlap('a.text', 'context')} >= {SUFFICES}), 4) AS stop FROM read JOIN asked a USING (qid) GROUP BY qid), picked AS (SELECT qid, id FROM kept JOIN stop USING (qid) WHERE round <= stop)"""
_FORMULAS = """f AS (SELECT * FROM (VALUES (1, 'media', 3, 12), (1, 'that', 3, 12), (2, 'soma', 3, 11), (2, 'una', 3, 11), (2, 'dans', 1, 11)) v(fid, term, points, chars)),
support AS (SELECT qid, sum(chars) + 2 * count(*) AS added FROM (SELECT DISTINCT qid, fid, chars FROM asked JOIN f ON contains(' ' || """ + folded("text") + """ || ' ', ' ' || term || ' ')) GROUP BY qid)"""
SQL = {
    "v0": "picked AS (SELECT 0 AS qid, 0 AS id WHERE false)",
    "v1": _FIRST8.replace("ASKED", "asked").replace("NAME", "picked"),
    "v2": _reranked("asked", "picked"),
    "v3": _reranked("reworded", "picked"),
    "v4": f"""{_reranked('reworded', 'once')}, {_gated(SUFFICES, 'once', 'enough')}, {sql_hybrid('z', 'dd', 'asked', 40)}, deeper AS (SELECT qid, id, 'all' AS source FROM zb WHERE qid NOT IN (SELECT qid FROM enough)),
{_rerank('best', 'deeper')}, {_parents('best', 'twice')}, picked AS (SELECT * FROM enough UNION ALL SELECT * FROM twice)""",
    "v5": f"{_reranked('asked', 'once')}, {_gated(ON_TOPIC, 'once', 'picked')}",
    "v6": f"{_FIRST8.replace('ASKED', 'asked').replace('NAME', 'once')}, {_gated(ON_TOPIC, 'once', 'picked')}",
    "v7": f"{_FIRST8.replace('ASKED', 'reworded').replace('NAME', 'once')}, {_gated(ON_TOPIC, 'once', 'picked')}",
    "v8": _ROUTED,
    "v9": f"{_ROUTED}, {_FORMULAS}",
    "v10": f"{_quota('asked')}, {_turns('quota')}",
    "v11": f"{_quota('asked')}, {_rerank('top', 'quota')}, {_turns('top')}",
    "v12": f"{_quota('asked')}, {_turns('quota').replace('picked AS', 'once AS')}, {_parents('once', 'picked')}",
    "v13": f"{_quota('focused')}, {_turns('quota')}",
    "v14": _WALK,
    "v15": f"{sql_dense('k', 'book', 'reworded')}, picked AS (SELECT qid, id FROM kb WHERE rank <= 8)",
    "v16": _WALK,
}


def _variant(name: str):
    def run(spark, d):
        docs = T(spark, d, "documents").select(c("doc_id").alias("id"), "text", F.when(c("lang") == "en", "book").otherwise("norms").alias("source"), (c("doc_id") - c("doc_id") % 3).alias("parent"))
        formulas = values(spark, FORMULAS, "id long, name string, synonyms string, expression string, notes string")
        options = flow.Options(searcher=flow.searcher_of(name, text_index(spark, d) if name in flow.WORD_SEARCH else None), reword=flow.glossary(WORDS), on_topic=flow.covers(ON_TOPIC), suffices=flow.covers(SUFFICES), formulas=formulas)
        return flow.run_flow(questions(spark, d), docs, flow.VARIANTS[name], options)

    return run


for _name, _stages in flow.VARIANTS.items():
    query(f"flow_{_name}", _BASE + SQL[_name] + " " + _end(_stages))(_variant(_name))
