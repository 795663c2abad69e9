"""Queries of rules and structures on rows that both engines derive from the tables by the same expressions: exams, norms, layouts, replies.

The tables have no such shapes, so that each input is a table's rows with planted ones: words made of digests of a row's text, numerals and
marks by its id. What is expected follows from how the input was made, or from windows over it in SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import rules
from loam.functions import text as tx
from loam.operators import search, structure
from loam.plans import flow
from loam.registry import SQL_LINES, T, doc_lines, folded, query
from loam.sources import io

c = F.col


def derived(spark, d, table: str, *columns: str, where: str = "true"):
    """Rows of a table by expressions that read the same in both engines."""
    return T(spark, d, table).filter(where).selectExpr(*columns)


def sql(table: str, *columns: str, where: str = "true") -> str:
    return f"(SELECT {', '.join(columns)} FROM {table} WHERE {where})"


def word(k: str, of: str = "text", n: int = 8) -> str:
    """A word of n letters from a to q but l that the text decides."""
    return f"translate(substr(sha1(concat({of}, '{k}')), 1, {n}), '0123456789', 'ghijkmnopq')"


def part(x: str, by: int) -> str:
    return f"CAST(floor({x} / {by}.0) AS BIGINT)"


HAS = "text IS NOT NULL"
NL = "chr(10)"
A, B, C, D = (word(k) for k in "ABCD")


# Structures over conversations: a turn is a page.
@query("merge_small", """WITH s AS (SELECT conv_id, turn, CASE WHEN row_number() OVER w = 1 OR length(text) >= 80 OR turn // 3 IS DISTINCT FROM lag(turn // 3) OVER w THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS book, turn AS pos, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM s""")
def merge_small(spark, d):
    rows = derived(spark, d, "conversations", "conv_id AS book", "turn AS pos", f"{part('turn', 3)} AS chapter", "length(text) AS chars")
    return structure.merge_small(rows, 80).select("book", "pos", "island")


_MARKS = ("conv_id AS book", "turn AS page", "CASE WHEN turn % 4 = 0 THEN concat('S', turn) END AS section", "CASE WHEN turn % 4 IN (1, 3) THEN concat('C', turn) END AS chapter")


@query("outline_tree", f"""WITH m AS {sql('conversations', *_MARKS)}, s AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY book ORDER BY page) AS sec FROM m)
SELECT book, page, sec AS section, last_value(chapter IGNORE NULLS) OVER (PARTITION BY book, sec ORDER BY page) AS chapter FROM s""")
def outline_tree(spark, d):
    """A section holds until the next one, a chapter until the next chapter or section."""
    sections = structure.carried(derived(spark, d, "conversations", *_MARKS), "book", "page", "section", "sec")
    held = F.last("chapter", ignorenulls=True).over(Window.partitionBy("book", "sec").orderBy("page"))
    return sections.withColumn("chapter", held).select("book", "page", c("sec").alias("section"), "chapter")


@query("carry_header", "SELECT conv_id AS book, turn AS page, last_value(CASE WHEN turn % 3 = 1 THEN concat(role, turn) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS chapter FROM conversations")
def carry_header(spark, d):
    rows = derived(spark, d, "conversations", "conv_id AS book", "turn AS page", "CASE WHEN turn % 3 = 1 THEN concat(role, turn) END AS head")
    return structure.carried(rows, "book", "page", "head", "chapter").select("book", "page", "chapter")


_RANGE = ("conv_id AS book", "concat('c', turn) AS chunk", "turn AS first", "CASE WHEN turn % 2 = 0 THEN turn + 2 END AS last")


@query("join_page_range", f"WITH r AS {sql('conversations', *_RANGE)} SELECT r.book, turn AS page, chunk FROM conversations JOIN r ON book = conv_id AND first <= turn AND turn <= coalesce(last, first)")
def join_page_range(spark, d):
    return structure.pages_in_ranges(derived(spark, d, "conversations", "conv_id AS book", "turn AS page"), derived(spark, d, "conversations", *_RANGE), 4)


@query("pos_to_page", f"WITH {SQL_LINES}, u AS (SELECT doc_id, pos AS page, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l), p AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS pos FROM documents) SELECT doc_id AS id, pos, min(page) AS page FROM p JOIN u USING (doc_id) WHERE upto > pos GROUP BY doc_id, pos")
def pos_to_page(spark, d):
    """Every five hundredth character's line."""
    pages = doc_lines(spark, d).select("id", c("pos").alias("page"), (F.length("line") + 1).alias("chars"))
    at = T(spark, d, "documents").filter(F.length("text") > 0).select(c("doc_id").alias("id"), F.explode(F.expr("sequence(0L, cast(length(text) - 1 as long), 500L)")).alias("pos"))
    return structure.pos_to_page(at, pages, 1024)


# A layout of all documents' lines: every seventh runs over the page, others stand left and right by turns.
_BOX = [("CASE WHEN pos % 7 = 3 THEN 60.0 WHEN pos % 2 = 0 THEN 60.0 ELSE 360.0 END", "x0"), ("CASE WHEN pos % 7 = 3 THEN 640.0 WHEN pos % 2 = 0 THEN 300.0 ELSE 640.0 END", "x1"), ("100.0 + 10.0 * (pos - pos % 2)", "y"), ("CASE WHEN pos % 9 = 4 THEN 15.0 ELSE 10.0 + pos % 3 END", "height")]
_LAYOUT = f"{SQL_LINES}, b AS (SELECT doc_id AS page, pos, line, {', '.join(f'({e})::DOUBLE AS {n}' for e, n in _BOX)} FROM l)"


def layout(spark, d):
    return doc_lines(spark, d).selectExpr("id AS page", "pos", "line", *[f"CAST({e} AS DOUBLE) AS {n}" for e, n in _BOX])


@query("column_bands", f"""WITH {_LAYOUT}, f AS (SELECT *, (x0 < 352 AND x1 > 500)::INT AS wide FROM b), g AS (SELECT *, sum(wide) OVER (PARTITION BY page ORDER BY y, x0) AS band FROM f)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY band, wide DESC, CASE WHEN wide = 1 THEN 0 ELSE (x0 >= 352)::INT END, y, x0) AS pos, sha1(line) AS line FROM g""")
def column_bands(spark, d):
    return structure.column_order(layout(spark, d)).select("page", "pos", F.sha1("line").alias("line"))


@query("tall_lines", f"WITH {_LAYOUT}, m AS (SELECT *, median(height) OVER (PARTITION BY page) AS middle FROM b) SELECT page, pos, sha1(line) AS line FROM m WHERE height >= CASE WHEN middle = 0 THEN 20.0 ELSE 1.35 * middle END AND len(list_filter(regexp_split_to_array(trim(line), '[ \\t]+'), lambda w: w <> '')) <= 12")
def tall_lines(spark, d):
    return structure.tall_lines(layout(spark, d)).select("page", "pos", F.sha1("line").alias("line"))


@query("scan_bbox_xml", f"WITH {SQL_LINES} SELECT doc_id AS page, pos, w.i - 1 AS nth, sha1(w.w) AS word, (60 + 10 * (w.i - 1))::DOUBLE AS x0, (10 * pos)::DOUBLE AS y0 FROM (SELECT doc_id, pos, unnest(list_transform(list_filter(regexp_split_to_array(line, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x, i: {{'w': x, 'i': i}})) AS w FROM l)")
def scan_bbox_xml(spark, d):
    """All lines written as layout XML, a page a row, and read back as words with their boxes."""
    words = F.filter(F.split("line", "[^A-Za-z0-9]+"), lambda x: x != "")
    word_xml = F.transform(words, lambda x, i: F.concat(F.lit('<word xMin="'), (60 + 10 * i).cast("double"), F.lit('" yMin="'), (10 * F.col("pos")).cast("double"), F.lit('">'), x, F.lit("</word>")))
    line_xml = F.concat(F.lit('<line xMin="60" yMin="'), (10 * c("pos")).cast("double"), F.lit('">'), F.array_join(word_xml, ""), F.lit("</line>"))
    rows = doc_lines(spark, d).withColumn("xml", line_xml).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "xml"))).alias("x"))
    pages = rows.select("id", F.concat(F.lit("<page>"), F.array_join(F.transform("x", lambda r: r["xml"]), ""), F.lit("</page>")).alias("xml"))
    return io.layout_words(pages).select(c("id").alias("page"), "pos", "nth", F.sha1("word").alias("word"), "x0", "y0")


# Norms: lines of documents, some of which begin an article, an annex or a chapter.
_NORM = [(5, 1, "Art. "), (11, 7, "ANEXO "), (6, 0, "CAPITULO ")]
_NORM_LINE = "CASE WHEN doc_id % 4 <> 3 AND i % 5 = 2 THEN concat('Art. ', i, ' - ', x) WHEN i % 11 = 7 THEN concat('Anexo ', i, ' ', x) WHEN i % 6 = 4 THEN concat('CAPITULO ', i, ' ', substr(x, 1, 90)) ELSE x END"


@query("split_articles", f"""WITH {SQL_LINES}, n AS (SELECT doc_id, pos, {_NORM_LINE.replace('i ', 'pos ').replace('i,', 'pos,').replace(' x', ' line').replace('(x,', '(line,')} AS line FROM l),
m AS (SELECT *, nullif(regexp_extract(line, '{structure.ARTICLE}', 1), '') AS article, upper(nullif(regexp_extract(line, '{structure.ANNEX}', 1), '')) AS annex, CASE WHEN regexp_matches(line, '{structure.CHAPTER}') THEN substr(trim(regexp_replace(line, '[ \\t]+', ' ', 'g')), 1, 70) END AS here FROM n),
g AS (SELECT *, sum((article IS NOT NULL OR annex IS NOT NULL)::INT) OVER w AS part, last_value(here IGNORE NULLS) OVER w AS chapter FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT doc_id, part, arg_min(article, pos) AS article, arg_min(annex, pos) AS annex, first(chapter ORDER BY pos) AS chapter, string_agg(line, chr(10) ORDER BY pos) AS raw FROM g GROUP BY doc_id, part),
q AS (SELECT *, count(article) OVER (PARTITION BY doc_id) AS articles, regexp_replace(raw, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS body FROM p)
SELECT doc_id AS id, part::BIGINT AS pos, CASE WHEN part = 0 THEN 'preamble' WHEN article IS NOT NULL THEN 'article' ELSE 'annex' END AS kind, coalesce('Art. ' || article, annex) AS label, CASE WHEN part > 0 THEN chapter END AS chapter, sha1(body) AS body FROM q WHERE articles > 0 AND CASE WHEN part = 0 THEN length(raw) >= 200 ELSE length(body) > 25 END
UNION ALL SELECT doc_id, 0, 'whole', NULL, NULL, sha1(b) FROM (SELECT doc_id, regexp_replace(string_agg(raw, chr(10) ORDER BY part), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS b FROM q WHERE articles = 0 GROUP BY doc_id) WHERE b <> ''""")
def split_articles(spark, d):
    """Three of four documents have articles; the fourth annexes and chapters only."""
    norm = F.expr(f"array_join(transform(split(text, '\\n'), (x, i) -> {_NORM_LINE}), '\\n')")
    docs = T(spark, d, "documents").filter(HAS).select(c("doc_id").alias("id"), norm.alias("text"))
    return structure.split_articles(docs).withColumn("body", F.sha1("body"))


@query("scan_pdf_text", "SELECT doc_id AS id, unnest(range(0, len(a)))::INT AS page, sha1(unnest(a)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)")
def scan_pdf_text(spark, d):
    """Form feeds end pages."""
    return io.pages_of_text(derived(spark, d, "documents", "doc_id AS id", f"translate(text, {NL}, chr(12)) AS text")).withColumn("text", F.sha1("text"))


_READ = ["'Art. 1 - a'", "CASE WHEN doc_id % 2 = 0 THEN 'Art. 3 - c' ELSE 'Art. 2 - b' END", "CASE WHEN doc_id % 2 = 0 THEN 'Art. 2 - b' ELSE 'Art. 3 - c' END", "CASE WHEN doc_id % 3 = 0 THEN 'no article' ELSE 'Art. 4 - d' END"]


@query("scan_pdf_best", f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'layout' END AS best FROM documents WHERE {HAS}")
def scan_pdf_best(spark, d):
    """Of two readings the one whose articles rise more often; of equal ones the layout."""
    layout_text = f", {NL}, ".join(_READ)
    raw = f", {NL}, ".join(["'Art. 1 - a'", "'Art. 2 - b'", "'Art. 3 - c'", _READ[3]])
    rows = derived(spark, d, "documents", "doc_id AS id", f"concat({layout_text}, {NL}, {A}) AS layout", f"concat({raw}, {NL}, {A}) AS raw", where=HAS)
    return rows.select("id", structure.better_reading(c("layout"), c("raw")).alias("best"))


# Exams: five benchmark items a sheet.
_EXAM, _NUMBER = part("item_id", 5), "item_id % 5 + 1"
_Q = {k: word(k) for k in "STUVWXYZ"}
_ANSWER = "substr('ABCDE', CAST(item_id % 5 + 1 AS INT), 1)"
_MCQ = f"""concat({_NUMBER}, ') ', {_Q['S']}, ' ', {_Q['T']}, {NL}, '   ', {_Q['U']}, {NL}, 'A) ', {_Q['V']}, {NL}, '  ', {_Q['W']}, {NL}, 'b. ', {_Q['X']}, {NL}, CASE WHEN item_id % 7 = 5 THEN '' ELSE concat('C) ', {_Q['Y']}, {NL}) END,
'D) ', {_Q['Z']}, {NL}, CASE WHEN item_id % 7 = 3 THEN concat('QUESTÃO  ANULADA', {NL}) ELSE '' END, 'E) ', {_Q['S']}, {NL}, CASE WHEN item_id % 11 = 4 THEN '' ELSE concat('Resposta: ', {_ANSWER}, {NL}, 'A comment after it') END)"""


def exams(spark, d, block: str):
    """(exam, text): the blocks of an exam's items, one after another."""
    rows = derived(spark, d, "benchmark", f"{_EXAM} AS exam", f"{_NUMBER} AS n", f"{block} AS block", where=HAS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n")
    return rows.groupBy("exam").agg(F.concat(F.lit("PROVA NACIONAL 2019\n\n12\n"), joined).alias("text"))


@query("parse_mcq", f"""SELECT {_EXAM} AS exam, ({_NUMBER})::INT AS number, concat({_Q['S']}, ' ', {_Q['T']}, ' ', {_Q['U']}) AS stem, concat({_Q['V']}, ' ', {_Q['W']}) AS a, {_Q['X']} AS b, {_Q['Y']} AS c, {_Q['Z']} AS d, {_ANSWER} AS answer
FROM benchmark WHERE {HAS} AND item_id % 7 NOT IN (3, 5) AND item_id % 11 <> 4""")
def parse_mcq(spark, d):
    """Annulled items, those without an alternative and those without an answer aren't questions."""
    return structure.parse_mcq(exams(spark, d, _MCQ))


_SAID = [f"CASE WHEN (item_id + {k}) % 2 = 0 THEN 'Verdadeiro' ELSE 'Falso' END" for k in range(4)]
_VF = f"""concat({_NUMBER}, ' - ', {_Q['S']}, {NL}, {_Q['T']}, {NL}, 'Questões:   Resposta:', {NL}, 'a) ', {_Q['U']}, '   ', {_SAID[0]}, {NL}, 'B) ', {_Q['V']}, ' ', lower({_SAID[1]}), {NL}, '   ', {_Q['W']}, {NL},
CASE WHEN item_id % 3 = 0 THEN concat({_Q['X']}, {NL}, 'C)      ', {_SAID[2]}, {NL}, {_Q['Y']}) ELSE concat('C) ', {_Q['X']}, ' ', {_Q['Y']}, CASE WHEN item_id % 3 = 1 THEN concat(' ', {_SAID[2]}) ELSE '' END) END, {NL}, 'D) ', {_Q['Z']}, ' - V ', {_SAID[3]})"""


def _claims(letter: str, claim: str, k: int, where: str = HAS) -> str:
    return f"SELECT {_EXAM} AS exam, ({_NUMBER})::INT AS number, '{letter}' AS letter, concat({_Q['S']}, ' ', {_Q['T']}) AS stem, {claim} AS claim, CASE WHEN (item_id + {k}) % 2 = 0 THEN 'V' ELSE 'F' END AS answer FROM benchmark WHERE {where}"


@query("parse_vf", " UNION ALL ".join([_claims("A", _Q["U"], 0), _claims("B", f"concat({_Q['V']}, ' ', {_Q['W']})", 1), _claims("C", f"concat({_Q['X']}, ' ', {_Q['Y']})", 2, f"{HAS} AND item_id % 3 <> 2"), _claims("D", _Q["Z"], 3)]))
def parse_vf(spark, d):
    """A third of the cells are centred, with their first line above the letter; a third of the claims C have no verdict."""
    return structure.parse_vf(exams(spark, d, _VF))


@query("answer_sheet", "SELECT conv_id AS sheet, concat('q', lpad((turn % 3 + 1)::VARCHAR, 4, '0')) AS qid, arg_max(substr('VFABCD', (conv_id + turn) % 6 + 1, 1), turn) AS letter FROM conversations GROUP BY conv_id, turn % 3")
def answer_sheet(spark, d):
    """The last mention of a question wins."""
    line = "concat(CASE WHEN turn % 2 = 0 THEN 'q' ELSE 'nota, Q000' END, turn % 3 + 1, CASE WHEN turn % 2 = 0 THEN ': ' ELSE ' - ' END, lower(substr('VFABCD', CAST((conv_id + turn) % 6 + 1 AS INT), 1))) AS line"
    rows = derived(spark, d, "conversations", "conv_id AS sheet", "turn", line)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return structure.answer_sheet(rows.groupBy("sheet").agg(joined.alias("text")))


@query("scan_key", "SELECT conv_id AS sheet, concat('q', turn) AS question, substr('VF', (conv_id + turn) % 2 + 1, 1) AS letter FROM conversations")
def scan_key(spark, d):
    rows = derived(spark, d, "conversations", "conv_id AS sheet", "concat('q', turn) AS q", "substr('VF', CAST((conv_id + turn) % 2 + 1 AS INT), 1) AS a").groupBy("sheet")
    raw = rows.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("q", "a"))).alias("gabarito"))).alias("raw"))
    return io.answer_key(raw).select("sheet", "question", "letter")


@query("build_question", f"SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN concat({A}, {NL}, {B}) ELSE concat({A}, {NL}, 'A) ', {B}, {NL}, 'B) ', {C}) END AS question FROM benchmark WHERE {HAS}")
def build_question(spark, d):
    rows = derived(spark, d, "benchmark", "item_id AS id", f"{A} AS stem", f"CASE WHEN item_id % 2 = 0 THEN {B} END AS claim", f"CASE WHEN item_id % 2 = 1 THEN map('B', {C}, 'A', {B}) END AS alts", where=HAS)
    return rows.select("id", structure.question_text(c("stem"), c("claim"), c("alts")).alias("question"))


@query("valid_letter", "SELECT doc_id AS id, substr('VFABCDX', doc_id % 7 + 1, 1) AS letter, CASE WHEN (doc_id % 2 = 0 AND doc_id % 7 < 2) OR (doc_id % 2 = 1 AND doc_id % 7 BETWEEN 2 AND 5) THEN 1 ELSE 0 END AS valid FROM documents")
def valid_letter(spark, d):
    rows = derived(spark, d, "documents", "doc_id AS id", "CASE WHEN doc_id % 2 = 0 THEN 'vf' ELSE 'mcq' END AS kind", "concat(' ', lower(substr('VFABCDX', CAST(doc_id % 7 + 1 AS INT), 1)), ') x') AS answer")
    letter = tx.first_letter(c("answer"))
    return rows.select("id", letter.alias("letter"), structure.is_valid_letter(c("kind"), letter).cast("int").alias("valid"))


@query("annulled", f"SELECT doc_id AS id FROM documents WHERE {HAS} AND doc_id % 4 IN (1, 3)")
def annulled(spark, d):
    lead = "CASE doc_id % 4 WHEN 0 THEN 'Questão ANULADA ' WHEN 1 THEN 'A dose ' WHEN 2 THEN 'Leia as INSTRUÇÕES ' ELSE 'A anulada não é a questão ' END"
    return structure.real_questions(derived(spark, d, "documents", "doc_id AS id", f"concat({lead}, {A}) AS text", where=HAS)).select("id")


@query("no_invented_key", f"SELECT doc_id AS id FROM documents WHERE {HAS} AND doc_id % 3 <> 2 AND doc_id % 5 <> 0")
def no_invented_key(spark, d):
    rows = derived(spark, d, "documents", "doc_id AS id", f"concat(CASE doc_id % 3 WHEN 2 THEN 'Verdadeiro ' WHEN 1 THEN 'Falsos ' ELSE '' END, {A}) AS claim", "CASE WHEN doc_id % 5 <> 0 THEN 'V' END AS answer", where=HAS)
    return structure.with_key(rows).select("id")


@query("mcq_complete", f"SELECT doc_id AS id FROM documents WHERE {HAS} AND doc_id % 3 = 0")
def mcq_complete(spark, d):
    rows = derived(spark, d, "documents", "doc_id AS id", f"CASE doc_id % 3 WHEN 0 THEN map('A', {A}, 'B', {B}, 'C', {C}, 'D', {D}) WHEN 1 THEN map('A', {A}, 'B', ' ', 'C', {C}, 'D', {D}) ELSE map('A', {A}, 'B', {B}) END AS alts", where=HAS)
    return rows.filter(structure.is_complete(c("alts"))).select("id")


@query("exam_year", f"SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 2000 + doc_id % 25 WHEN 1 THEN 1990 + doc_id % 9 ELSE 0 END::INT AS year, CASE WHEN doc_id % 2 = 0 THEN 'vf' ELSE 'mcq' END AS format FROM documents WHERE {HAS}")
def exam_year(spark, d):
    name = "CASE WHEN doc_id % 3 = 0 THEN concat(2000 + doc_id % 25, '-05_me1.pdf') ELSE 'prova.pdf' END AS name"
    text = f"concat(CASE WHEN doc_id % 3 = 1 THEN concat('Prova ano ', 1990 + doc_id % 9) ELSE 'Prova' END, {NL}, {A}, {NL}, CASE WHEN doc_id % 2 = 0 THEN 'Verdadeiro Falso' ELSE 'Resposta: B' END) AS text"
    rows = derived(spark, d, "documents", "doc_id AS id", name, text, where=HAS)
    return rows.select("id", rules.exam_year(c("name"), c("text")).alias("year"), rules.exam_format(c("text")).alias("format"))


@query("strip_exam_chrome", f"SELECT doc_id AS id, concat(doc_id % 9, ') ', {A}, {NL}, 'A) ', {B}, CASE WHEN doc_id % 2 = 0 THEN concat({NL}, {C}) ELSE '' END) AS body FROM documents WHERE {HAS}")
def strip_exam_chrome(spark, d):
    text = f"concat('PROVA NACIONAL 2019', {NL}, {NL}, '12', {NL}, doc_id % 9, ') ', {A}, {NL}, 'CCA', {NL}, 'A) ', {B}, {NL}, CASE WHEN doc_id % 2 = 0 THEN concat({C}, {NL}) ELSE '' END, ' Sociedade  Brasileira de Anestesiologia') AS text"
    return derived(spark, d, "documents", "doc_id AS id", text, where=HAS).select("id", rules.exam_body(c("text")).alias("body"))


# Scanned text and names.
_DIGIT = lambda ones, fives, tens: f"'|{ones}|{ones * 2}|{ones * 3}|{ones}{fives}|{fives}|{fives}{ones}|{fives}{ones * 2}|{fives}{ones * 3}|{ones}{tens}'"
_N = "(doc_id % 399 + 1)"
_ROMAN = f"concat(split_part('|C|CC|CCC', '|', CAST({part(_N, 100)} + 1 AS INT)), split_part({_DIGIT('X', 'L', 'C')}, '|', CAST({part(_N, 10)} % 10 + 1 AS INT)), split_part({_DIGIT('I', 'V', 'X')}, '|', CAST({_N} % 10 + 1 AS INT)))"
_SCANNED = f"CASE WHEN doc_id % 2 = 0 THEN {_ROMAN} ELSE translate({_ROMAN}, 'I', '1') END"


@query("roman", f"""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 OR {_N} % 10 IN (0, 5) THEN {_N} ELSE -1 END::INT AS strict,
CASE WHEN doc_id % 2 = 0 OR {_N} <= 3 THEN {_N} ELSE {_N} - {_N} % 10 + CASE WHEN {_N} % 10 BETWEEN 4 AND 8 THEN 5 WHEN {_N} % 10 = 9 THEN 10 ELSE 0 END END::INT AS lenient FROM documents""")
def roman(spark, d):
    """Every second numeral has 1 for I: not a numeral, or, leniently, I where there is nothing else and 0 elsewhere."""
    rows = derived(spark, d, "documents", "doc_id AS id", f"{_SCANNED} AS numeral")
    return rows.select("id", F.coalesce(tx.roman(c("numeral")), F.lit(-1)).alias("strict"), tx.roman(c("numeral"), True).alias("lenient"))


@query("fix_text", f"SELECT doc_id AS id, concat('Isoflurano {{}} ', {A}, ' e ISOFLURANO; insuficiencia, Intubação ', {B}, {B}, ' recuperação') AS fixed FROM documents WHERE {HAS}".replace("{}", "desflurano"))
def fix_text(spark, d):
    text = f"concat('Isotlurano desfturano ', {A}, ' e ISOTLURANO; insuftciencia, lntubação ', {B}, '-', {NL}, {B}, ' recu- peração') AS text"
    return derived(spark, d, "documents", "doc_id AS id", text, where=HAS).select("id", rules.normalise(c("text")).alias("fixed"))


@query("fix_curated", f"SELECT doc_id AS id, concat('Reflexo ', {A}, ' e REFLEXO, anafilático; isoflurano Propofol') AS fixed FROM documents WHERE {HAS}")
def fix_curated(spark, d):
    text = f"concat('Retlexo ', {A}, ' e RETLEXO, anafilatico; isoflu rano Propo  fol') AS text"
    return derived(spark, d, "documents", "doc_id AS id", text, where=HAS).select("id", rules.normalise(c("text")).alias("fixed"))


@query("split_glued", f"SELECT doc_id AS id, concat({A}, ' ', upper({B}), CASE WHEN doc_id % 2 = 0 THEN concat(' ', {C}, ' D', {D}) ELSE '' END) AS name FROM documents WHERE {HAS}")
def split_glued(spark, d):
    name = f"concat({A}, upper({B}), CASE WHEN doc_id % 2 = 0 THEN concat(' ', {C}, 'D', {D}) ELSE '' END) AS name"
    return derived(spark, d, "documents", "doc_id AS id", name, where=HAS).select("id", tx.split_glued(c("name")).alias("name"))


@query("doc_label", f"""SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN concat('CFM ', doc_id, '/2017') WHEN 1 THEN concat('SBA · ', {A}, ' ', {B}) WHEN 2 THEN 'AMB Diretrizes' WHEN 3 THEN 'SBC Diretriz' ELSE {A} END AS label,
CASE doc_id % 5 WHEN 0 THEN concat('Resolução CFM nº ', doc_id, '/2017') WHEN 1 THEN concat('SBA — ', {A}, ' ', {B}) WHEN 2 THEN 'Projeto Diretrizes AMB' WHEN 3 THEN 'Diretriz da Sociedade Brasileira de Cardiologia' ELSE {C} END AS title FROM documents WHERE {HAS}""")
def doc_label(spark, d):
    name = f"CASE doc_id % 5 WHEN 0 THEN concat('CFM-', doc_id, '-2017') WHEN 1 THEN concat('SBA-12_', {A}, '_', {B}) WHEN 2 THEN concat('AMB-', {A}) WHEN 3 THEN concat('SBC-', {A}) ELSE {A} END AS name"
    rows = derived(spark, d, "documents", "doc_id AS id", name, f"concat({NL}, '  ', {C}, ' ', {NL}, {D}) AS page", where=HAS)
    return rows.select("id", rules.document_label(c("name"), c("page")).alias("x")).select("id", "x.label", "x.title")


_UNIT = "CASE doc_id % 5 WHEN 0 THEN 'mg' WHEN 1 THEN 'horas' WHEN 2 THEN '%' WHEN 3 THEN 'mmHg' ELSE 'xyz' END"
_COUNT = "concat(doc_id % 50, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',5' ELSE ',0' END)"


@query("anchor_pattern", f"""SELECT doc_id AS id, concat(CASE doc_id % 3 WHEN 0 THEN (doc_id % 50)::VARCHAR WHEN 1 THEN concat(doc_id % 50, '\\.5') ELSE concat('(?:', doc_id % 50, '\\.0|', doc_id % 50, ')') END,
CASE doc_id % 5 WHEN 0 THEN '\\s*mg' WHEN 1 THEN '\\s*(?:hours?|h\\b)' WHEN 2 THEN '\\s*%' WHEN 3 THEN '\\s*mm\\s?Hg' ELSE '\\b' END) AS pattern FROM documents""")
def anchor_pattern(spark, d):
    return derived(spark, d, "documents", "doc_id AS id", f"{_COUNT} AS number", f"{_UNIT} AS unit").select("id", rules.anchor_pattern(c("number"), c("unit")).alias("pattern"))


@query("numeric_anchor", f"SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN concat(doc_id % 50, '|7,5') WHEN 1 THEN '7,5' WHEN 2 THEN concat(doc_id % 50, '|10') ELSE '' END AS anchors FROM documents WHERE {HAS}")
def numeric_anchor(spark, d):
    """Numbers right before a unit, unless they are part of a word or a longer number."""
    text = f"concat({A}, CASE doc_id % 4 WHEN 0 THEN concat(' dar ', doc_id % 50, 'mg e 7,5 mL') WHEN 1 THEN ' x9mg, 7,5 %' WHEN 2 THEN concat(' em ', doc_id % 50, ' cmH2O por 10 minutos') ELSE ' 12345mg e 3' END) AS text"
    return derived(spark, d, "documents", "doc_id AS id", text, where=HAS).select("id", F.array_join(tx.numeric_anchors(c("text")), "|").alias("anchors"))


def _spelling(x: str) -> str:
    out = f"replace({folded(x)}, ' ', '')"
    for a, b in rules.COGNATE_SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace({out}, '[^a-z]', '', 'g')"


_FAR = "substr(translate(text, '0123456789%', 'abcdefghijk'), 1, CAST(doc_id % 200 AS INT))"


@query("carrier", f"SELECT doc_id AS id, (contains({_spelling('substr(g, -120)')}, 'capac') OR contains({_spelling('substr(g, -120)')}, 'vital'))::INT AS carries FROM (SELECT doc_id, concat('vital capacity ', {_FAR}, ' ') AS g FROM documents WHERE {HAS})")
def carrier(spark, d):
    """Whether what the answer is about stands near enough to its number, with up to two hundred characters of the document between."""
    rows = derived(spark, d, "documents", "doc_id AS id", f"concat('vital capacity ', {_FAR}, ' 40 %') AS text", where=HAS)
    pattern = rules.anchor_pattern(F.lit("40"), F.lit("%"))
    return rows.select("id", rules.carrier(c("text"), pattern, rules.cognates(F.lit("capacidade vital"))).cast("int").alias("carries"))


@query("locate", f"SELECT doc_id AS id, contains(lower(substr(g, -200)), 'tidal volume')::INT AS found FROM (SELECT doc_id, concat('Tidal Volume ', {_FAR}, ' ') AS g FROM documents WHERE {HAS})")
def locate(spark, d):
    rows = derived(spark, d, "documents", "doc_id AS id", f"concat('Tidal Volume ', {_FAR}, ' 6 mL') AS text", where=HAS)
    return rows.select("id", rules.locate(c("text"), rules.anchor_pattern(F.lit("6"), F.lit("mL")), F.array(F.lit("tidal volume"))).cast("int").alias("found"))


# Topics, replies and contexts.
_TOPIC = "CASE doc_id % 6 WHEN 0 THEN 'juridico-normativo' WHEN 1 THEN 'imagem' WHEN 2 THEN 'valor-numerico' WHEN 4 THEN 'tecnica' ELSE 'fisiopatologia' END"
_STEM = f"concat(CASE doc_id % 6 WHEN 0 THEN 'Segundo a Resolução CFM 2.174 ' WHEN 1 THEN 'Na figura 3 ' WHEN 3 THEN 'Com 5 mg ' ELSE '' END, {A})"
_CLAIM = f"concat(CASE doc_id % 6 WHEN 0 THEN 'usar 5 mg ' WHEN 2 THEN 'usar 5 mg/kg ' ELSE '' END, {B})"
_REPLY = "CASE doc_id % 6 WHEN 3 THEN '{' WHEN 4 THEN '{\"topico\": \"tecnica\"}' WHEN 5 THEN '{\"topico\": \"outro\"}' END"


@query("classify_topic", f"SELECT doc_id AS id, {_TOPIC} AS topic FROM documents WHERE {HAS}")
def classify_topic(spark, d):
    rows = derived(spark, d, "documents", "doc_id AS id", f"{_STEM} AS stem", f"{_CLAIM} AS claim", f"{_REPLY} AS reply", where=HAS)
    return rows.select("id", F.coalesce(rules.topic_by_rule(F.concat_ws(" ", "stem", "claim"), c("claim")), rules.topic_of_reply(c("reply"))).alias("topic"))


@query("classify_rule", f"SELECT coalesce(CASE WHEN doc_id % 6 < 3 THEN {_TOPIC} END, 'none') AS class, count(*) AS n FROM documents WHERE {HAS} GROUP BY 1")
def classify_rule(spark, d):
    """How many documents each rule on topics takes, the first that fires."""
    rows = derived(spark, d, "documents", f"{_STEM} AS stem", f"{_CLAIM} AS claim", where=HAS)
    return rows.groupBy(F.coalesce(rules.topic_by_rule(F.concat_ws(" ", "stem", "claim"), c("claim")), F.lit("none")).alias("class")).agg(F.count("*").alias("n"))


_URL = "concat(url, CASE page_id % 5 WHEN 0 THEN '/0_ESTATUTO.pdf' WHEN 1 THEN '/estatuto-prova.pdf' WHEN 2 THEN '/ME1-norma.pdf' WHEN 3 THEN '/CEM2018.pdf' ELSE '/foto.pdf' END)"


@query("contamination_guard", f"SELECT page_id, {_URL} AS url FROM pages WHERE regexp_matches({_URL}, '{rules.NORMS}') AND NOT regexp_matches({_URL}, '{rules.EXAMS}')")
def contamination_guard(spark, d):
    """Norms are kept, whatever may be an exam or its key isn't."""
    return derived(spark, d, "pages", "page_id", f"{_URL} AS url").filter(rules.is_norm_only(c("url")))


@query("format_source", f"""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN concat('NORMA · ', source, ' · Art. ', doc_id % 30) WHEN 1 THEN concat('LIVRO · ', source, ' | capitulo ', doc_id % 30, ': ', lang, ' | pagina ', doc_id % 100, '-', doc_id % 100 + 2, ' | ', {A}, ' > ', {B})
ELSE concat(source, ' | capitulo ', doc_id % 30, ': ', lang, ' | pagina ', doc_id % 100) END AS header FROM documents WHERE {HAS} AND source IS NOT NULL AND lang IS NOT NULL""")
def format_source(spark, d):
    columns = ["doc_id AS id", "CASE doc_id % 3 WHEN 0 THEN 'NORMA' WHEN 1 THEN 'LIVRO' END AS nature", "source AS book", "doc_id % 30 AS no", "CASE WHEN doc_id % 3 = 0 THEN concat('Art. ', doc_id % 30) ELSE lang END AS chapter", "doc_id % 100 AS first",
               "doc_id % 100 + CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS last", f"CASE WHEN doc_id % 3 = 1 THEN array({A}, {B}) ELSE cast(array() as array<string>) END AS path"]
    rows = derived(spark, d, "documents", *columns, where=f"{HAS} AND source IS NOT NULL AND lang IS NOT NULL")
    return rows.select("id", rules.source_header(*map(c, ("nature", "book", "no", "chapter", "first", "last", "path"))).alias("header"))


@query("focus_query", f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN {B} ELSE sha1(text) END AS query FROM documents WHERE {HAS}")
def focus_query(spark, d):
    rows = derived(spark, d, "documents", "doc_id AS id", f"CASE WHEN doc_id % 2 = 0 THEN concat(text, {NL}, {NL}, 'Assertiva: ', {B}) ELSE sha1(text) END AS text", where=HAS)
    return rows.select("id", tx.focus_query(c("text")).alias("query"))


@query("gate", "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END AS keeps FROM conversations")
def gate(spark, d):
    rows = derived(spark, d, "conversations", "conv_id", "turn", "concat(CASE turn % 3 WHEN 0 THEN 'NAO, ' WHEN 1 THEN 'SIM, ' ELSE 'NÃO_TRATA ' END, translate(role, 'aeo', 'xyz')) AS reply")
    return rows.select("conv_id", "turn", rules.keeps_context(c("reply")).cast("int").alias("keeps"))


@query("respond", f"SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN '' ELSE 'V' END AS answer, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 0 END AS citations, CASE doc_id % 3 WHEN 2 THEN {A} ELSE '' END AS caveat FROM documents WHERE {HAS}")
def respond(spark, d):
    reply = f"""CASE doc_id % 3 WHEN 0 THEN concat('{{"letra": " b) ", "citacoes": [{{"trecho": "', {A}, '", "pagina": 1}}, {{"trecho": "x", "pagina": "2"}}]}}') WHEN 1 THEN {A} ELSE concat('{{"ressalva": "', {A}, '", "resposta": " V "}}') END AS reply"""
    rows = derived(spark, d, "documents", "doc_id AS id", "CASE WHEN doc_id % 3 = 0 THEN 'mcq' ELSE 'vf' END AS mode", reply, where=HAS)
    return rows.select("id", flow.parsed_reply(c("mode"), c("reply")).alias("r")).select("id", "r.answer", "r.citations", "r.caveat")


@query("translate_terms", "SELECT doc_id AS id, sha1(term) AS term FROM (SELECT doc_id, trim(unnest(string_split(translate(text, '.,', chr(10) || chr(10)), chr(10)))) AS term FROM documents) WHERE length(term) BETWEEN 3 AND 60")
def translate_terms(spark, d):
    return flow.reply_terms(derived(spark, d, "documents", "doc_id AS id", f"translate(text, '.,', concat({NL}, {NL})) AS reply")).withColumn("term", F.sha1("term"))


@query("cfg_default", "SELECT doc_id AS id, coalesce(quality, 20)::INT AS k FROM documents LEFT JOIN labels USING (doc_id)")
def cfg_default(spark, d):
    return T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id", "left").select(c("doc_id").alias("id"), F.coalesce(c("quality"), F.lit(20)).alias("k"))


@query("sink_upsert", "SELECT doc_id AS id, n_chars AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, quality FROM labels")
def sink_upsert(spark, d):
    old, new = T(spark, d, "documents").select(c("doc_id").alias("id"), c("n_chars").alias("v")), T(spark, d, "labels").select(c("doc_id").alias("id"), c("quality").cast("long").alias("v"))
    return io.upsert(old, new)


# Formulas: a formula is a benchmark item, its first words the name, the next ones notes.
_FORMULA = ("item_id AS id", "concat(split_part(translate(text, chr(10), ' '), ' ', 1), ' ', split_part(translate(text, chr(10), ' '), ' ', 2)) AS name", "split_part(translate(text, chr(10), ' '), ' ', 3) AS synonyms", "substr(text, 40, 60) AS notes")
_CONTENT = lambda x: f"list_distinct(list_filter(string_split({folded(x)}, ' '), lambda w: length(w) > 2 AND w NOT IN ({', '.join(chr(39) + w + chr(39) for w in tx.STOP_WORDS)})))"


@query("formula_search", f"""WITH f AS (SELECT id, name || ' ' || synonyms AS strong, notes FROM {sql('benchmark', *_FORMULA)}), p AS (SELECT id, unnest({_CONTENT('strong')}) AS w, 3 AS p FROM f UNION ALL SELECT id, unnest({_CONTENT('notes')}), 1 FROM f),
q AS (SELECT doc_id AS qid, unnest({_CONTENT('substr(text, 1, 120)')}) AS w FROM documents), s AS (SELECT qid, id, sum(p)::BIGINT AS score FROM q JOIN p USING (w) GROUP BY qid, id) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, score FROM s QUALIFY rank <= 3""")
def formula_search(spark, d):
    return search.formula_search(derived(spark, d, "benchmark", *_FORMULA), derived(spark, d, "documents", "doc_id AS qid", "substr(text, 1, 120) AS text"))


# Sketches: each document proposes the stages that its id's digests pick.
_STAGE_LIST = ["teleport", *flow.STAGES]
_PICKED = "substr(sha1(concat(doc_id, {x})), 1, 1) < '5'"


def sketches(spark, d):
    names = F.array(*map(F.lit, _STAGE_LIST))
    return T(spark, d, "documents").select(c("doc_id").alias("id"), F.filter(names, lambda x: F.substring(F.sha1(F.concat(c("doc_id").cast("string"), x)), 1, 1) < "5").alias("s"))


_LIST = "[" + ", ".join(f"'{s}'" for s in _STAGE_LIST) + "]"
_SKETCH = f"SELECT doc_id AS id, list_filter({_LIST}, lambda x: {_PICKED.format(x='x')}) AS s FROM documents"
_ANY = lambda s, of: "(" + " OR ".join(f"list_contains({s}, '{x}')" for x in sorted(of)) + ")"
_REPAIRED = f"(list_filter(s, lambda x: x NOT IN ('teleport', 'respond')) || CASE WHEN {_ANY('s', flow.SEARCHES)} AND NOT {_ANY('s', flow.CONTEXTS)} THEN ['expand_parent', 'respond'] ELSE ['respond'] END)"


@query("sketch_repair", f"SELECT id, array_to_string({_REPAIRED}, '>') AS sketch FROM ({_SKETCH})")
def sketch_repair(spark, d):
    return sketches(spark, d).select("id", F.array_join(flow.repair_column(c("s")), ">").alias("sketch"))


@query("sketch_update", f"SELECT id, array_to_string(CASE WHEN {_ANY('s', flow.SEARCHES)} THEN list_filter(s, lambda x: x NOT IN ('teleport', 'respond')) || ['respond'] ELSE list_filter(s, lambda x: x = 'reformulate') || ['respond'] END, '>') AS sketch FROM ({_SKETCH})")
def sketch_update(spark, d):
    return sketches(spark, d).select("id", F.array_join(flow.canonical_column(F.reverse("s")), ">").alias("sketch"))


@query("sink_diagram", f"SELECT id, 'graph TD;' || chr(10) || array_to_string(list_transform(range(1, len(n)), lambda i: chr(9) || n[i] || ' --> ' || n[i + 1] || ';'), chr(10)) AS diagram FROM (SELECT id, ['__start__'] || {_REPAIRED} || ['__end__'] AS n FROM ({_SKETCH}))")
def sink_diagram(spark, d):
    return sketches(spark, d).select("id", flow.diagram_column(c("s")).alias("diagram"))


@query("schema_for", "SELECT doc_id AS id, concat(CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'erro_apontado>' ELSE 'ressalva>' END, CASE WHEN doc_id % 2 = 0 THEN 'letra' ELSE 'resposta' END, '>citacoes') AS fields FROM documents")
def schema_for(spark, d):
    rows = derived(spark, d, "documents", "doc_id AS id", "CASE WHEN doc_id % 2 = 0 THEN 'mcq' ELSE 'vf' END AS mode", "CASE doc_id % 3 WHEN 0 THEN 'estrita' WHEN 1 THEN 'falsificacao' ELSE 'confiante' END AS anchoring")
    return rows.select("id", F.array_join(flow.answer_fields_column(c("mode"), c("anchoring")), ">").alias("fields"))


@query("prompt_update", "SELECT doc_id AS id, length(CASE WHEN length(text) > 80 AND length(text) < 2500 THEN text ELSE source END)::INT AS chars FROM documents")
def prompt_update(spark, d):
    return T(spark, d, "documents").select(c("doc_id").alias("id"), F.length(flow.accept_prompt_column(c("source"), c("text"))).alias("chars"))


@query("evaluate_select", "SELECT source, arg_min(doc_id, doc_id) AS step, max(score) AS score FROM (SELECT source, doc_id, n_chars % 1000 AS score, max(n_chars % 1000) OVER (PARTITION BY source) AS best FROM documents) WHERE score = best GROUP BY source")
def evaluate_select(spark, d):
    """Each source's history of scores: the best one's first step, as only a better one replaces it."""
    history = derived(spark, d, "documents", "source", "doc_id AS step", "n_chars % 1000 AS score")
    return flow.best_steps(history, "source")
