"""Rules and structures on rows written by hand, against results worked out by hand."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import rules
from loam.functions import text as tx
from loam.operators import search, structure
from loam.plans import flow
from loam.registry import literal, values
from test_queries import rows_of

c = F.col
CASES: dict = {}


def case(name, sql):
    def put(function):
        CASES[name] = (function, sql)
        return function

    return put


@case("merge_small", literal([("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("b", 0, 1), ("b", 1, 2)], ["book", "pos", "island"], {"pos": "INT", "island": "BIGINT"}))
def merge_small(spark, d):
    rows = [("a", 0, 1, 500), ("a", 1, 1, 50), ("a", 2, 1, 60), ("a", 3, 1, 500), ("a", 4, 2, 50), ("b", 0, None, 50), ("b", 1, None, 500)]
    return structure.merge_small(values(spark, rows, "book string, pos int, chapter int, chars int")).select("book", "pos", "island")


@case("outline_tree", literal([(1, "S1", None), (2, "S1", "C1"), (3, "S1", "C1"), (4, "S1", "C2"), (5, "S2", None)], ["page", "section", "chapter"], {"page": "INT"}))
def outline_tree(spark, d):
    marks = values(spark, [(1, "S1", None), (2, None, "C1"), (4, None, "C2"), (5, "S2", None)], "page int, section string, chapter string")
    pages = spark.range(1, 6).select(F.col("id").cast("int").alias("page")).join(marks, "page", "left").withColumn("book", F.lit(1))
    sections = structure.carried(pages, "book", "page", "section", "sec")
    return sections.withColumn("chapter", F.last("chapter", ignorenulls=True).over(Window.partitionBy("book", "sec").orderBy("page"))).select("page", F.col("sec").alias("section"), "chapter")


@case("column_bands", literal([(1, 1, "L1"), (1, 2, "L2"), (1, 3, "FULL"), (1, 4, "L3"), (1, 5, "R1"), (1, 6, "R2")], ["page", "pos", "line"], {"page": "INT", "pos": "BIGINT"}))
def column_bands(spark, d):
    rows = [(1, 60.0, 300.0, 100.0, "L1"), (1, 60.0, 300.0, 120.0, "L2"), (1, 60.0, 640.0, 200.0, "FULL"), (1, 60.0, 300.0, 300.0, "L3"), (1, 360.0, 640.0, 290.0, "R1"), (1, 360.0, 640.0, 320.0, "R2")]
    return structure.column_order(values(spark, rows, "page int, x0 double, x1 double, y double, line string"))


@case("split_articles", literal([(1, 0, "preamble", None, None, 207), (1, 1, "article", "Art. 1", "CAPITULO I", 56), (1, 2, "annex", "ANEXO I", "SEÇÃO II de mais", 33), (2, 0, "whole", None, None, 38), (3, 1, "article", "Art. 7", None, 30)], ["id", "pos", "kind", "label", "chapter", "chars"], {"id": "BIGINT", "pos": "BIGINT", "chars": "INT"}))
def split_articles(spark, d):
    long = "x" * 30
    rows = [
        (1, "Intro " + "y" * 190 + f"\nCAPITULO I\n  Art. 1o {long}\nSEÇÃO  II de mais\nAnexo I {long[:25]}\nArtigo 3 short"), (2, f"No article here\nANEXO I Table of sizes\n"),
        (3, f"Short intro\nArt 7 {long[:24]}"), (4, " \n"), (5, None),
    ]
    return structure.split_articles(values(spark, rows, "id long, text string")).withColumn("chars", F.length("body")).drop("body")


@case("answer_sheet", literal([("s", "q0001", "F"), ("s", "q0002", "F"), ("s", "q0003", "C")], ["sheet", "qid", "letter"]))
def answer_sheet(spark, d):
    return structure.answer_sheet(values(spark, [("s", "q0001: V\nQ2 - f\nsome prose\nq0003: c\nq0001: F")], "sheet string, text string"))


@case("parse_mcq", literal([("e", 1, "First stem that runs on", "x", "y and on", "z", "w", "B"), ("e", 4, "Fourth", "x", "y", "z", "w", "E")], ["exam", "number", "stem", "a", "b", "c", "d", "answer"], {"number": "INT"}))
def parse_mcq(spark, d):
    blocks = [
        "PROVA NACIONAL 2019\n1) First stem\n  that runs on\nA) x\nB) y\n   and on\n17\nC) z\nD) w\nResposta: B\nA comment after it", "2) Second\nA) x\nB) y\nC) z\nD) w\nQuestão  ANULADA\nResposta: A",
        "3) Third\nA) x\nB)\nC) z\nD) w\nResposta: C", "4 - Fourth\na. x\nb. y\nc. z\nd. w\ne. v\nresposta: e", "5) Use o cartao de resposta\nA) x\nB) y\nC) z\nD) w\nResposta: C", "6) No answer\nA) x\nB) y\nC) z\nD) w\n",
    ]
    return structure.parse_mcq(values(spark, [("e", "\n".join(blocks))], "exam string, text string"))


@case("roman", literal([("II", 2, 2), ("XLIX", 49, 49), ("11", -1, 2), ("111", -1, 3), ("IIA", -1, 2), ("I1", -1, 1)], ["numeral", "strict", "lenient"], {"strict": "INT", "lenient": "INT"}))
def roman(spark, d):
    return values(spark, [(x,) for x in ("II", "XLIX", "11", "111", "IIA", "I1")], "numeral string").select("numeral", F.coalesce(tx.roman(F.col("numeral")), F.lit(-1)).alias("strict"), tx.roman(F.col("numeral"), True).alias("lenient"))


@case("fix_text", literal([(1, "isoflurano"), (2, "ISOFLURANO"), (3, "desflurano"), (4, "insuficiencia"), (5, "Intubação"), (6, "atlas"), (7, "recuperação")], ["id", "fixed"], {"id": "INT"}))
def fix_text(spark, d):
    rows = list(enumerate(["isotlurano", "ISOTLURANO", "desfturano", "insuftciencia", "lntubação", "atlas", "recu-\nperação"], 1))
    return values(spark, rows, "id int, text string").select("id", rules.normalise(F.col("text")).alias("fixed"))


@case("formula_search", literal([(1, 1, 1, 6), (2, 3, 1, 1)], ["qid", "id", "rank", "score"], {"qid": "BIGINT", "id": "BIGINT", "rank": "BIGINT", "score": "BIGINT"}))
def formula_search(spark, d):
    formulas = values(spark, [(1, "Ânion gap", "hiato aniônico", "acidose"), (2, "Pressão média", "PAM", "choque"), (3, "Clearance", "depuração", "rim doente")], "id long, name string, synonyms string, notes string")
    return search.formula_search(formulas, values(spark, [(1, "hiato ânion"), (2, "doente")], "qid long, text string"))


@case("sketch_repair", literal([(1, "search>expand_parent>respond"), (2, "quota>interleave>respond"), (3, "respond")], ["id", "sketch"], {"id": "INT"}))
def sketch_repair(spark, d):
    sketches = [["search", "teleport"], ["quota", "interleave"], []]
    return values(spark, [(i, ">".join(flow.repair(s))) for i, s in enumerate(sketches, 1)], "id int, sketch string")


@case("carry_header", literal([(1, "C1"), (2, "C1"), (3, "C2"), (4, "C2")], ["page", "chapter"], {"page": "INT"}))
def carry_header(spark, d):
    pages = values(spark, [(1, "C1"), (2, None), (3, "C2"), (4, None)], "page int, head string").withColumn("book", F.lit(1))
    return structure.carried(pages, "book", "page", "head", "chapter").select("page", "chapter")


@case("pos_to_page", literal([(0, 1), (9, 1), (10, 2), (24, 2), (25, 3)], ["pos", "page"], {"pos": "INT", "page": "INT"}))
def pos_to_page(spark, d):
    pages = values(spark, [(1, 10), (2, 15), (3, 5)], "page int, chars int").withColumn("upto", F.sum("chars").over(Window.orderBy("page"))).withColumn("since", c("upto") - c("chars"))
    return values(spark, [(i,) for i in (0, 9, 10, 24, 25)], "pos int").join(pages, F.expr("pos >= since and pos < upto")).select("pos", "page")


@case("build_question", literal([(1, "Stem\nClaim"), (2, "Stem\nA) x\nB) y")], ["id", "question"], {"id": "INT"}))
def build_question(spark, d):
    rows = values(spark, [(1, "Stem", "Claim", None), (2, "Stem", None, {"B": "y", "A": "x"})], "id int, stem string, claim string, alts map<string,string>")
    alts = F.array_join(F.transform(F.array_sort(F.map_entries("alts")), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    return rows.select("id", F.concat_ws("\n", "stem", "claim", alts).alias("question"))


@case("valid_letter", literal([(1, "V", 1), (2, "A", 0), (3, "D", 1)], ["id", "letter", "valid"], {"id": "INT", "valid": "INT"}))
def valid_letter(spark, d):
    rows = values(spark, [(1, "vf", " v "), (2, "vf", "A"), (3, "mcq", "d")], "id int, kind string, answer string").withColumn("letter", tx.first_letter(c("answer")))
    return rows.select("id", "letter", F.when(c("kind") == "vf", c("letter").isin("V", "F")).otherwise(c("letter").isin("A", "B", "C", "D")).cast("int").alias("valid"))


@case("gate", literal([(1, 0), (2, 1), (3, 0)], ["id", "keeps"], {"id": "INT", "keeps": "INT"}))
def gate(spark, d):
    rows = values(spark, [(1, "NAO"), (2, "SIM"), (3, "NÃO_TRATA")], "id int, reply string")
    return rows.select("id", (~F.contains(tx.fold(c("reply")), F.lit("nao"))).cast("int").alias("keeps"))


@case("parse_vf", literal([("e", 1, "a", "first claim", "V"), ("e", 1, "b", "second claim", "F"), ("e", 2, "a", "third claim", "F")], ["exam", "number", "letter", "claim", "answer"], {"number": "INT"}))
def parse_vf(spark, d):
    exams = values(spark, [("e", "1) Stem one\na) first claim (V)\nb) second claim (F)\n2) Stem two\na) third claim (F)\n")], "exam string, text string")
    blocks = exams.select("exam", F.explode(F.split("text", r"(?m)(?=^[0-9]+\))")).alias("block")).filter(c("block").rlike(r"^[0-9]+\)"))
    lines = blocks.select("exam", F.regexp_extract("block", "^([0-9]+)", 1).cast("int").alias("number"), F.explode(F.split("block", "\n")).alias("line")).filter(c("line").rlike(r"^[a-e]\) .*\([VF]\)$"))
    part = lambda i: F.regexp_extract("line", r"^([a-e])\) (.*) \(([VF])\)$", i)
    return lines.select("exam", "number", part(1).alias("letter"), part(2).alias("claim"), part(3).alias("answer"))


@case("sketch_update", literal([(1, "reformulate>search>respond"), (2, "reformulate>respond"), (3, "route>quota>interleave>respond")], ["id", "sketch"], {"id": "INT"}))
def sketch_update(spark, d):
    proposed = [["respond", "search", "reformulate", "search", "teleport"], ["gate", "reformulate"], ["interleave", "quota", "route"]]
    return values(spark, [(i, ">".join(flow.canonical(s))) for i, s in enumerate(proposed, 1)], "id int, sketch string")


@case("prompt_update", literal([(1, 100), (2, 10), (3, 10)], ["id", "chars"], {"id": "INT", "chars": "INT"}))
def prompt_update(spark, d):
    return values(spark, [(i, len(flow.accept_prompt("o" * 10, "n" * n))) for i, n in enumerate((100, 80, 2500), 1)], "id int, chars int")


@case("evaluate_select", literal([(2, "b", 0.7)], ["step", "sketch", "score"], {"step": "INT", "score": "DOUBLE"}))
def evaluate_select(spark, d):
    return flow.best_sketch(values(spark, [(1, "a", 0.5), (2, "b", 0.7), (3, "c", 0.7)], "step int, sketch string, score double"))


@case("sink_diagram", literal([(1, "graph TD;\n\t__start__ --> search;\n\tsearch --> expand_parent;\n\texpand_parent --> respond;\n\trespond --> __end__;")], ["id", "diagram"], {"id": "INT"}))
def sink_diagram(spark, d):
    return values(spark, [(1, flow.diagram(["search"]))], "id int, diagram string")


@case("schema_for", literal([("mcq", "estrita", "letra>citacoes"), ("vf", "estrita", "resposta>citacoes"), ("vf", "falsificacao", "erro_apontado>resposta>citacoes"), ("vf", "confiante", "ressalva>resposta>citacoes")], ["mode", "anchoring", "fields"]))
def schema_for(spark, d):
    cases = [("mcq", "estrita"), ("vf", "estrita"), ("vf", "falsificacao"), ("vf", "confiante")]
    return values(spark, [(m, a, ">".join(flow.answer_fields(m, a))) for m, a in cases], "mode string, anchoring string, fields string")


@case("join_page_range", literal([(4, "a"), (5, "a"), (5, "b"), (9, "c")], ["page", "chunk"], {"page": "INT"}))
def join_page_range(spark, d):
    chunks = values(spark, [("a", 3, 5), ("b", 5, None), ("c", 9, 12)], "chunk string, first int, last int")
    return values(spark, [(4,), (5,), (9,), (13,)], "page int").join(chunks, F.expr("first <= page and page <= coalesce(last, first)")).select("page", "chunk")


@case("sink_upsert", literal([("a", 1), ("b", 3), ("c", 4)], ["id", "v"], {"v": "INT"}))
def sink_upsert(spark, d):
    from loam.sources.io import upsert

    return upsert(values(spark, [("a", 1), ("b", 2)], "id string, v int"), values(spark, [("b", 3), ("c", 4)], "id string, v int"))


@case("scan_key", literal([("q1", "V"), ("q2", "F")], ["question", "letter"]))
def scan_key(spark, d):
    key = values(spark, [('{"gabarito": {"q1": "V", "q2": "F"}, "tipo": {"q1": "vf"}}',)], "raw string")
    maps = F.from_json("raw", "gabarito map<string,string>, tipo map<string,string>")
    return key.select(F.explode(maps["gabarito"]).alias("question", "letter"))


@case("scan_pdf_text", literal([(1, 0, "one"), (1, 1, "two"), (1, 2, "")], ["id", "page", "text"], {"id": "INT", "page": "INT"}))
def scan_pdf_text(spark, d):
    from loam.sources.io import pages_of_text

    return pages_of_text(values(spark, [(1, "one\ftwo\f")], "id int, text string"))


@case("scan_pdf_best", literal([(1, "raw"), (2, "layout")], ["id", "best"], {"id": "INT"}))
def scan_pdf_best(spark, d):
    order = "Art. 1 - a\nArt. 2 - b\nArt. 3 - c\nArt. 4 - d"
    mixed = "Art. 1 - a\nArt. 3 - c\nArt. 2 - b\nArt. 4 - d"
    rows = values(spark, [(1, mixed, order), (2, order, order)], "id int, layout string, raw string")
    marks = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^\s*Art\.?\s*(\d{1,3})\s*[°ºo]?\s*[-–—.]"), F.lit(1)), lambda x: x.cast("int"))

    def share(numbers):
        rises = F.zip_with(F.slice(numbers, F.lit(2), F.greatest(F.size(numbers) - 1, F.lit(0))), F.slice(numbers, F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(0))), lambda b, a: (b >= a).cast("int"))
        return F.when(F.size(numbers) < 3, 0.0).otherwise(F.aggregate(rises, F.lit(0), lambda s, x: s + x) / (F.size(numbers) - 1))

    return rows.select("id", F.when(share(marks("raw")) > share(marks("layout")), "raw").otherwise("layout").alias("best"))


@case("cfg_default", literal([(1, 20), (2, 5)], ["id", "k"], {"id": "INT", "k": "INT"}))
def cfg_default(spark, d):
    return values(spark, [(1, None), (2, 5)], "id int, k int").select("id", F.coalesce("k", F.lit(20)).alias("k"))


@case("annulled", literal([(2,), (4,)], ["id"], {"id": "INT"}))
def annulled(spark, d):
    rows = values(spark, [(1, "Questão ANULADA"), (2, "A dose é"), (3, "Leia as INSTRUÇÕES antes"), (4, "A anulada não é a questão")], "id int, text string")
    return rows.filter(~c("text").rlike(structure.ANNULLED) & ~rules.is_instructions(c("text"))).select("id")


@case("no_invented_key", literal([(1,)], ["id"], {"id": "INT"}))
def no_invented_key(spark, d):
    rows = values(spark, [(1, "A dose é segura", "V"), (2, "Sem gabarito", None), (3, "Verdadeiro que a dose", "V")], "id int, claim string, answer string")
    return rows.filter(c("answer").isNotNull() & ~c("claim").rlike(r"(?i)^(verdadeiro|falso)\b")).select("id")


@case("mcq_complete", literal([(1,)], ["id"], {"id": "INT"}))
def mcq_complete(spark, d):
    rows = values(spark, [(1, dict(A="x", B="y", C="z", D="w")), (2, dict(A="x", B=" ", C="z", D="w")), (3, dict(A="x", B="y"))], "id int, alts map<string,string>")
    filled = lambda k: F.coalesce(F.trim(c("alts")[k]), F.lit("")) != ""
    return rows.filter((F.size("alts") >= 4) & filled("A") & filled("B") & filled("C") & filled("D")).select("id")


@case("fix_curated", literal([(1, "Reflexo e REFLEXO, anafilático"), (2, "isoflurano Propofol"), (3, "a\nb")], ["id", "fixed"], {"id": "INT"}))
def fix_curated(spark, d):
    rows = [(1, "Retlexo e RETLEXO, anafilatico"), (2, "lsoflu rano Propo  fol".replace("lso", "iso")), (3, "a\nAPOSTILASMEDICINA@HOTMAIL.COM\nb")]
    return values(spark, rows, "id int, text string").select("id", F.regexp_replace(rules.normalise(c("text")), "\n+", "\n").alias("fixed"))


@case("split_glued", literal([("um Dois",), ("ABC",)], ["name"]))
def split_glued(spark, d):
    return values(spark, [("umDois",), ("ABC",)], "name string").select(tx.split_glued(c("name")).alias("name"))


@case("doc_label", literal([(1, "CFM 2174/2017", "Resolução CFM nº 2174/2017"), (2, "SBA · estatuto novo", "SBA — estatuto novo"), (3, "AMB Diretrizes", "Projeto Diretrizes AMB"), (4, "outro", "Primeira linha")], ["id", "label", "title"], {"id": "INT"}))
def doc_label(spark, d):
    rows = values(spark, [(1, "CFM-2174-2017", ""), (2, "SBA-12_estatuto_novo", ""), (3, "AMB-x", ""), (4, "outro", "\n  Primeira linha \nx")], "id int, name string, page string")
    return rows.select("id", rules.document_label(c("name"), c("page")).alias("x")).select("id", "x.label", "x.title")


@case("exam_year", literal([(1, 2019, "mcq"), (2, 2015, "vf"), (3, 0, "mcq")], ["id", "year", "format"], {"id": "INT", "year": "INT"}))
def exam_year(spark, d):
    rows = values(spark, [(1, "2019-05_me1.pdf", "1) x\nResposta: A"), (2, "prova.pdf", "Prova ano 2015\nVerdadeiro Falso"), (3, "prova.pdf", "nada")], "id int, name string, text string")
    return rows.select("id", rules.exam_year(c("name"), c("text")).alias("year"), rules.exam_format(c("text")).alias("format"))


@case("strip_exam_chrome", literal([("1) Stem\nA) x",)], ["body"]))
def strip_exam_chrome(spark, d):
    return values(spark, [("PROVA NACIONAL 2019\n\n12\n1) Stem\nCCA\nA) x\nSociedade Brasileira de Anestesiologia",)], "text string").select(rules.exam_body(c("text")).alias("body"))


@case("anchor_pattern", literal([("2,5", "mg", "2\\.5\\s*mg"), ("10", "horas", "10\\s*(?:hours?|h\\b)"), ("3,0", "%", "(?:3\\.0|3)\\s*%"), ("7", "xyz", "7\\b")], ["number", "unit", "pattern"]))
def anchor_pattern(spark, d):
    rows = values(spark, [("2,5", "mg"), ("10", "horas"), ("3,0", "%"), ("7", "xyz")], "number string, unit string")
    return rows.select("number", "unit", rules.anchor_pattern(c("number"), c("unit")).alias("pattern"))


@case("carrier", literal([(1, 1), (2, 0), (3, 0), (4, 1)], ["id", "carries"], {"id": "INT", "carries": "INT"}))
def carrier(spark, d):
    far = "x " * 100
    rows = values(spark, [(1, "vital capacity rises by 40 % at term"), (2, f"vital capacity {far} 40 %"), (3, "vital capacity rises"), (4, f"40% {far} and 40 % of capacity")], "id int, text string")
    pattern = rules.anchor_pattern(F.lit("40"), F.lit("%"))
    return rows.select("id", rules.carrier(c("text"), pattern, rules.cognates(F.lit("capacidade vital"))).cast("int").alias("carries"))


@case("locate", literal([(1, 1), (2, 0)], ["id", "found"], {"id": "INT", "found": "INT"}))
def locate(spark, d):
    rows = values(spark, [(1, "Tidal Volume of 6 mL per kg"), (2, "tidal volume " + "x " * 120 + "6 mL")], "id int, text string")
    return rows.select("id", rules.locate(c("text"), rules.anchor_pattern(F.lit("6"), F.lit("mL")), F.array(F.lit("tidal volume"))).cast("int").alias("found"))


@case("classify_topic", literal([(1, "juridico-normativo"), (2, "imagem"), (3, "valor-numerico"), (4, "fisiopatologia"), (5, "tecnica"), (6, "fisiopatologia")], ["id", "topic"], {"id": "INT"}))
def classify_topic(spark, d):
    rows = [(1, "Segundo a Resolução CFM 2.174", "usar 5 mg", None), (2, "Na figura 3", "x", None), (3, "Sobre a dose", "usar 5 mg/kg agora", None), (4, "Com 5 mg", "sem dose", "{"), (5, "Bloqueio", "x", '{"topico": "tecnica"}'), (6, "Bloqueio", "x", '{"topico": "outro"}')]
    rule = rules.topic_by_rule(F.concat_ws(" ", "stem", "claim"), c("claim"))
    return values(spark, rows, "id int, stem string, claim string, reply string").select("id", F.coalesce(rule, rules.topic_of_reply(c("reply"))).alias("topic"))


@case("format_source", literal([(1, "NORMA · CFM 1/2 · Art. 3"), (2, "LIVRO · Miller | capitulo 8: Inalatórios | pagina 100-101 | A > B"), (3, "Miller | capitulo 8: Inalatórios | pagina 100")], ["id", "header"], {"id": "INT"}))
def format_source(spark, d):
    rows = [(1, "NORMA", "CFM 1/2", None, "Art. 3", 1, 1, []), (2, "LIVRO", "Miller", 8, "Inalatórios", 100, 101, ["A", "B"]), (3, None, "Miller", 8, "Inalatórios", 100, 100, [])]
    cols = "id int, nature string, book string, no int, chapter string, first int, last int, path array<string>"
    return values(spark, rows, cols).select("id", rules.source_header(*map(c, ("nature", "book", "no", "chapter", "first", "last", "path"))).alias("header"))


@case("focus_query", literal([(1, "a dose é 5"), (2, "sem marca")], ["id", "query"], {"id": "INT"}))
def focus_query(spark, d):
    return values(spark, [(1, "Cenário longo\n\nAssertiva: a dose é 5"), (2, "sem marca")], "id int, text string").select("id", tx.focus_query(c("text")).alias("query"))


@case("tall_lines", literal([("Big title",)], ["line"]))
def tall_lines(spark, d):
    rows = values(spark, [(1, 10.0, "a"), (1, 10.0, "b"), (1, 10.0, "d"), (1, 10.0, "e"), (1, 10.0, "f"), (1, 14.0, "Big title"), (1, 14.0, "x " * 20), (1, 13.0, "c")], "page int, height double, line string")
    middle = F.median("height").over(Window.partitionBy("page"))
    tall = rows.withColumn("least", F.when(middle == 0, 20.0).otherwise(1.35 * middle))
    return tall.filter((c("height") >= c("least")) & (structure.word_count("line") <= 12)).select("line")


@case("respond", literal([(1, "B", 1, ""), (2, "", 0, ""), (3, "V", 0, "dose alta")], ["id", "answer", "citations", "caveat"], {"id": "INT", "citations": "INT"}))
def respond(spark, d):
    rows = values(spark, [(1, "mcq", '{"letra": " b) ", "citacoes": [{"trecho": "x", "pagina": 1}]}'), (2, "vf", "not json"), (3, "vf", '{"ressalva": "dose alta", "resposta": " V "}')], "id int, mode string, reply string")
    reply = F.from_json("reply", "letra string, resposta string, ressalva string, erro_apontado string, citacoes array<struct<trecho string, pagina string>>")
    out = rows.select("id", "mode", reply.alias("r"))
    text = lambda x: F.coalesce(F.trim(x), F.lit(""))
    answer = F.when(c("mode") == "mcq", tx.first_letter(text(c("r.letra")))).otherwise(text(c("r.resposta")))
    return out.select("id", answer.alias("answer"), F.coalesce(F.array_size("r.citacoes"), F.lit(0)).alias("citations"), text(F.coalesce("r.ressalva", "r.erro_apontado")).alias("caveat"))


@case("translate_terms", literal([("tidal volume",), ("MAC",)], ["term"]))
def translate_terms(spark, d):
    rows = values(spark, [("tidal volume\nMAC\nx\n" + "y" * 70,)], "reply string")
    terms = rows.select(F.explode(F.split("reply", "\n")).alias("term")).select(F.trim("term").alias("term"))
    return terms.filter(F.length("term").between(3, 60))


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    function, sql = CASES[name]
    got, want = function(spark, None), duckdb.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
