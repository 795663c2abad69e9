"""Rules on exam, norm and scanned-book texts, as Column -> Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.text import fix_ligature, fold, join_hyphen, keep_case

# Words that the scan misreads and what they should be.
CURATED = {
    "protoxido": "protóxido", "antlogistico": "antiflogístico", "retlexo": "reflexo", "retlexos": "reflexos", "intlamacao": "inflamação",
    "intlamatorio": "inflamatório", "retluxo": "refluxo", "contlito": "conflito", "tlebite": "flebite", "tlexao": "flexão",
    "tlexibilidade": "flexibilidade", "anafilatico": "anafilático", "retlete": "reflete", "retletem": "refletem", "retletir": "refletir",
    "retletida": "refletida", "cardraco": "cardíaco", "cardracos": "cardíacos", "sangurneo": "sanguíneo", "sangurnea": "sanguínea",
    "inalat6rio": "inalatório", "inalat6rios": "inalatórios", "inalatorlos": "inalatórios",
}
# Drug names that the scan splits by a space.
SPLIT_NAMES = [("metoxiflu", "rano"), ("isoflu", "rano"), ("desflu", "rano"), ("sevoflu", "rano"), ("halo", "tano"), ("propo", "fol")]
# Watermark lines of the scan.
WATERMARKS = [r"(?im)^\s*APOSTILASMEDICINA@HOTMAIL\.COM\s*$", r"(?im)^\s*Produtos:\s*https?://\S+\s*$", r"(?im)^\s*lista\.mercadolivre\.com\.br\S*\s*$"]
# Words that say nothing of an assertion's matter.
EMPTY_WORDS = (
    "assertiva", "sobre", "seguinte", "seguintes", "questao", "prova", "considere", "relacao", "respeito", "acerca", "julgue", "trimestral", "resposta",
    "paciente", "durante", "quando", "porque", "entre", "maior", "menor", "pode", "podem", "deve", "devem", "apresenta", "apresentam",
)
# Spellings that two languages share after these replacements, in this order.
COGNATE_SPELLINGS = [("ph", "f"), ("th", "t"), ("y", "i"), ("ct", "t"), ("cc", "c"), ("qu", "c"), ("k", "c"), ("ss", "s"), ("z", "s"), ("mm", "m"), ("nn", "n")]
# How a unit is written in English, as patterns.
UNITS = {
    "%": r"\s*%", "mg": r"\s*mg", "mcg": r"\s*(?:mcg|µg)", "ml": r"\s*mL", "l": r"\s*L\b", "cmh2o": r"\s*cm\s?H2O", "mmhg": r"\s*mm\s?Hg",
    "graus": r"\s*°\s?C", "°c": r"\s*°\s?C", "horas": r"\s*(?:hours?|h\b)", "hora": r"\s*(?:hours?|h\b)", "minutos": r"\s*min", "minuto": r"\s*min",
    "dias": r"\s*days?", "dia": r"\s*days?", "semanas": r"\s*weeks?", "semana": r"\s*weeks?",
}
# The topics of a question and the rules for the first three of them, in order.
TOPICS = ["juridico-normativo", "imagem", "valor-numerico", "gestao", "farmacologia", "tecnica", "fisiopatologia"]
NORMATIVE = ["juridico-normativo", "gestao"]
LEGAL = (
    r"(?iu)\bCFM\b|\bCRM\b|conselho (federal|regional) de medicina|resolu[çc][ãa]o\s+(n?[º°.]?\s*)?\d|\blei\s+n?[º°.]?\s*\d"
    r"|c[óo]digo de [ée]tica m[ée]dica|\bANVISA\b|portaria\s+n?[º°.]?\s*\d|sociedade brasileira de anestesiologia"
    r"|congresso brasileiro de anestesio|\bSBA\b|\bAMB\b|assembleia de representantes|diretoria|estatuto|regimento"
)
IMAGE = (
    r"(?iu)com legenda|\blegenda\s*[\"“]|\bestrutura\s+\d\b|\bfigura\s+\d|\b(nesta|nesse|neste|na)\s+(figura|imagem|tra[çc]ado)\b"
    r"|\bindicad[oa]\s+pela\s+seta\b"
)
NUMERIC = r"(?i)\b\d+(?:[,.]\d+)?\s*(mg/kg|mcg/kg|mL/kg|mg|mL|mcg|µg|kg|mmHg|cmH2O|mEq/L|UI|%)\b|\bvariam?\s+de\s+\d+\s+a\s+\d+\b"
# What marks a block of instructions.
INSTRUCTIONS = [
    "cartao de resposta", "assinado", "proibido fumar", "duracao de", "instrucoes", "instruções", "folha de respostas",
    "caneta esferografica", "caneta esferográfica", "letra de forma", "sala da prova",
]


def fix_curated(text: Column) -> Column:
    """Whole words of CURATED, whatever their accents and case, replaced in the case they had."""
    known = F.create_map(*[F.lit(x) for pair in CURATED.items() for x in pair])
    # Runs of word characters and of others, in turn.
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.coalesce(keep_case(w, known[fold(w)]), w)), "")


def join_split_names(text: Column) -> Column:
    def join(out: Column, name: tuple[str, str]) -> Column:
        head, tail = name
        forms = [(head.upper(), tail.upper()), (head.capitalize(), tail), (head, tail)]
        return reduce(lambda t, f: F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_]){f[0]}\s+{f[1]}(?![\p{{L}}\p{{N}}_])", f[0] + f[1]), forms, out)

    return reduce(join, SPLIT_NAMES, text)


def drop_watermarks(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), WATERMARKS, text)


def normalise(text: Column, ocr: bool = True) -> Column:
    """Letters before joins of words, as a split name is known only once its letters are right; then spaces and blank lines."""
    text = drop_watermarks(text)
    text = fix_curated(fix_ligature(text)) if ocr else text
    text = F.regexp_replace(F.regexp_replace(join_split_names(join_hyphen(text)), "[ \\t\u00a0]{2,}", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def shared_spelling(text: Column) -> Column:
    """Lower-case letters only, without accents, in the spelling that both languages share."""
    plain = F.regexp_replace(fold(text), " ", "")
    return F.regexp_replace(reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), COGNATE_SPELLINGS, plain), "[^a-z]", "")


def cognates(text: Column) -> Column:
    """Distinct stems of five letters of the words of six letters or more."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ÿ]{6,}"), F.lit(0))
    words = F.filter(words, lambda w: ~F.lower(w).isin(*EMPTY_WORDS))
    stems = F.filter(F.transform(words, shared_spelling), lambda s: F.length(s) >= 5)
    return F.array_distinct(F.transform(stems, lambda s: F.substring(s, 1, 5)))


def anchor_pattern(number: Column, unit: Column) -> Column:
    """The pattern by which a number and its unit are found in English text."""
    dotted = F.replace(number, F.lit(","), F.lit("."))
    forms = F.when(dotted.endswith(".0"), F.concat(F.lit("(?:"), F.replace(dotted, F.lit("."), F.lit(r"\.")), F.lit("|"), F.regexp_replace(dotted, r"\.0$", ""), F.lit(")"))).otherwise(F.replace(dotted, F.lit("."), F.lit(r"\.")))
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.concat(forms, F.coalesce(known[F.lower(unit)], F.lit(r"\b")))


def carrier(text: Column, pattern: Column, stems: Column, reach: int = 120) -> Column:
    """Whether a stem stands within ``reach`` characters of a match of the pattern: the text between matches is looked at from both ends."""
    parts = F.split(text, F.concat(F.lit("(?i)"), pattern), F.lit(-1))
    n = F.size(parts)
    has = lambda piece: F.exists(stems, lambda s: F.contains(shared_spelling(piece), s))
    sides = F.transform(parts, lambda p, i: ((i < n - 1) & has(F.right(p, F.lit(reach)))) | ((i > 0) & has(F.left(p, F.lit(reach)))))
    return F.exists(sides, lambda x: x)


def locate(text: Column, pattern: Column, terms: Column, reach: int = 200) -> Column:
    """Whether one of the terms, in any case, stands within ``reach`` characters of a match of the pattern."""
    parts = F.split(text, F.concat(F.lit("(?i)"), pattern), F.lit(-1))
    n = F.size(parts)
    has = lambda piece: F.exists(terms, lambda s: F.contains(F.lower(piece), F.lower(s)))
    return F.exists(F.transform(parts, lambda p, i: ((i < n - 1) & has(F.right(p, F.lit(reach)))) | ((i > 0) & has(F.left(p, F.lit(reach))))), lambda x: x)


def topic_by_rule(block: Column, assertion: Column) -> Column:
    """The first rule that fires, or null; numbers count only in the assertion, where there is one."""
    own = F.when(F.coalesce(assertion, F.lit("")) != "", assertion).otherwise(block)
    return F.when(block.rlike(LEGAL), TOPICS[0]).when(block.rlike(IMAGE), TOPICS[1]).when(own.rlike(NUMERIC), TOPICS[2])


def topic_of_reply(reply: Column) -> Column:
    """A model's JSON reply if it names a topic, else the last topic."""
    named = F.get_json_object(reply, "$.topico")
    return F.when(named.isin(TOPICS), named).otherwise(TOPICS[-1])


# What a norm is called by the beginning of its file's name, underscores read as spaces: pattern, label, title.
DOCUMENTS = [
    (r"^CFM-(\d+)-(\d{4}).*$", "CFM $1/$2", "Resolução CFM nº $1/$2"),
    (r"^SBA-\d* ?\s*(.*?)\s*$", "SBA · $1", "SBA — $1"),
    (r"^AMB-.*$", "AMB Diretrizes", "Projeto Diretrizes AMB"),
    (r"^SBC-.*$", "SBC Diretriz", "Diretriz da Sociedade Brasileira de Cardiologia"),
]
# Where an exam states its year, in its file's name or its text; its verdict words; its answer lines; its header, footer and page-number lines.
YEAR_IN_NAME, YEAR_IN_TEXT = r"(\d{4})-\d{2}_", r"(?i)ANO\s+(\d{4})"
VERDICTS, ANSWER_LINE = "Verdadeiro|Falso", r"(?im)^\s*Resposta:\s*[A-D]"
CHROME = r"(?i)^(PROVA\s+NACIONAL|Sociedade\s+Brasileira\s+de\s+Anestesiologia|CCA$|\d{1,3}$)"


def document_label(name: Column, first_page: Column) -> Column:
    """(label, title) of the first of DOCUMENTS that the name is of; else the name and the page's first line that isn't blank, cut at 90."""
    spaced = F.translate(name, "_", " ")
    filled = F.filter(F.transform(F.split(first_page, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.struct(name.alias("label"), F.substring(F.coalesce(F.try_element_at(filled, F.lit(1)), name), 1, 90).alias("title"))
    for pattern, label, title in reversed(DOCUMENTS):
        named = F.struct(F.regexp_replace(spaced, pattern, label).alias("label"), F.regexp_replace(spaced, pattern, title).alias("title"))
        found = F.when(spaced.rlike(pattern), named).otherwise(found)
    return found


def exam_year(name: Column, text: Column) -> Column:
    """The year in the file's name, else the one that the text states, else 0."""
    found = lambda c, p: F.regexp_extract(c, p, 1).try_cast("int")
    return F.coalesce(found(name, YEAR_IN_NAME), found(text, YEAR_IN_TEXT), F.lit(0))


def exam_format(text: Column) -> Column:
    return F.when(F.regexp_count(text, F.lit(VERDICTS)) > F.regexp_count(text, F.lit(ANSWER_LINE)), "vf").otherwise("mcq")


def exam_body(text: Column) -> Column:
    """Without blank, header, footer and page-number lines."""
    keep = lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(CHROME)
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def is_instructions(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(k)) for k in INSTRUCTIONS))


def source_header(nature: Column, book: Column, chapter_no: Column, chapter: Column, first: Column, last: Column, path: Column) -> Column:
    """Norms are named by article, books by chapter, pages and path."""
    book_line = F.concat(
        F.when(nature.isNotNull(), "LIVRO · ").otherwise(""), book, F.lit(" | capitulo "), F.coalesce(chapter_no.cast("string"), F.lit("None")), F.lit(": "), F.coalesce(chapter, F.lit("None")),
        F.lit(" | pagina "), first.cast("string"), F.when(last != first, F.concat(F.lit("-"), last.cast("string"))).otherwise(""),
        F.when(F.size(path) > 0, F.concat(F.lit(" | "), F.array_join(path, " > "))).otherwise(""),
    )
    return F.when(nature == "NORMA", F.concat(F.lit("NORMA · "), book, F.lit(" · "), chapter)).otherwise(book_line)


# What names a norm, and what may be an exam or its key.
NORMS = r"(?i)estatuto|regimento|regulamento|resolu[çc][ãa]o|norma|c[óo]digo|cem[0-9]{4}|diretriz"
EXAMS = r"(?i)gabarito|prova|(^|[^A-Za-z0-9_])ME[123]([^A-Za-z0-9_]|$)|trimestral|quadri|simulado"


def is_norm_only(name: Column) -> Column:
    """Whether a document's address or title names a norm and nothing of an exam: a key in the index would answer what is being asked."""
    return name.rlike(NORMS) & ~name.rlike(EXAMS)


def keeps_context(reply: Column) -> Column:
    """A judge's reply keeps the context unless it holds a no."""
    return ~F.contains(fold(reply), F.lit("nao"))
