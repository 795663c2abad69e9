"""Sequence to hierarchy: lines, headings, islands, merges, as-of marks, text windows, exam parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import rules
from loam.functions.text import content_tokens

# Fixed value: what a heading line looks like.
HEADING = "^[A-ZÁÂÃÀÉÊÍÓÔÕÚÜÇ][A-Za-zÀ-ÿ -]{2,45}$"


def lines(docs: DataFrame) -> DataFrame:
    """(id, pos, line) of docs (id, text)."""
    return docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def word_count(line):
    return F.size(F.filter(F.split(F.trim(line), "[ \t]+"), lambda w: w != ""))


def headings(lines_df: DataFrame) -> DataFrame:
    """Adds next_line (the next that isn't blank) and is_heading: shape, at most six words, more than six after it."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    filled = F.when(F.trim("line") != "", F.col("line"))
    out = lines_df.withColumn("next_line", F.first(filled, ignorenulls=True).over(w))
    return out.withColumn("is_heading", F.coalesce(F.trim("line").rlike(HEADING) & (word_count("line") <= 6) & (word_count("next_line") > 6), F.lit(False)))


def islands(df: DataFrame, group: str, order: str, starts: str) -> DataFrame:
    """Adds island: how many rows up to this one start a new island."""
    return df.withColumn("island", F.sum(F.col(starts).cast("int")).over(Window.partitionBy(group).orderBy(order)))


def merge_small(parents: DataFrame, least: int = 200) -> DataFrame:
    """Rows (book, pos, chapter, chars): a small one joins the group before it, within its book and chapter."""
    w = Window.partitionBy("book").orderBy("pos")
    new = (F.row_number().over(w) == 1) | (F.col("chars") >= least) | ~F.col("chapter").eqNullSafe(F.lag("chapter").over(w))
    return islands(parents.withColumn("starts", new), "book", "pos", "starts").drop("starts")


def carried(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """The last value seen so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order)))


def column_order(rows: DataFrame, middle: float = 352.0) -> DataFrame:
    """Reading order of lines (page, x0, x1, y, line): full-width lines cut bands; in a band left before right."""
    full = (F.col("x0") < middle) & (F.col("x1") > middle + 148)
    banded = rows.withColumn("full", full.cast("int"))
    banded = banded.withColumn("band", F.sum("full").over(Window.partitionBy("page").orderBy("y", "x0")))
    order = Window.partitionBy("page").orderBy("band", F.desc("full"), F.when(F.col("full") == 1, 0).otherwise((F.col("x0") >= middle).cast("int")), "y", "x0")
    return banded.withColumn("pos", F.row_number().over(order).cast("long")).select("page", "pos", "line")


# How the marks of a norm begin a line.
ARTICLE, ANNEX = r"^[ \t]*(?:Art\.?|ARTIGO|Artigo)[ \t]*([0-9]+)", r"(?i)^[ \t]*(ANEXO[ \t]+[IVXLC0-9]+)([^A-Za-zÀ-ÿ0-9_]|$)"
CHAPTER = r"(?i)^[ \t]*(CAP[IÍ]TULO[ \t]+[IVXLC0-9]+|SE[ÇC][ÃA]O[ \t]+[IVXLC0-9]+)"


def split_articles(docs: DataFrame, least_preamble: int = 200, least_body: int = 25) -> DataFrame:
    """(id, pos, kind, label, chapter, body) of texts (id, text) cut where an article or annex begins a line.

    The last chapter or section at or before a cut is its context; its line stays in the body that it stands in. What comes before the first cut is
    the preamble, if longer than ``least_preamble``; bodies of ``least_body`` characters or fewer go. A text without an article is one piece, even
    if it has annexes. pos is the cut's number from 0, the preamble's.
    """
    found = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    marked = lines(docs).withColumn("article", found(ARTICLE)).withColumn("annex", F.upper(found(ANNEX)))
    here = F.when(F.col("line").rlike(CHAPTER), F.substring(F.trim(F.regexp_replace("line", "[ \t]+", " ")), 1, 70))
    marked = marked.withColumn("cut", F.col("article").isNotNull() | F.col("annex").isNotNull()).withColumn("here", here)
    upto = Window.partitionBy("id").orderBy("pos")
    marked = marked.withColumn("part", F.sum(F.col("cut").cast("int")).over(upto)).withColumn("chapter", F.last("here", ignorenulls=True).over(upto))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    first = lambda x: F.min_by(x, "pos").alias(x)
    parts = marked.groupBy("id", "part").agg(first("article"), first("annex"), first("chapter"), text.alias("raw"))
    cut_at = F.sum(F.when(F.col("part") == 0, F.length("raw"))).over(Window.partitionBy("id"))
    articles = F.count("article").over(Window.partitionBy("id"))
    parts = parts.withColumn("articles", articles).withColumn("before", F.coalesce(cut_at, F.lit(0)))
    kind = F.when(F.col("part") == 0, "preamble").when(F.col("article").isNotNull(), "article").otherwise("annex")
    body = F.regexp_replace("raw", r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    cut = parts.filter("articles > 0").select("id", F.col("part").cast("long").alias("pos"), kind.alias("kind"), F.coalesce(F.concat(F.lit("Art. "), "article"), "annex").alias("label"), F.when(F.col("part") > 0, F.col("chapter")).alias("chapter"), body.alias("body"), "before")
    cut = cut.filter(F.when(F.col("pos") == 0, F.col("before") >= least_preamble).otherwise(F.length("body") > least_body)).drop("before")
    none = F.lit(None).cast("string")
    bare = parts.filter("articles = 0").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
    bare = bare.select("id", F.lit(0).cast("long").alias("pos"), F.lit("whole").alias("kind"), none.alias("label"), none.alias("chapter"), body.alias("body")).filter("body != ''")
    return cut.unionByName(bare)


def monotonicity(rows: DataFrame, group: str, order: str, number: str) -> DataFrame:
    """Share of neighbours that don't fall; 0 for fewer than three."""
    w = Window.partitionBy(group).orderBy(order)
    steps = rows.withColumn("up", (F.col(number) >= F.lag(number).over(w)).cast("int"))
    return steps.groupBy(group).agg(F.count("*").alias("n"), F.round(F.when(F.count("*") < 3, 0.0).otherwise(F.avg("up")), 9).alias("share"))


def answer_sheet(sheets: DataFrame) -> DataFrame:
    """(sheet, qid, letter) of free text (sheet, text); the last mention of a question wins."""
    # Fixed value: a line of an answer sheet.
    pattern = r"(?i)\bq0*([0-9]{1,4})\s*[:.–-]\s*([VFABCD])\b"
    found = sheets.select("sheet", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("q"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("a"))).alias("pos", "m"))
    found = found.select("sheet", "pos", F.col("m.q").cast("int").alias("q"), F.upper("m.a").alias("a"))
    return found.groupBy("sheet", "q").agg(F.max_by("a", "pos").alias("letter")).select("sheet", F.concat(F.lit("q"), F.lpad(F.col("q").cast("string"), 4, "0")).alias("qid"), "letter")


# Fixed value: how an annulled question is marked.
ANNULLED = r"(?iu)quest[aã]o\s+anulada"


def parse_mcq(exams: DataFrame) -> DataFrame:
    """Numbered blocks of (exam, text) with lettered alternatives, A to E, and an answer; alternatives and stems may run over lines.

    Of a letter that stands twice the last counts; what follows the answer's line is left out. Blocks of instructions, annulled
    ones and those without an answer or with one of A to D empty are dropped.
    """
    body = rules.exam_body(F.col("text"))
    blocks = exams.select("exam", F.explode(F.split(body, r"(?m)(?=^[ \t]*[0-9]+[ \t]*[-)–])")).alias("block")).filter(F.col("block").rlike(r"^\s*[0-9]+\s*[-)–]"))
    blocks = blocks.filter(~F.col("block").rlike(ANNULLED) & ~rules.is_instructions(F.col("block")))
    joined = lambda x: F.trim(F.regexp_replace(x, r"\s*\n\s*", " "))
    parts = F.split(F.regexp_replace("block", r"(?ims)^[ \t]*Resposta:.*", ""), r"(?m)(?=^[ \t]*[A-Ea-e][).])")
    rows = blocks.select("exam", F.regexp_extract("block", r"^\s*([0-9]+)", 1).cast("int").alias("number"), F.upper(F.regexp_extract("block", r"(?im)^[ \t]*Resposta:\s*([A-E])", 1)).alias("answer"), parts.alias("p"))
    mark = lambda x: F.upper(F.regexp_extract(x, r"^\s*([A-Ea-e])[).]", 1))
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.col("p")[0], r"^\s*[0-9]+\s*[-)–]\s*", ""), r"\s+", " "))
    alt = lambda letter: F.coalesce(joined(F.regexp_replace(F.try_element_at(F.filter("p", lambda x: mark(x) == letter), F.lit(-1)), r"^\s*[A-Ea-e][).]", "")), F.lit(""))
    out = rows.select("exam", "number", stem.alias("stem"), *[alt(x).alias(x.lower()) for x in "ABCD"], "answer")
    return out.filter("a != '' and b != '' and c != '' and d != '' and answer != ''")


def parse_vf(exams: DataFrame) -> DataFrame:
    """(exam, number, letter, stem, claim, answer) of exams (exam, text): numbered blocks with lettered claims, each with its verdict at the
    end of the line of its letter.

    Stems and claims run over lines. Where a cell is centred, its first line stands above the letter: a letter without text of its own
    takes the last line of the claim before. Claims without a verdict, or that begin with one, go, as does a verdict repeated at the claim's end.
    """
    rows = exams.select(F.col("exam").alias("id"), rules.exam_body(F.col("text")).alias("text"))
    numbered = lines(rows).withColumnRenamed("id", "exam").withColumn("number", F.regexp_extract("line", r"^\s*([0-9]+)\s*[-)–]", 1).try_cast("int"))
    in_exam = Window.partitionBy("exam").orderBy("pos")
    rows = numbered.withColumn("block", F.count("number").over(in_exam)).filter("block > 0")
    line = F.trim(F.regexp_replace("line", r"^\s*[0-9]+\s*[-)–]\s*", ""))
    rows = rows.withColumn("opens", F.col("number").isNotNull()).withColumn("line", F.when(F.col("opens"), line).otherwise(F.trim("line")))
    letter = F.when(~F.col("opens"), F.upper(F.regexp_extract("line", r"^([A-Ea-e])[).]", 1)))
    rows = rows.withColumn("letter", F.nullif(letter, F.lit(""))).withColumn("heads", F.coalesce(~F.col("opens") & F.col("line").rlike(r"(?i)^(quest[oõ]es|resposta:)"), F.lit(False)))
    in_block = Window.partitionBy("exam", "block").orderBy("pos")
    rows = rows.withColumn("nth", F.count("letter").over(in_block)).withColumn("headed", F.max("heads").over(in_block))
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "line")))), lambda x: x["line"])
    filled = F.col("line") != ""
    stems = rows.groupBy("exam", "block").agg(F.first("number", ignorenulls=True).alias("number"), F.array_join(ordered(filled & (F.col("nth") == 0) & ~F.col("headed")), " ").alias("stem"))
    verdict = r"(?i)(?:^|[^A-Za-zÀ-ÿ0-9_])(Verdadeiro|Falso)\s*$"
    own = F.regexp_replace(F.col("line"), r"^[A-Ea-e][).]\s*", "")
    cells = rows.filter("nth > 0").withColumn("own", F.when(F.col("letter").isNotNull(), own))
    cells = cells.groupBy("exam", "block", "nth").agg(F.first("letter", ignorenulls=True).alias("letter"), F.first("own", ignorenulls=True).alias("own"), ordered(filled & F.col("letter").isNull() & ~F.col("heads")).alias("more"))
    said = F.lower(F.regexp_extract("own", verdict, 1))
    cells = cells.withColumn("answer", F.when(said == "verdadeiro", "V").when(said == "falso", "F")).withColumn("own", F.trim(F.when(said != "", F.regexp_replace("own", r"(?i)(Verdadeiro|Falso)\s*$", "")).otherwise(F.col("own"))))
    by = Window.partitionBy("exam", "block").orderBy("nth")
    lent = F.when(F.col("own") == "", F.element_at(F.lag("more").over(by), -1))
    gone = (F.lead("own").over(by) == "") & (F.size("more") > 0)
    cells = cells.withColumn("first", F.coalesce(F.nullif(F.col("own"), F.lit("")), lent)).withColumn("rest", F.when(gone, F.slice("more", F.lit(1), F.size("more") - 1)).otherwise(F.col("more")))
    claim = F.trim(F.regexp_replace(F.concat_ws(" ", "first", F.array_join("rest", " ")), r"\s+", " "))
    claim = F.trim(F.regexp_replace(claim, r"\s*[-–—]\s*[VF]\s*$", ""))
    last = F.row_number().over(Window.partitionBy("exam", "block", "letter").orderBy(F.desc("nth")))
    out = cells.withColumn("claim", claim).withColumn("last", last).filter("last = 1 and answer is not null").filter(~F.col("claim").rlike(r"(?i)^(verdadeiro|falso)([^A-Za-zÀ-ÿ0-9_]|$)"))
    return out.join(stems, ["exam", "block"]).select("exam", "number", "letter", F.trim(F.regexp_replace("stem", r"\s+", " ")).alias("stem"), "claim", "answer")


def pos_to_page(positions: DataFrame, pages: DataFrame, span: int = 4096) -> DataFrame:
    """(id, pos, page) of positions (id, pos) in texts whose pages (id, page, chars) follow one another.

    Both sides meet on the stretch of ``span`` characters that a position is in; a page is in as many as it touches. A position beyond the last page has none.
    """
    upto = F.sum("chars").over(Window.partitionBy("id").orderBy("page"))
    ends = pages.select("id", "page", "chars", upto.alias("upto")).filter("chars > 0").withColumn("since", F.col("upto") - F.col("chars"))
    ends = ends.withColumn("stretch", F.explode(F.expr(f"sequence(since div {span}, (upto - 1) div {span})")))
    at = positions.withColumn("stretch", F.expr(f"cast(pos as long) div {span}"))
    return at.join(ends, ["id", "stretch"]).filter("pos >= since and pos < upto").select("id", "pos", "page")


def pages_in_ranges(pages: DataFrame, chunks: DataFrame, span: int = 16) -> DataFrame:
    """(book, page, chunk) of pages (book, page) in the ranges of chunks (book, chunk, first, last); a null last is the first.

    Both sides meet on stretches of ``span`` pages.
    """
    ranges = chunks.withColumn("last", F.coalesce("last", "first")).filter("first <= last")
    ranges = ranges.withColumn("stretch", F.explode(F.expr(f"sequence(cast(floor(first / {span}) as long), cast(floor(last / {span}) as long))")))
    at = pages.withColumn("stretch", F.expr(f"cast(floor(page / {span}) as long)"))
    return at.join(ranges, ["book", "stretch"]).filter("first <= page and page <= last").select("book", "page", "chunk")


def outline_intervals(outline: DataFrame, last_page: int) -> DataFrame:
    """(id, depth, path, first_page, last_page) of an outline (id, parent, title, page), walked from its roots by a recursive query.

    An entry ends before the next one's page, whatever their depths, or on its own page if both share it. An entry whose parent
    is missing isn't reached.
    """
    sql = """WITH RECURSIVE walk(id, depth, path, page) AS (
        SELECT id, 0, title, page FROM {outline} WHERE parent IS NULL
        UNION ALL SELECT o.id, w.depth + 1, w.path || ' > ' || o.title, o.page FROM {outline} o JOIN walk w ON o.parent = w.id) SELECT * FROM walk"""
    walk = outline.sparkSession.sql(sql, outline=outline)
    following = F.lead("page").over(Window.orderBy("page", "depth", "id"))  # an outline of one book, some hundreds of entries
    return walk.select("id", "depth", "path", F.col("page").alias("first_page"), F.coalesce(F.greatest("page", following - 1), F.lit(last_page)).alias("last_page"))


def join_answers(sheet: DataFrame, labels: DataFrame, key: DataFrame) -> DataFrame:
    """(id, letter, correct) of answers (label, letter) whose label (label, id) and key (id, answer) are known."""
    return sheet.join(labels, "label").join(key, "id").select("id", "letter", (F.col("letter") == F.col("answer")).cast("int").alias("correct"))


def chapter_topics(texts: DataFrame, most: int = 12) -> DataFrame:
    """(chapter, topics) of (chapter, text): a stand-in for a summarising model, the content words that most texts of a chapter hold."""
    words = texts.select("chapter", F.explode(content_tokens(F.col("text"))).alias("w")).groupBy("chapter", "w").agg(F.count("*").alias("n"))
    top = words.withColumn("rank", F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("n"), "w"))).filter(F.col("rank") <= most)
    return top.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("x")).select("chapter", F.array_join(F.transform("x", lambda x: x["w"]), ", ").alias("topics"))


def first_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    kept = F.min_by(F.struct(*df.columns), order)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(kept.alias("x")).select("x.*")


def tall_lines(rows: DataFrame) -> DataFrame:
    """Lines (page, height, line) at least 1.35 times as high as their page's middle one, or 20 where that is 0, of at most twelve words."""
    middle = F.median("height").over(Window.partitionBy("page"))
    tall = rows.withColumn("least", F.when(middle == 0, 20.0).otherwise(1.35 * middle))
    return tall.filter((F.col("height") >= F.col("least")) & (word_count("line") <= 12)).drop("least")


def better_reading(layout: F.Column, raw: F.Column) -> F.Column:
    """Which of two readings of a page, layout or raw, has the larger share of article numbers that don't fall; layout if they are equal."""
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^\s*Art\.?\s*(\d{1,3})\s*[°ºo]?\s*[-–—.]"), F.lit(1)), lambda x: x.cast("int"))

    def share(found):
        rest = F.greatest(F.size(found) - 1, F.lit(0))
        rises = F.zip_with(F.slice(found, F.lit(2), rest), F.slice(found, F.lit(1), rest), lambda b, a: (b >= a).cast("int"))
        return F.when(F.size(found) < 3, 0.0).otherwise(F.aggregate(rises, F.lit(0), lambda s, x: s + x) / (F.size(found) - 1))

    return F.when(share(numbers(raw)) > share(numbers(layout)), "raw").otherwise("layout")


def question_text(stem: F.Column, claim: F.Column, alternatives: F.Column) -> F.Column:
    """The stem, then the claim or the alternatives in the order of their letters."""
    alts = F.array_join(F.transform(F.array_sort(F.map_entries(alternatives)), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    return F.concat_ws("\n", stem, claim, alts)


def is_valid_letter(kind: F.Column, letter: F.Column) -> F.Column:
    return F.when(kind == "vf", letter.isin("V", "F")).otherwise(letter.isin("A", "B", "C", "D"))


def is_complete(alternatives: F.Column) -> F.Column:
    """Whether at least four alternatives are there and A to D aren't blank."""
    filled = lambda k: F.coalesce(F.trim(alternatives[k]), F.lit("")) != ""
    return (F.size(alternatives) >= 4) & filled("A") & filled("B") & filled("C") & filled("D")


def real_questions(blocks: DataFrame) -> DataFrame:
    """Blocks (text) that are neither annulled nor instructions."""
    return blocks.filter(~F.col("text").rlike(ANNULLED) & ~rules.is_instructions(F.col("text")))


def with_key(claims: DataFrame) -> DataFrame:
    """Claims (claim, answer) whose answer is known and doesn't stand at their beginning."""
    return claims.filter(F.col("answer").isNotNull() & ~F.col("claim").rlike(r"(?i)^(verdadeiro|falso)([^A-Za-zÀ-ÿ0-9_]|$)"))
