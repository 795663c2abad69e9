"""Chunking: pages to parents under carried headings, small parents merged, parents cut into overlapping windows.

Pages are (book, page, chapter, text). Headings and carried paths are windows within a page or a run of pages of one book; nothing
orders several books together. What runs through a text in order, the windows, does so in a batch of Arrow rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import chunk_id, heading_level
from loam.operators.structure import headings

#: Characters of prose a token stands for, in the target of a window.
CHARS_PER_TOKEN = 3.2
SPACES = r"[ \t\n\r\f\u000B]+"


def build_parents(pages: DataFrame, hierarchy: bool = True) -> DataFrame:
    """(book, run, island, chapter, path, first_page, last_page, text), in the order of run and island within a book.

    A parent begins with each heading, each book and each change of chapter. Its path is the last heading of level 1 and the last
    of level 2 since then, both since the chapter began. Heading lines are in paths only; a parent without any text is left out.
    Without ``hierarchy`` each page is a parent of its own, with an empty path.
    """
    by_page = Window.partitionBy("book").orderBy("page")
    new = ~F.col("chapter").eqNullSafe(F.lag("chapter").over(by_page)) & (F.row_number().over(by_page) > 1)
    numbered = pages.select("book", "page", "chapter", "text").withColumn("new", new.cast("long")).withColumn("run", F.sum("new").over(by_page))
    if not hierarchy:
        whole = numbered.filter(F.length(F.trim(F.regexp_replace("text", SPACES, " "))) > 0)
        return whole.select("book", "run", F.col("page").cast("long").alias("island"), "chapter", F.array().cast("array<string>").alias("path"), F.col("page").alias("first_page"), F.col("page").alias("last_page"), "text")
    lines = numbered.select(F.struct("book", "page").alias("id"), "chapter", "run", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    rows = headings(lines).select("id.book", "id.page", "chapter", "run", "pos", "line", "is_heading")  # a page's lines make its headings
    level = F.when(F.col("is_heading"), heading_level(F.col("line")))
    inside = Window.partitionBy("book", "run").orderBy("page", "pos")
    rows = rows.withColumn("level", level).withColumn("island", F.sum(F.col("is_heading").cast("long")).over(inside))
    rows = rows.withColumn("over", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(inside))
    top = F.last(F.when(F.col("level") == 1, F.trim("line")), ignorenulls=True).over(inside)
    # A heading of level 1 resets level 2: the second is carried within the stretch that the first opens.
    sub = F.last(F.when(F.col("level") == 2, F.trim("line")), ignorenulls=True).over(Window.partitionBy("book", "run", "over").orderBy("page", "pos"))
    rows = rows.withColumn("top", top).withColumn("sub", sub)
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("page", "pos", "line"))))
    met = rows.groupBy("book", "run", "island").agg(
        F.first("chapter").alias("chapter"), F.first("top").alias("top"), F.first("sub").alias("sub"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), body.alias("body")
    )
    text = F.array_join(F.transform("body", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    out = met.withColumn("text", text).filter(F.length(F.trim(F.regexp_replace("text", SPACES, " "))) > 0)
    return out.select("book", "run", "island", "chapter", F.array_compact(F.array("top", "sub")).alias("path"), "first_page", "last_page", "text")


def merge_parents(parents: DataFrame, least: int = 200) -> DataFrame:
    """Parents shorter than ``least`` join the one before of the same book and chapter: its text goes on with their last heading and
    their text, and it ends on the later of the last pages. Null chapters are equal."""
    order = Window.partitionBy("book").orderBy("run", "island")
    stripped = F.length(F.regexp_replace("text", f"^{SPACES}|{SPACES}$", ""))
    starts = (F.row_number().over(order) == 1) | (stripped >= least) | ~F.col("chapter").eqNullSafe(F.lag("chapter").over(order))
    grouped = parents.withColumn("starts", starts.cast("long")).withColumn("group", F.sum("starts").over(order))
    title = F.when(F.size("path") > 0, F.concat(F.element_at("path", -1), F.lit(" "))).otherwise(F.lit(""))
    part = F.when(F.col("starts") == 1, F.col("text")).otherwise(F.concat(F.lit("\n"), title, "text"))
    first = lambda x: F.min_by(x, F.struct("run", "island")).alias(x)
    parts = F.array_sort(F.collect_list(F.struct("run", "island", part.alias("t"))))
    out = grouped.groupBy("book", "group").agg(first("run"), first("island"), first("chapter"), first("path"), first("first_page"), F.max("last_page").alias("last_page"), parts.alias("parts"))
    return out.select("book", "run", "island", "chapter", "path", "first_page", "last_page", F.array_join(F.transform("parts", lambda x: x["t"]), "").alias("text"))


def windows_of(text: str | None, target: int, overlap: float) -> list[tuple[int, int, str]]:
    """(first word, number of words, chunk): words until they make ``target`` characters, cut after the last sentence that ends in the
    window's last quarter, if one does; the next begins a share of the window's words before its end, and at least one word on."""
    words = [w for w in re.split(SPACES, text or "") if w]
    upto = [0]
    for w in words:
        upto.append(upto[-1] + len(w) + 1)
    out, i = [], 0
    while i < len(words):
        j, most = i, upto[i] + target
        while j < len(words) and upto[j] < most:
            j += 1
        if j < len(words):
            least = int((upto[j] - upto[i] - 1) * 0.75)
            ends = [k for k in range(j, i, -1) if words[k - 1][-1] in ".!?" and upto[k] - upto[i] - 1 >= least]
            j = ends[0] if ends else j
        out.append((i, j - i, " ".join(words[i:j])))
        if j >= len(words):
            break
        i = max(j - int((j - i) * overlap), i + 1)
    return out


def window_text(docs: DataFrame, target: int = 1638, overlap: float = 0.15) -> DataFrame:
    """(id, ordinal, first, words, chunk) of docs (id, text). Where a window ends decides where the next begins."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        names = ["id", "ordinal", "first", "words", "chunk"]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                rows = [(i, n, *x) for i, text in enumerate(some.column(1).to_pylist()) for n, x in enumerate(windows_of(text, target, overlap))]
                if rows:
                    at_row, *rest = zip(*rows)
                    columns = [pa.array(c, k) for c, k in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at_row, pa.int64())), *columns], names=names)

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, ordinal long, first long, words long, chunk string")


def squeezed(text: Column) -> Column:
    """Words with one space between them."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def chunk(pages: DataFrame, tokens: int = 512, overlap: float = 0.15, hierarchy: bool = True, least: int = 200) -> DataFrame:
    """(id, level, parent_id, ordinal, book, chapter, path, first_page, last_page, text): each parent and its windows, the children.

    Ids are digests of path and text; a child's path ends in its number. Equal parents, or children, of two books have equal ids.
    """
    parents = build_parents(pages, hierarchy)
    parents = merge_parents(parents, least) if hierarchy and least > 0 else parents
    flat = parents.withColumn("text", squeezed(F.col("text"))).withColumn("id", chunk_id(F.col("path"), F.col("text")))
    shared = ["book", "chapter", "path", "first_page", "last_page"]
    owner = F.struct(F.col("id").alias("parent_id"), *shared)
    cut = window_text(flat.select(owner.alias("id"), "text"), int(tokens * CHARS_PER_TOKEN), overlap)
    path = F.concat(F.col("id.path"), F.array(F.col("ordinal").cast("string")))
    children = cut.select(chunk_id(path, F.col("chunk")).alias("id"), F.lit("child").alias("level"), "id.parent_id", "ordinal", *[f"id.{x}" for x in shared], F.col("chunk").alias("text"))
    return flat.select("id", F.lit("parent").alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"), *shared, "text").unionByName(children)
