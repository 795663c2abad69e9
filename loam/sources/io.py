"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "pagina int, secao_num int, secao string, capitulo_num int, capitulo string, titulos array<string>, texto string, livro string"
CHUNK_SCHEMA = "id string, nivel string, pai_id string, ordem int, livro string, secao_num int, secao string, capitulo_num int, capitulo string, caminho array<string>, pagina_inicial int, pagina_final int, texto string"
QUESTION_SCHEMA = "id string, tipo string, numero int, letra string, enunciado string, assertiva string, alternativas map<string,string>, resposta string, fonte string, arquivo string, ano int, classe string, classe_origem string, split string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parse_jsonl(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines (line); blank ones are skipped."""
    return lines.filter(F.trim("line") != "").select(F.from_json("line", schema).alias("x")).select("x.*")


def read_pages(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    pages = read_jsonl(spark, path, PAGE_SCHEMA)
    return pages.filter(F.col("pagina").between(first if first is not None else -(1 << 31), last if last is not None else (1 << 31) - 1))


def pages_of_text(texts: DataFrame) -> DataFrame:
    """(id, page, text): form feeds end pages."""
    return texts.select("id", F.posexplode(F.split("text", "\f")).alias("page", "text"))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "page").load(path)


def result_items(cells: DataFrame) -> DataFrame:
    """Result cells with a JSON map of items, exploded to (bloco, setup, item_id, correct)."""
    return cells.select("bloco", "setup", F.explode(F.from_json("itens", "map<string,boolean>")).alias("item_id", "correct"))


def setup_columns(setup) -> F.Column:
    return F.str_to_map(setup, F.lit("\\|"), F.lit("="))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_jsonl(df: DataFrame, path: str, books: DataFrame | None = None, column: str = "livro") -> None:
    """Refuses to write if a book of the input has no row left."""
    if books is not None and books.select(column).distinct().join(df.select(column).distinct(), column, "left_anti").limit(1).count():
        raise ValueError("a book of the input is lost")
    df.write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str, least_bytes: int = 0) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") >= least_bytes)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("arquivo"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_journal(df: DataFrame, path: str) -> None:
    """Events as JSON lines after those already there."""
    df.write.mode("append").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """(id, vector) with distinct ids, or nothing is written."""
    if df.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("an id has two vectors")
    df.select("id", "vector").write.mode("overwrite").parquet(path)


def layout_words(pages: DataFrame) -> DataFrame:
    """(id, pos, nth, word, x0, y0) of layout XML (id, xml), a page a row with its lines and their words."""
    box = "_xMin double, _yMin double"
    schema = f"line array<struct<{box}, word array<struct<_VALUE string, {box}>>>>"
    lines = pages.select("id", F.posexplode(F.from_xml("xml", schema)["line"]).alias("pos", "line"))
    words = lines.select("id", "pos", F.posexplode("line.word").alias("nth", "w"))
    return words.select("id", "pos", "nth", F.col("w._VALUE").alias("word"), F.col("w._xMin").alias("x0"), F.col("w._yMin").alias("y0"))


def answer_key(raw: DataFrame) -> DataFrame:
    """(..., question, letter) of answer keys in JSON (raw): the map of answers, exploded."""
    others = [c for c in raw.columns if c != "raw"]
    return raw.select(*others, F.explode(F.from_json("raw", "gabarito map<string,string>")["gabarito"]).alias("question", "letter"))
