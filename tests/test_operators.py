"""Operators on literal rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators import chunk, search, stats, structure
from loam.plans import flow
from loam.sources import io
from loam.streaming.incremental import index_stream


def test_mcnemar_and_holm(spark):
    df = spark.createDataFrame([(1, 2, 7), (2, 0, 0)], "id int, b long, c long").withColumn("p", stats.mcnemar(F.col("b"), F.col("c")))
    got = {r["id"]: r["p"] for r in df.collect()}
    assert abs(got[1] - 0.1796875) < 1e-12 and got[2] == 1.0
    pairs = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "id string, p double")
    assert {r["id"]: round(r["holm"], 9) for r in stats.holm(pairs, "p", ["id"]).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_window_text_invariants(spark):
    text = " ".join(f"word{i}{'.' if i % 9 == 0 else ''}" for i in range(2000))
    rows = chunk.window_text(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 5000)], "id long, text string"), 600).collect()
    mine = sorted((r for r in rows if r["id"] == 1), key=lambda r: r["ordinal"])
    assert mine[0]["first"] == 0 and mine[-1]["first"] + mine[-1]["words"] == 2000
    assert all(a["first"] < b["first"] <= a["first"] + a["words"] for a, b in zip(mine, mine[1:]))
    assert all(r["chunk"] == " ".join(text.split()[r["first"] : r["first"] + r["words"]]) and len(r["chunk"]) < 610 for r in mine)
    assert all(r["chunk"].endswith(".") for r in mine[:-1])
    assert [r["chunk"] for r in rows if r["id"] == 4] == ["x" * 5000]
    assert not [r for r in rows if r["id"] in (2, 3)]


def test_chunks_by_hand(spark):
    prose = "One two three four five six seven eight."
    pages = [("b", 1, 1, f"lead {prose}\nINTRO\n{prose}\nFirst Part\n{prose}"), ("b", 2, 1, f"goes on {prose}\nSECOND\n{prose}\nNot a heading\nshort"), ("b", 3, 2, prose), ("c", 1, None, "  \n"), ("c", 2, None, prose), ("d", 1, None, None)]
    got = chunk.build_parents(spark.createDataFrame(pages, "book string, page int, chapter int, text string")).collect()
    rows = {(r["book"], r["run"], r["island"]): (r["path"], r["first_page"], r["last_page"], r["text"]) for r in got}
    assert rows == {
        ("b", 0, 0): ([], 1, 1, f"lead {prose}\n"), ("b", 0, 1): (["INTRO"], 1, 1, prose + "\n"), ("b", 0, 2): (["INTRO", "First Part"], 1, 2, f"{prose}\ngoes on {prose}\n"),
        ("b", 0, 3): (["SECOND"], 2, 2, f"{prose}\nNot a heading\nshort\n"), ("b", 1, 0): ([], 3, 3, prose + "\n"), ("c", 0, 0): ([], 1, 2, f"  \n\n{prose}\n"),
    }
    merged = {(r["book"], r["run"], r["island"]): (r["path"], r["last_page"], r["text"]) for r in chunk.merge_parents(spark.createDataFrame(got), 60).collect()}
    assert merged[("b", 0, 0)] == ([], 1, f"lead {prose}\n\nINTRO {prose}\n") and ("b", 0, 1) not in merged and len(merged) == 5
    whole = chunk.chunk(spark.createDataFrame(pages, "book string, page int, chapter int, text string"), 10, 0.2, least=0).collect()
    parents = [r for r in whole if r["level"] == "parent"]  # two have the same path and text, so the same id
    assert len(parents) == 6 and len({r["id"] for r in parents}) == 5 and {r["parent_id"] for r in whole if r["level"] == "child"} == {r["id"] for r in parents}
    for p in parents:
        assert [r["text"] for r in sorted((r for r in whole if r["parent_id"] == p["id"] and r["book"] == p["book"] and r["first_page"] == p["first_page"]), key=lambda r: r["ordinal"])] == [c for _, _, c in chunk.windows_of(p["text"], 32, 0.2)]
    flat = chunk.chunk(spark.createDataFrame(pages, "book string, page int, chapter int, text string"), hierarchy=False).filter("level = 'parent'").collect()
    assert sorted((r["book"], r["first_page"], tuple(r["path"])) for r in flat) == [("b", 1, ()), ("b", 2, ()), ("b", 3, ()), ("c", 2, ())]


def test_citations_are_whole_words(spark):
    quotes = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three"), (3, "Ó-ne two, three four five SIX!")], "quote_id long, quote string")
    docs = spark.createDataFrame([(1, "zero ONE two three, four five six seven"), (2, "one two three four five sixty"), (3, None)], "id long, text string")
    assert sorted(tuple(r) for r in search.citations(quotes, docs).collect()) == [(1, 1)]


def test_rrf_ties_go_to_the_smaller_id(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 7, 2)], "qid long, id long, rank long")
    b = spark.createDataFrame([(1, 7, 1), (1, 5, 2)], "qid long, id long, rank long")
    assert [r["id"] for r in search.rrf_fuse([a, b]).orderBy("rank").collect()] == [5, 7]


def test_sketch_rules():
    assert flow.repair(["search", "unknown"]) == ["search", "expand_parent", "respond"]
    assert flow.canonical(["respond", "search", "reformulate"]) == ["reformulate", "search", "respond"]
    assert flow.canonical(["gate", "reformulate"]) == ["reformulate", "respond"]
    for stages in flow.VARIANTS.values():
        assert flow.repair(stages) == stages


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.fold(F.lit("Ação, É!")).alias("fold"), tx.keep_case(F.lit("ABC"), F.lit("xyz")).alias("caps"), tx.keep_case(F.lit("Abc"), F.lit("xyz")).alias("title"), tx.heading_level(F.lit("SOLUBILIDADE")).alias("one"),
        tx.heading_level(F.lit("Metabolismo")).alias("two"), tx.split_glued(F.lit("umDois")).alias("glued"), tx.digits_only(F.lit("cap. 12")).alias("digits"), tx.numeric_anchors(F.lit("dar 2,5 mg e x9mg em 10 minutos")).alias("anchors"),
        tx.html_escape(F.lit("a<b&c")).alias("html"), tx.first_letter(F.lit("  v ")).alias("letter"), tx.focus_query(F.lit("x\n\nAssertiva: y")).alias("focus"),
    ).first()
    assert row.asDict() == {"fold": "acao e", "caps": "XYZ", "title": "Xyz", "one": 1, "two": 2, "glued": "um Dois", "digits": 12, "anchors": ["2,5", "10"], "html": "a&lt;b&amp;c", "letter": "V", "focus": "y"}


def test_sources_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    assert sorted(tuple(r) for r in io.upsert(old, new).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    path = str(tmp_path / "pages.jsonl")
    with open(path, "w") as f:
        f.write('{"pagina": 1, "texto": "a", "livro": "x"}\n\n{"pagina": 2, "texto": "b", "livro": "x"}\n')
    assert io.read_pages(spark, path, 2, 2).count() == 1
    cells = spark.createDataFrame([("b", "v1|k=8", '{"i1": true, "i2": false}')], "bloco string, setup string, itens string")
    assert sorted(r["item_id"] for r in io.result_items(cells).collect()) == ["i1", "i2"]
    assert io.manifest(spark, path).first()["bytes"] > 0


def test_incremental_index_keeps_each_chunk_once(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "path array<string>, text string, ts timestamp"
    rows = spark.sql("SELECT array('a') AS path, 'same' AS text, timestamp'2024-01-01' AS ts UNION ALL SELECT array('a'), 'same', timestamp'2024-01-01' UNION ALL SELECT array('b'), 'other', timestamp'2024-01-01'")
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(schema).parquet(source), index, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(index).count() == 2


def test_flow_stages_take_effect(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "book", 9), (2, "alpha gamma", "book", 9), (3, "estatuto alpha", "norms", None), (4, "delta", "book", None), (5, "omega", "norms", None), (7, "rho", "norms", None), (6, "sigma tau", "book", None), (9, "whole parent", "book", None)], "id long, text string, source string, parent long")
    asked = spark.createDataFrame([(1, "alpha"), (2, "estatuto alpha"), (3, "nothing known")], "qid long, text string")
    ran = lambda sketch, **o: {r["qid"]: r["n_context"] for r in flow.run_flow(asked, docs, sketch, flow.Options(**o)).collect()}
    assert ran(["search", "child_context"]) == {1: 3, 2: 3, 3: 0}
    assert ran(["search", "child_context", "gate"], on_topic=flow.covers(2.0)) == {1: 0, 2: 0, 3: 0}
    # Two of the three hits have one parent.
    assert ran(["search", "expand_parent"]) == {1: 2, 2: 2, 3: 0}
    # A normative question gets norms and book, another the book only.
    assert ran(["route", "quota", "interleave"]) == {1: 2, 2: 3, 3: 0}
    assert ran(["reformulate", "search", "rerank", "expand_parent", "critique"], suffices=flow.covers(2.0)) == {1: 2, 2: 2, 3: 0}
    # A model places what no rule does.
    assert ran(["route", "quota", "interleave"], classify=lambda q: F.lit('{"topico": "gestao"}')) == {1: 3, 2: 3, 3: 0}


def test_vectors_and_journals(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    io.write_vectors(rows, str(tmp_path / "vectors"))
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 2
    with pytest.raises(ValueError):
        io.write_vectors(rows.union(rows), str(tmp_path / "again"))
    for _ in range(2):
        io.append_journal(spark.createDataFrame([("step", 1)], "event string, n int"), str(tmp_path / "journal"))
    assert spark.read.json(str(tmp_path / "journal")).count() == 2


def test_stratified_fills_from_the_rest(spark):
    df = spark.createDataFrame([("a", i) for i in range(2)] + [("b", i) for i in range(2, 12)], "k string, v int")
    got = stats.stratified(df, "k", ["v"], 8).collect()
    assert sorted(r["v"] for r in got) == list(range(8)) and sum(r["by_quota"] for r in got) == 6
    assert stats.stratified(df.limit(0), "k", ["v"], 8).count() == 0


def test_dense_ties_go_to_the_smaller_id_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        base = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "id long, vector array<double>").coalesce(1)
        got = search.dense_topk(base, spark.createDataFrame([(7, [0.0, 1.0])], "qid long, vector array<double>"), 3).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["id"] for r in got] == [1, 3, 5]


def test_walk_stops_when_its_context_suffices(spark):
    docs = spark.createDataFrame([(i, f"alpha w{i} " + ("omega" if i == 5 else "other"), "book") for i in range(12)], "id long, text string, source string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "alpha omega"), (3, "alpha missing")], "qid long, text string")
    options = flow.Options(k=2, rounds=4, suffices=flow.covers(1.0))
    got = {r["qid"]: r["n_context"] for r in flow.run_flow(asked, docs, ["navigate", "respond"], options).collect()}
    assert got == {1: 1, 2: 1, 3: 4}
