"""Walks, batched embedding, the journal, comparisons and ranks against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loam import flow_queries, index_queries, registry
from loam.operators import embed, index, ordered, reports, search, structure
from loam.plans import flow, journal, walk


def words(text):
    import re

    return [w for w in re.sub(r"[^\w]+|_", " ", (text or "").lower()).split(" ") if len(w) > 1]


def made_up(seed, n, kinds="abcdefghijklmnop"):
    r = random.Random(seed)
    return " ".join(3 * r.choice(kinds) for _ in range(n))


def plain_walk(questions, docs, deep, w):
    """One question after another, one round after another."""
    by = {}
    for i, book, chapter, text in docs:
        by.setdefault((book, chapter), []).append((i, text))
    reads = {}
    for q, text in questions:
        read, opened = [], set()
        for n in range(1, w.rounds + 1):
            appeal = {p: len(set(words(text)) & set(words(TOPICS[p]))) for p in by if p not in opened}
            best = min((p for p in appeal if appeal[p] > 0), key=lambda p: (-appeal[p], p), default=None)
            seen = {i for i, *_ in read}
            if best:
                opened.add(best)
                chars = sum(len(t) for _, t in by[best])
                rest = [(i, t) for i, t in by[best] if i not in seen]
                common = (lambda t: len(set(words(text)) & set(words(t)))) if chars > walk.WHOLE_CHARS else (lambda t: 0)
                rest.sort(key=lambda x: (-common(x[1]), x[0]))
                got = [i for i, _ in rest[: w.k if chars > walk.WHOLE_CHARS else w.most]]
            else:
                got = [i for i in deep.get(q, []) if i not in seen][: w.k]
            read += [(i, n, "read" if best else "search") for i in got]
            whole = "\n".join(t for i, *_ in read for j, _, _, t in docs if j == i)
            mine = set(words(text))
            if read and round(len(mine & set(words(whole))) / max(1, len(mine)), 6) >= 0.95:
                break
        reads[q] = read[: w.most]
    return reads


TOPICS: dict = {}


def test_walk_against_one_question_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(walk, "WHOLE_CHARS", 300)
    docs = [(i, f"b{i % 2}", f"c{i % 5}", made_up(i, 4 + 3 * (i % 6), "abcdefghijklmnop"[(i % 5) * 2 :]) + " rare" * (i % 13 == 0)) for i in range(60)]
    asked = [(q, made_up(1000 + q, 3 + q % 7)) for q in range(25)] + [(90, "zz zzz nothing"), (91, ""), (92, "rare thing"), (93, "rare")]
    library = spark.createDataFrame(docs, "id long, book string, chapter string, text string").repartition(5)
    questions = spark.createDataFrame(asked, "qid long, text string")
    w = walk.Walk(suffices=flow.covers(0.95), k=3, most=20)
    got = {}
    for r in walk.walk(questions, library, w).orderBy("qid", "slot").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["round"], r["how"]))
    TOPICS.update({(r["book"], r["chapter"]): r["topics"] for r in walk.catalogue(library).collect()})
    deep = {}
    for r in search.bm25_topk(library.select("id", "text"), questions, 200).orderBy("qid", "rank").collect():
        deep.setdefault(r["qid"], []).append(r["id"])
    want = {q: x for q, x in plain_walk(asked, docs, deep, w).items() if x}
    assert got == want and {h for x in got.values() for *_, h in x} == {"read", "search"} and len({n for x in got.values() for _, n, _ in x}) > 2


@pytest.mark.parametrize("kind", ["long", "string"])
def test_chapters_are_read_without_pairs_of_questions_and_texts(spark, monkeypatch, kind):
    monkeypatch.setattr(walk, "WHOLE_CHARS", 200)
    monkeypatch.setattr(walk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(walk, "DOC_ROWS", 7)
    texts = [(i, f"b{i % 2}", f"c{i % 3}", made_up(i % 50, 3 + i % 9)) for i in range(90)] + [(91, "b0", "c0", None), (92, "b0", "c0", ""), (93, "b9", "c9", "aaa bbb"), (94, "b9", "c9", "ccc")]
    asked = [(q, made_up(q, 30), f"b{q % 2}", f"c{q % 3}") for q in range(12)] + [(20, "aaa", "b9", "c9"), (21, "", "b0", "c1")]
    docs = spark.createDataFrame(texts, "id long, book string, chapter string, text string").withColumn("id", F.col("id").cast(kind)).repartition(5)
    to = spark.createDataFrame(asked, "qid long, text string, book string, chapter string")
    read = spark.createDataFrame([(q, i) for q in range(0, 12, 2) for i in range(0, 90, 5)], "qid long, id long").withColumn("id", F.col("id").cast(kind))
    w, places = walk.Walk(k=3, most=5), walk.catalogue(docs)
    words = docs.select("id", "book", "chapter", F.array_distinct(walk.tokens(F.col("text"))).alias("w"))
    for before in (None, read):
        got = walk._inside(to, places, words, before, w)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "array_intersect" not in plan
        pairs = to.join(places.select("book", "chapter", "chars"), ["book", "chapter"]).join(docs.withColumnRenamed("text", "t"), ["book", "chapter"])
        pairs = pairs if before is None else pairs.join(before, ["qid", "id"], "left_anti")
        common = F.when(F.col("chars") > 200, F.size(F.array_intersect(F.array_distinct(walk.tokens(F.col("text"))), walk.tokens(F.col("t"))))).otherwise(0)
        nth = F.row_number().over(walk.Window.partitionBy("qid").orderBy(F.desc("common"), "id")).cast("long")
        want = pairs.withColumn("common", common).withColumn("nth", nth).filter(F.col("nth") <= F.when(F.col("chars") > 200, 3).otherwise(5)).select("qid", "id", "nth")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.filter("qid = 20").count() == 2


def test_a_refused_batch_is_asked_text_by_text():
    sent = []

    def client(texts):
        sent.append([len(t) for t in texts])
        if any(len(t) > 1500 for t in texts):
            raise embed.TooLarge
        return [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]

    assert embed.ask(client, ["a" * 10, "b" * 9000, "c" * 1500]) == [[10.0], [1414.0], [1500.0]]
    assert sent == [[10, 6553, 1500], [10], [6553], [3931], [2358], [1414], [1500]]
    never = lambda texts: (_ for _ in ()).throw(embed.TooLarge())
    with pytest.raises(embed.TooLarge):
        embed.ask(never, ["x" * 9000])
    with pytest.raises(ValueError):
        embed.ask(lambda texts: [(0, [1.0])], ["a", "b"])


def test_each_different_text_is_embedded_once(spark):
    docs = spark.createDataFrame([(i, ["one", "two", None, ""][i % 4]) for i in range(400)], "id long, text string").repartition(6)
    asked = spark.sparkContext.accumulator(0)

    def client(texts):
        asked.add(len(texts))
        return [(i, [float(len(t))]) for i, t in enumerate(texts)]

    got = {r["id"]: r["vector"] for r in embed.embedded(docs, client).collect()}
    assert asked.value == 3 and len(got) == 400 and got[0] == [3.0] and got[2] is None and got[3] == [0.0]


def test_a_replayed_event_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "journal")
    assert journal.current(spark, path).collect() == []
    rows = spark.createDataFrame([(1, 1, "batch", "a", None), (1, 2, "evaluate", "a", 0.5), (1, 3, "evaluate", "b", 0.7), (1, 4, "evaluate", "c", 0.7), (1, 5, "apply", "b", None), (2, 1, "evaluate", "x", 0.1)], journal.SCHEMA)
    journal.append(rows, path)
    once = sorted(map(tuple, journal.current(spark, path).collect()))
    assert once == [(1, 5, "b", 3, "b", 0.7), (2, 1, None, 1, "x", 0.1)]
    journal.append(rows.filter("event > 2"), path)
    journal.append(rows, path)
    assert sorted(map(tuple, journal.current(spark, path).collect())) == once


def test_pairs_of_systems_by_hand(spark):
    r = random.Random(1)
    answers = [(i, s, r.randint(0, 1)) for i in range(200) for s in "dacb" if not (s == "d" and i % 9 == 0)]
    answers += [(3, "a", 1), (3, "a", 0)]
    got = {(x["first"], x["second"]): (x["n"], x["only_first"], x["only_second"]) for x in reports.compared(spark.createDataFrame(answers, "item long, system string, ok int").repartition(7)).collect()}
    ok = {}
    for i, s, v in answers:
        ok[i, s] = max(v, ok.get((i, s), 0))
    items = [i for i in range(200) if all((i, s) in ok for s in "abcd")]
    assert got == {(x, y): (len(items), sum(ok[i, x] > ok[i, y] for i in items), sum(ok[i, x] < ok[i, y] for i in items)) for x, y in itertools.combinations("abcd", 2)}


def test_ranks_of_hot_groups(spark):
    rows = [(g, i, i % 5) for g, n in (("a", 900), ("b", 3), (None, 40)) for i in range(n)] + [("a", 7, 2)] * 3
    df = spark.createDataFrame(rows, "g string, i long, w long").repartition(7)
    got = ordered.ranked(df, ["g"], ["i"], "w").collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine))) and [r["i"] for r in mine] == sorted(x[1] for x in rows if x[0] == g)
        assert [r["before"] for r in mine] == [sum(m["w"] for m in mine[:k]) for k in range(len(mine))]
    assert ordered.ranked(df.limit(0), ["g"], ["i"]).count() == 0
    assert sorted(map(tuple, ordered.rotated(spark.range(5), "id").collect())) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)]


def test_index_is_the_same_however_it_grew(spark, tmp_path):
    docs = spark.createDataFrame([(i, made_up(i, 5 + i % 9)) for i in range(80)] + [(500, None), (501, ""), (None, "aaa bbb"), (7, "zz copy")], "id long, text string")
    asked = spark.createDataFrame([(1, "aaa bbb ccc"), (2, "ppp ppp"), (3, "zz"), (4, "")], "qid long, text string")
    one, two, three = (str(tmp_path / x) for x in ("one", "two", "three"))
    index.add(docs, one, 0, 8)
    for n, part in enumerate(("id < 30", "id < 60", "true")):
        index.add(docs.filter(part), two, n, 8)
    index.add(docs.filter("id < 60"), two, 1, 8)  # run again
    index.compact(spark, two, three)
    want = sorted(map(tuple, index.search(spark, one, asked, 10).collect()))
    assert want and want == sorted(map(tuple, index.search(spark, two, asked, 10).collect())) == sorted(map(tuple, index.search(spark, three, asked, 10).collect()))
    kept = docs.selectExpr("id", "coalesce(text, '') AS text").filter("id is not null and not (id = 7 and text like 'zz%')")
    assert want == sorted(map(tuple, search.bm25_topk(kept, asked, 10).collect()))
    assert index.search(spark, str(tmp_path / "none"), asked).count() == 0
    reads = index.search(spark, one, asked.filter("qid = 3"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in reads and "bucket" in reads


@pytest.mark.parametrize("kind", ["long", "string"])
def test_lists_of_blocks_are_shuffled_not_words(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(index, "QUERY_BLOCK", 2)
    monkeypatch.setattr(index, "DOC_ROWS", 7)
    monkeypatch.setattr(index, "TERM_COLUMNS", 3)
    docs = spark.createDataFrame([(i, made_up(i % 50, 5 + i % 9)) for i in range(120)] + [(500, None), (501, "")], "id long, text string").coalesce(2)
    docs = docs.withColumn("id", F.col("id").cast(kind))
    asked = spark.createDataFrame([(i, made_up(i, 40)) for i in range(5)] + [(None, "aaa bbb")], "qid long, text string")
    small, whole = str(tmp_path / "small"), str(tmp_path / "whole")
    batch_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    index.add(docs, small, 0, 4, 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    index.add(docs, whole, 0, 4)
    rows = sorted(map(tuple, index.table(spark, whole, "postings").drop("bucket", "batch").collect()))
    assert rows == sorted(map(tuple, index.table(spark, small, "postings").drop("bucket", "batch").collect()))
    stored = spark.read.parquet(f"{whole}/postings").count()
    assert stored < len(rows) / 2 and stored < spark.read.parquet(f"{small}/postings").count()
    assert index.table(spark, whole, "docs").count() == 122
    want = sorted(map(repr, search.bm25_topk(docs.fillna("", "text"), asked, 6).collect()))
    for path in (small, whole):
        found = index.search(spark, path, asked, 6)
        assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
        assert want and want == sorted(map(repr, found.collect()))


def test_known_ids_are_met_before_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, made_up(i, 5)) for i in range(40)], "id long, text string")
    ids = docs.select("id")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert index._fresh(docs, ids, spark.range(100, 120)) is docs
    none = index._fresh(docs, ids, spark.range(60))
    assert "Join" not in plan(none) and none.count() == 0
    some = index._fresh(docs, ids, spark.range(10, 50))
    assert "strategy=broadcast" in plan(some) and sorted(r["id"] for r in some.collect()) == list(range(10))
    path = str(tmp_path / "index")
    for n, part in enumerate(("id < 20", "id >= 20", "true", "id < 30")):
        index.add(docs.filter(part), path, n, 4)
    assert index.table(spark, path, "docs").groupBy("batch").count().orderBy("batch").collect() == [(0, 20), (1, 20)]


def test_found_rows_are_broadcast_to_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, made_up(i, 12), "book" if i % 2 else "norms", i - i % 3) for i in range(60)], "id long, text string, source string, parent long")
    asked = spark.createDataFrame([(i, made_up(100 + i, 6)) for i in range(5)], "qid long, text string")
    index.add(docs.select("id", "text"), str(tmp_path / "index"), 0, 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan(index.search(spark, str(tmp_path / "index"), asked, 5).join(docs, "id"))
        for name, least in (("v1", 1), ("v2", 3), ("v14", 1)):
            options = flow.Options(searcher=flow.searcher_of(name, str(tmp_path / "index")))
            run = flow.run_flow(asked, docs, flow.VARIANTS[name], options)
            # No join on a text's id is without the hint.
            assert plan(run).count("strategy=broadcast") >= least
            assert run.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_streamed_files_grow_in_number_with_the_table(spark, monkeypatch):
    at = "/root/testdata/sf0.001"
    size = int(str(registry.doc_texts(spark, at)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(index_queries, "FILE_BYTES", size // 10)
    path = index_queries._streamed(spark, at)
    assert len(spark.read.parquet(path.removesuffix("index") + "in").inputFiles()) == 24
    assert sorted(index._listed(spark, path)[0]) == [0, 1, 2, 3]
    assert index.table(spark, path, "docs").groupBy("batch").count().count() == 2


def test_flows_by_vectors_build_no_index(spark, monkeypatch):
    def never(*_):
        raise AssertionError("an index is built")

    monkeypatch.setattr(flow_queries, "text_index", never)
    for name in ("v11", "v13"):
        assert registry.QUERIES[f"flow_{name}"](spark, "/root/testdata/sf0.001").columns
    with pytest.raises(AssertionError, match="an index"):
        registry.QUERIES["flow_v14"](spark, "/root/testdata/sf0.001")


def test_pages_of_positions_and_of_quotes(spark):
    pages = spark.createDataFrame([(1, 1, 10), (1, 2, 15), (1, 3, 0), (1, 4, 5000), (2, 1, 3)], "id long, page int, chars int")
    at = spark.createDataFrame([(1, p) for p in (0, 9, 10, 24, 25, 5024, 5025)] + [(2, 2), (3, 0)], "id long, pos long")
    assert sorted((r["id"], r["pos"], r["page"]) for r in structure.pos_to_page(at, pages, 100).collect()) == [(1, 0, 1), (1, 9, 1), (1, 10, 2), (1, 24, 2), (1, 25, 4), (1, 5024, 4), (2, 2, 1)]
    text = [(1, 0, "Início, aqui"), (1, 1, "  --  "), (1, 2, "one two Três four"), (1, 3, "five six seven"), (2, 0, "one two tres four five six")]
    quotes = spark.createDataFrame([(1, "two tres, FOUR five six seven"), (2, "one two tres four five six"), (3, "not there at all in any text")], "quote_id long, quote string")
    got = search.cited_pages(quotes, spark.createDataFrame(text, "id long, page int, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (2, 1, 2), (2, 2, 0)]
