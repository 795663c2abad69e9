"""Operators 11 to 13 against brute force: hash trees and proofs, windows of test items, drawn documents."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loam.llm import decontaminate, merkle, resampling
from loam.llm.words import PIECE, word_lists, words
from test_llm import SCHEMA, SF, awkward, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("tables"))


def saved(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}/documents.parquet")
    return f"{folder}/{name}"


def test_words_in_pieces():
    text = "Ünï-CODE x2 naïve gap 漢字,B!c " * (PIECE // 20)
    got = list(word_lists(text.encode()))
    assert len(got) > 1 and [w.decode() for some in got for w in some] == plain_words(text)
    assert words(None) == words(b"") == words(b" .,!") == [] and words(b"x" * (PIECE * 2)) == [b"x" * (PIECE * 2)]


# 11


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return sha("".join(field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((i % 16, nodes[i - i % 16 : i - i % 16 + 16]))
        i //= 16
    return out


def whole_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, bytes.fromhex(leaf(r, r["text"]))))
    trees = {s: tree([leaf(r, r["text"]) for r in by[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            node = leaf(r, r["text"].translate(LOW) if tampered else r["text"])
            for j, m in steps:
                node = sha("".join([*m[:j], node, *m[j + 1 :]]))
            proof = sha("".join("".join(m[:j] + m[j + 1 :]) for j, m in steps))
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def compare_manifest(spark, df, folder, name):
    got = [tuple(r) for r in merkle.op11_merkle(spark, saved(df, folder, name)).collect()]
    assert sorted(got, key=repr) == sorted(whole_manifest([r.asDict() for r in df.collect()]), key=repr)
    return got


def test_manifest_of_awkward_rows(spark, folder):
    assert len(compare_manifest(spark, awkward(spark), folder, "awkward")) == 13
    assert merkle.op11_merkle(spark, saved(empty(spark), folder, "none")).collect() == []


@pytest.mark.parametrize("n", [1, 17, 256, 4100])
def test_manifest_by_size_of_a_source(spark, folder, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text É "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    got = compare_manifest(spark, rows.repartition(5), folder, f"n{n}")
    assert {r[6] for r in got} <= {True, False} and any(r[6] for r in got)


def test_manifest_of_many_sources_and_a_hot_one(spark, folder):
    rows = [(i, f"T {i % 3}", "en", "hot" if i % 3 == 0 else f"s{i:05}" if i % 5 else None, 3) for i in range(1200)]
    rows += [(7, "Same Row", "en", "hot", 8)] * 700 + [(None, "Same Row", None, "", None)] * 40
    compare_manifest(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7), folder, "hot")


def test_proofs_are_real_paths(spark):
    docs = awkward(spark)
    runs, root = merkle.manifest(docs)
    rows = merkle.proofs(runs).collect()
    assert len(rows) == 13
    for r in rows:
        assert merkle.fold(bytes(r["leaf"]), [(s["slot"], bytes(s["members"])) for s in r["steps"]]) == root
        assert merkle.fold(b"\0" * 32, [(s["slot"], bytes(s["members"])) for s in r["steps"]]) != root


# 12


def plain_hits(items, text, window=10):
    windows, w, hit, met = {}, plain_words(text), set(), set()
    for name, item in items:
        run = plain_words(item)
        for i in range(max(1, len(run) - window + 1) if run else 0):
            windows.setdefault(tuple(run[i : i + window]), set()).add(name)
    for n in {len(k) for k in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                met |= windows[tuple(w[i : i + n])]
    held = {tuple(run[i:j]) for _, item in items for run in [plain_words(item)] for i in range(len(run)) for j in range(i + 1, len(run) + 1)}
    longest = max((j - i for i in range(len(w)) for j in range(i + 1, len(w) + 1) if tuple(w[i:j]) in held), default=0)
    return len(w), hit, sorted(met - {None}), longest


def dense(seed, n, kinds="abc"):
    r = random.Random(seed)
    return " ".join(r.choice(kinds) for _ in range(n))


@pytest.mark.parametrize("block_words", [1 << 17, 40])
def test_hits_against_brute_force(spark, block_words):
    items = [(str(i), dense(i, n)) for i, n in enumerate((3, 5, 9, 10, 11, 12, 60, 25, 4, 30))]
    items += [("11", "x Y-z"), ("12", "Y z"), (None, "q r s"), ("13", None), ("14", ""), ("14", "  !"), ("7", items[6][1]), ("15", items[6][1][10:60]), ("15", "Y z")]
    texts = [dense(100 + i, 80) for i in range(12)] + [items[6][1], "k " + items[6][1].upper().replace(" ", " -- ") + " k", "x, y; Z q r s q r", "", None, "!!", "x y", "X y z", items[7][1] + " k " + items[7][1]]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash")] * 3 + [(None, texts[12], None)], "doc_id long, text string, items string")
    found = decontaminate.find(docs.repartition(3), spark.createDataFrame(items, "item_id string, text string"), block_words=block_words)
    rows = found.collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        n, hit, met, longest = plain_hits(items, texts[12 if r["doc_id"] is None else r["doc_id"]])
        assert (r["n_words"], r["items"]) == (n, met)
        assert {x for a, b in r["spans"] for x in range(a, b)} == hit
        assert all(b < c for (_, b), (c, _) in zip(r["spans"], r["spans"][1:]))
        if block_words > 1000:
            assert r["longest"] == longest


def test_decontamination_query(spark):
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in decontaminate.op12_decontamination(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(texts)
    windows = {}
    for name, item in bench:
        run = plain_words(item)
        for i in range(max(1, len(run) - 9)):
            windows.setdefault(tuple(run[i : i + 10]), set()).add(name)
    for i, t in texts.items():
        w, hit, met = plain_words(t), set(), set()
        for a in range(len(w) - 9):
            if tuple(w[a : a + 10]) in windows:
                hit.update(range(a, a + 10))
                met |= windows[tuple(w[a : a + 10])]
        assert tuple(got[i])[1:6] == (len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit))
    assert any(r["contaminated"] for r in got.values()) and not all(r["contaminated"] for r in got.values())


def test_clean_cuts_spans_and_drops_covered_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = ["A, b. " + item.title() + "! c-D é", item, "nothing here", None, "x " * 40 + item + " y " + item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), ("doc_id", "text"))
    got = {r["doc_id"]: r for r in decontaminate.clean(found).collect()}
    assert got[0]["cleaned"] == "A, b. ! c-D é" and not got[0]["kept"] and got[0]["longest"] == 11
    assert got[1]["cleaned"] == "" and not got[1]["kept"]
    assert got[2]["cleaned"] == "nothing here" and got[2]["kept"] and got[3]["cleaned"] is None and got[3]["kept"]
    assert got[4]["cleaned"] == "x " * 40 + " y " and got[4]["kept"]
    assert {r["doc_id"]: r["cleaned"] for r in decontaminate.clean(found, least_span=12).collect()} == dict(enumerate(texts))


def test_long_items_and_long_texts(spark):
    long = prose(9, 3000)
    docs = spark.createDataFrame([(1, prose(3, 40_000) + " " + long[5000:5400]), (2, long), (3, prose(4, 200))], "doc_id long, text string")
    for block in (1 << 17, 500):
        got = {r["doc_id"]: r for r in decontaminate.find(docs, spark.createDataFrame([("a", long)], "item_id string, text string"), block_words=block).collect()}
        assert got[2]["spans"] == [[0, 3000]] and got[1]["items"] == ["a"] and got[3]["spans"] == []


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {str(tuple(r)[2:]) for r in decontaminate.find(awkward(spark), none).select("doc_id", "n_words", "spans", "items", "longest").collect()} == {"([], [], 0)"}
    assert decontaminate.find(empty(spark), none).collect() == []


# 13


def plain_features(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain_draws(docs, target):
    s, t = [0] * 10_000, [0] * 10_000
    features = [plain_features(x["text"]) for x in docs]
    for f, _ in features:
        for b in f:
            s[b] += 1
    for x in target:
        for b in plain_features(x["text"])[0]:
            t[b] += 1
    n_s, n_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for x, (f, n) in zip(docs, features):
        h = int(sha(f"42:{'' if x['doc_id'] is None else x['doc_id']}")[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([x["doc_id"], n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def test_ring_gives_the_crc_of_each_run_across_pieces(monkeypatch):
    from loam.llm import words as module

    text = "Ab c é, d1 " * 30 + "tail"
    for piece in (1, 3, 10, 1 << 20):
        monkeypatch.setattr(module, "PIECE", piece)
        found = [int(b) for _, x in resampling.bucket_runs(text.encode()) for b in x]
        assert sorted(found) == sorted(plain_features(text)[0])
    assert list(resampling.bucket_runs(None)) == list(resampling.bucket_runs(b" ,")) == []


def test_draws_of_awkward_rows(spark):
    target = [{"text": t} for t in (prose(1, 30), None, "", prose(5, 60))]
    rows = spark.createDataFrame([(i % 90, prose(i % 50, 10 + i % 40), "en", "a", 0, 9, "k", 7) for i in range(400)] + [(3, prose(3, 25), "en", "a", 0, 9, "k", 7)] * 300, SCHEMA)
    for docs in (awkward(spark), rows.unionByName(awkward(spark))):
        got = resampling.resample(docs.repartition(6), spark.createDataFrame([(t["text"],) for t in target], "text string")).collect()
        assert sorted(map(tuple, got), key=repr) == plain_draws([r.asDict() for r in docs.collect()], target)
    assert resampling.resample(empty(spark), spark.createDataFrame([], "text string")).collect() == []
    assert len(resampling.resample(awkward(spark), spark.createDataFrame([], "text string")).collect()) == 13


def test_resampling_query(spark):
    got = resampling.op13_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    docs, target = ([r.asDict() for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    want = plain_draws(docs, target)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *r[2:]) for r in want), key=repr)


@pytest.mark.parametrize("name", ["op11_merkle", "op12_decontamination", "op13_resampling"])
def test_against_sql(spark, name):
    import duckdb

    from loam.llm import registry
    from test_queries import rows_of

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
