"""The ten operators and the pipeline on awkward rows, against brute force, round trips or held-out accuracy."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import common, components, jaccard, language, lm, media, mixing, neighbours, packing, quality, sharding, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, key string, size int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def awkward(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, odd characters, columns with clashing names."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "  ", 3), "en", None), (4, "", "en", "b"), (5, None, "de", "b"), (6, "*** 12 !!", None, "b"),
        (7, prose(2, 30_000), "de", "a"), (8, base + " tail", "fr", "c"), (9, "kurz", "de", "c"), (None, "no id here", None, None), (10, "ünï ✓ 漢字 😀 <|endoftext|> x", "fr", "c"), (11, base.rsplit(" ", 60)[0], "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0, 9, "k", 7) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ranked_is_a_row_number_and_a_prefix_sum(spark):
    rows = [(g, i, i % 5) for g, n in (("a", 500), ("b", 3), (None, 4)) for i in range(n)]
    got = common.ranked(spark.createDataFrame(rows, "g string, i long, w long").repartition(7), ["g"], ["i"], "w").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["rank"] == r["i"] and r["before"] == sum(k % 5 for k in range(r["i"]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == got[102] == 100


# 1


def test_exponent_meets_entropy_or_repeats():
    tokens = [900, 50, 30, 20]
    a = mixing.find_exponent(tokens, 0.8, 1e9)
    assert abs(mixing.entropy(mixing.weights_of(tokens, a)) - 0.8 * math.log(4)) < 1e-9
    b = mixing.find_exponent(tokens, 0.99, 2.0)
    assert abs(mixing.most_repeats(tokens, mixing.weights_of(tokens, b)) - 2.0) < 1e-6
    assert mixing.find_exponent([5]) == 1.0 and mixing.find_exponent([]) == 1.0 and mixing.find_exponent([7, 7]) == 1.0


def test_mixing_against_brute_force(spark):
    docs = awkward(spark)
    rows = [r.asDict() for r in mixing.mix(docs, block_tokens=2000).collect()]
    distinct = {(r["doc_id"], r["text"] or ""): r["source"] or "" for r in docs.collect()}
    assert {r["doc_id"] for r in rows} == {i for i, _ in distinct}
    tokens = Counter()
    for (_, text), source in distinct.items():
        tokens[source] += len(text.split()) + 1
    names = sorted(tokens)
    w = mixing.weights_of([tokens[s] for s in names], rows[0]["exponent"])
    total = max(tokens[s] / x for s, x in zip(names, w))
    for s, x in zip(names, w):
        drawn = sum(r["tokens"] for r in rows if r["source"] == s)
        largest = max(r["tokens"] for r in rows if r["source"] == s)
        assert x * total - 1e-6 <= drawn < x * total + largest
        epochs = Counter((r["doc_id"], r["epoch"]) for r in rows if r["source"] == s)
        assert max(epochs.values()) == 1
    for b in {r["block"] for r in rows}:
        assert sorted(r["place"] for r in rows if r["block"] == b) == list(range(sum(r["block"] == b for r in rows)))
    assert mixing.mix(empty(spark)).count() == 0


# 2


def test_hadamard_keeps_norms():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_neighbours_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype(float)
    x[300:900] = x[300]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(5000, None, "x"), (5001, [0.0] * 24, "x"), (5002, [float("nan")] * 24, "x"), (5003, [None] * 24, "x"), (5004, [1.0], "x"), (100, x[100].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = neighbours.search(df, df.filter("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 1500, 100):
        s = np.sqrt(((x - x[q]) ** 2).sum(1))
        s[q] = np.inf
        want = np.lexsort((np.arange(1500), s))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(want.tolist()))
    assert hits >= 0.9 * 150
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 400), key=lambda r: r["rank"])] == list(range(300, 310))
    few = df.filter("vec_id < 4 or vec_id > 4000")
    assert neighbours.search(few, few.filter("vec_id = 0")).count() == 3
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_huge_and_tiny_components(spark):
    rows = [(100, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1e308, -1e308]), (200, [1e-200, 0.0]), (3, [2e-200, 0.0]), (4, [3e-200, 1e-201])]
    got = neighbours.search(*(d := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), d.filter("vec_id in (100, 200)"))).collect()
    by = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (100, 200)}
    assert [i for i, _ in by[200]] == [3, 4, 1, 100, 2] and by[200][0][1] == pytest.approx(1e-200) and by[200][2][1] == 1e200
    assert {i for i, _ in by[100]} == {1, 2, 3, 4, 200} and dict(by[100])[1] == 2e200 and dict(by[100])[2] == pytest.approx(math.sqrt(2) * 1e308)


def test_hash_shape_follows_the_number_of_vectors():
    for n, d in ((0, 64), (1, 1), (300, 3), (2000, 64), (51_282, 64), (10**9, 64), (10**12, 768)):
        axes, route, probes = neighbours.hash_shape(n, d)
        buckets = math.prod(axes)
        assert 1 <= route <= len(axes) and 1 <= probes <= buckets and (n < 8 * axes[0] or 1 <= n / buckets <= 32)
        assert n / math.prod(axes[:route]) <= 4 * neighbours.PART or route == len(axes)


# 3


def test_png_filters_and_damage():
    rng = np.random.default_rng(0)
    payload = rng.integers(0, 256, 192 * 9, np.uint8).tobytes()
    for kind in (0, 1, 2, 3, 4, None):
        assert media.png_decode(media.png_encode(payload, filters=kind)).tobytes() == payload
    lines, kinds = np.frombuffer(payload, np.uint8).reshape(9, 192), np.array([0, 1, 2, 3, 4, 2, 1, 0, 4])
    mixed = np.stack([media._residual(lines[: y + 1], k, 3)[y] for y, k in enumerate(kinds)])
    assert (media._unfilter(kinds, mixed, 3) == lines).all()
    blob = bytearray(media.png_encode(payload))
    blob[60] ^= 1
    with pytest.raises(ValueError):
        media.png_decode(bytes(blob))


def test_media_round_trip(spark):
    rows = media.media_features(media.media_column(awkward(spark))).collect()
    texts = {(r["doc_id"], r["text"] or "") for r in awkward(spark).collect()}
    want = {}
    for i, t in texts:
        raw = t.encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want[i] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert len(rows) == 13
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"]]
    assert len({r["feature"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert media.media_features(media.media_column(empty(spark))).count() == 0


# 4


def test_packing_encodes_new_pieces_by_the_model():
    enc = packing.Encoder(packing.tokenizer_path())
    rng, signs = random.Random(5), [*"abcXYZéßſªº¼½ 12'stvelm\n\t\r .,—“”€…¡¿«»   "]
    texts = ["".join(rng.choices(signs, k=rng.randrange(80))) for _ in range(2000)] + ["", "<|endoftext|> it's", " ", "b" * 3000]
    texts = [t for t in texts if not enc.odd(t)]
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    enc.tokenizer = None  # texts of known signs aren't split by it once more
    assert [np.frombuffer(ids, np.uint32).tolist() for ids in enc.encode(texts)] == want


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    docs = awkward(spark).dropDuplicates(["doc_id", "text"])
    rows = packing.pack(docs, path).collect()
    for d in docs.collect():
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["start"])
        assert [x for r in mine for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert {r["doc_tokens"] for r in mine} == {len(ids)}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and (at & (at - 1)) == 0
    assert packing.pack(empty(spark), path).count() == 0


def test_nnls_plan_fits_the_histogram():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 20_000)
    have = Counter(lengths.tolist())
    combos, counts = packing.recipe(dict(have))
    assert (counts > 0).all() and set(combos.sum(1)) == {1024}
    used = Counter()
    for c, x in zip(combos.tolist(), counts.tolist()):
        for n in c:
            if n:
                used[n] += x
    assert all(used[n] <= have[n] for n in used) and sum(n * x for n, x in used.items()) > 0.9 * lengths.sum()
    # Every rank below the plan's use of a length gets a place of its own, every other none, and sequences are full.
    plan, at, filled = packing.Plan(combos, counts), Counter(), Counter()
    for n, k in have.items():
        taken, seq, offset = plan.places(np.full(k, n), np.arange(k))
        assert taken.sum() == used[n] and taken[: used[n]].all()
        for s, o in zip(seq[taken].tolist(), offset[taken].tolist()):
            at[s, o] += 1
            filled[s] += n
    assert set(at.values()) == {1} and set(filled.values()) == {1024} and len(filled) == counts.sum()


@pytest.mark.parametrize("sf, tasks", [("sf0.01", (1, 4)), ("sf0.1", (8,))])
def test_most_tail_tokens_are_packed_by_the_plan_whatever_the_tasks(spark, sf, tasks):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    shares = []
    for n in tasks:
        rows = packing.pack(docs.repartition(n), packing.tokenizer_path()).filter("length < 1024")
        planned, every = rows.agg(F.sum(F.when(F.col("sequence_id") < 1 << 40, F.col("length")).otherwise(0)), F.sum("length")).first()
        shares.append((planned, every))
        assert planned >= 0.7 * every
    assert len(set(shares)) == 1


# 5


def test_warc_records_and_revisits(spark):
    pages = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, None), (4, "u", ""), (5, "u", "x" * 3_000_000), (6, "u", "ünï\r\n\r\nWARC/1.1"), (6, "u", "ünï\r\n\r\nWARC/1.1"), (None, "n", "null id")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, offset int")
    folder = common.shared_dir(spark)
    index = warc.normalise_archives(warc.write_archives(warc.decide(df), folder), folder)
    rows = warc.read_records(index, folder).collect()
    assert len(rows) == len(pages)
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    for i, _, html in pages:
        raw = (html or "").encode()
        assert all(r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() for r in by[i])
    assert by[1][0]["record_type"] == "response" and (by[3][0]["record_type"], by[3][0]["refers_to"]) == ("revisit", 1)
    assert by[2][0]["record_type"] == "response" and by[4][0]["refers_to"] == 2
    assert sorted(r["record_type"] for r in by[6]) == ["response", "revisit"]
    # Many copies of one row, and damage in a sidecar.
    many = spark.createDataFrame([(9, "u", "again")] * 300 + [(8, "v", "again")], "page_id long, url string, html string")
    archives = warc.normalise_archives(warc.write_archives(warc.decide(many), folder), folder)
    types = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_records(archives, folder).collect())
    assert types == {(8, "response", None): 1, (9, "revisit", 8): 300}
    nine = warc.normalise_archives(warc.write_archives(warc.decide(many.filter("page_id = 9")), folder), folder)
    assert Counter(r["record_type"] for r in warc.read_records(nine, folder).collect()) == {"response": 1, "revisit": 299}
    side = nine.first()["path"].removesuffix(".gz") + ".idx"
    open(side, "a").write("0\t1\n")
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(nine, folder).count()
    none = warc.normalise_archives(warc.write_archives(warc.decide(df.limit(0)), folder), folder)
    assert warc.read_records(none, folder).count() == 0


def test_monolithic_stream_is_split_and_damage_found():
    import io

    records = [warc.build_record(i, "u", bytes([i]) * 70_000) for i in range(9)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = b"".join(map(z.compress, records)) + z.flush()
    assert list(warc.split_records(warc.inflate(io.BytesIO(data), 1000))) == records
    assert list(warc.split_records(warc.inflate(io.BytesIO(b"".join(map(warc.member, records))), 1000))) == records
    with pytest.raises((ValueError, zlib.error)):
        list(warc.split_records(warc.inflate(io.BytesIO(data[:-20]), 1000)))


# 6


def test_lm_base_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 40)
    docs = awkward(spark)
    train = docs.filter(~lm.held_out(F.col("doc_id")))
    counts = lm.count_ngrams(train)
    rows = lm.score(docs, counts, train.count()).collect()
    data = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in docs.collect()]
    c = Counter(w for i, t in data if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in data)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == pytest.approx(w[4], rel=1e-9) for g, w in zip(got, want))
    assert all(r["score"] <= 0 for r in rows)
    assert lm.score(empty(spark), lm.count_ngrams(empty(spark)), 0).count() == 0


def test_filter_never_loses_a_level():
    rng = np.random.default_rng(0)
    h, level = rng.integers(0, (1 << 64) - 1, 3000, np.uint64), rng.integers(1, 9, 3000)
    f = lm.Filter(256)
    for j in range(1, 9):
        on = level >= j
        for p in f.places(h[on], j):
            at = f.segment(h[on]) * f.width + p
            np.bitwise_or.at(f.words, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    assert (f.levels(h) >= level).all()
    assert (f.levels(h) == level).mean() > 0.95


def test_followers_of_a_word_share_at_most_all_odds():
    c = np.arange(1, 5000)
    level = lm.level_of(c)
    assert (lm.count_of(level) <= c).all() and (c <= lm.most_of(level)).all()
    rng = np.random.default_rng(1)
    for _ in range(200):
        pairs = rng.integers(1, 60, rng.integers(1, 50))
        total = lm.most_of(lm.level_of(np.array([pairs.sum()])))[0]
        assert lm.count_of(lm.level_of(pairs)).sum() <= total


def test_lm_beats_its_base_on_held_out_texts(spark):
    rows = lm.op6_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def brute_model(train, texts, order=2):
    """Scores by exact dictionaries of quantised counts."""
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    grams = Counter()
    for t in train:
        w = ["start", *tokens(t)]
        grams.update(tuple(w[max(0, i - n + 1) : i + 1]) for i in range(1, len(w)) for n in range(1, order + 1) if i - n + 1 >= 0)
    words = {g: c for g, c in grams.items() if len(g) == 1}
    low, most = lambda c: float(lm.count_of(lm.level_of(np.array([c])))[0]), lambda c: float(lm.most_of(lm.level_of(np.array([c])))[0])
    mass = sum(map(low, words.values()))
    for t in texts:
        total, w = 0.0, ["start", *tokens(t)]
        for i in range(1, len(w)):
            p = (low(grams[(w[i],)]) + 1) / (mass + len(words) + 1)
            for n in range(2, order + 1):
                if i - n + 1 < 0:
                    break
                context = tuple(w[i - n + 1 : i])
                before = len(train) if context == ("start",) else most(grams[context])
                if before:
                    p = lm.LAMBDA * min(1.0, low(grams[(*context, w[i])]) / before) + (1 - lm.LAMBDA) * p
            total += math.log10(p)
        yield total


def model_gap(spark, texts, order=2):
    """The largest difference a token between scores and brute force, and between the sums over all texts."""
    docs = spark.createDataFrame([(i, t, "en", "a", 0, 0, "k", 0) for i, t in enumerate(texts)], SCHEMA)
    train = docs.filter(~lm.held_out(F.col("doc_id")))
    kept = {r["doc_id"] for r in train.collect()}
    got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in lm.score(docs, lm.count_ngrams(train, order), len(kept), order).collect()}
    want = list(brute_model([t for i, t in enumerate(texts) if i in kept], texts, order))
    gaps = [abs(got[i][0] - w) / got[i][1] for i, w in enumerate(want)]
    return max(gaps), abs(sum(got[i][0] for i in got) - sum(want)) / sum(n for _, n in got.values())


def test_lm_model_against_brute_force_when_entries_exceed_the_former_bound(spark, monkeypatch):
    monkeypatch.setattr(lm, "MAX_BITS", 1 << 12, raising=False)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 700)
    texts = [*(" ".join(f"w{(i * k) % 41}" for k in range(1, 300)) for i in range(30)), "", prose(8, 900)]
    for order in (1, 2, 3, 4):
        most, mean = model_gap(spark, texts, order)
        assert most < 0.03 and mean < 0.01


def test_lm_scores_pairs_counted_once(spark):
    train = spark.createDataFrame([(1, "a b c d e f g h", 0)], "doc_id long, text string, held int")
    follow, shuffled = (spark.createDataFrame([(7, t)], "doc_id long, text string") for t in ("a b c d e f g h", "h g f e d c b a"))
    pair = lm.LAMBDA + (1 - lm.LAMBDA) * 2 / 19
    for order, want in ((2, 9 * math.log10(pair)), (3, math.log10(pair) + 8 * math.log10(lm.LAMBDA + (1 - lm.LAMBDA) * pair))):
        counts = lm.count_ngrams(train, order)
        near, far = (lm.score(d, counts, 1, order).first()["score"] for d in (follow, shuffled))
        assert near == pytest.approx(want) and near > far + 2


def test_lm_words_are_hashed_together(monkeypatch):
    import xxhash

    texts = [None, "", " \t", "A b\x0bB\x0cz", "a\x00 a\x00\x00 a", "É é \x85 \xa0", "\ud800 x", "a" * 7 + " " + "a" * 8 + " " + "a" * 9, "y" * 64, " ".join(f"w{i}" for i in range(50_000))]
    long = "z" * 65 + " " + "z" * 1000 + " " + "Z" * 65
    of = {}
    for piece in (1, 1 << 20):
        monkeypatch.setattr(lm, "PIECE", piece)
        for text, h in zip([*texts, long], lm.hashes([*texts, long])):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            assert len(h) == len(words) + 1 and h[-1] == lm.END and (h == lm.token_hashes(text)).all()
            assert all(of.setdefault(w, x) == x for w, x in zip(words, h.tolist()))
    assert len(set(of.values())) == len(of) > 50_000
    # No word of a common length is hashed by itself.
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", None)
    assert sum(map(len, lm.hashes(texts))) > 50_000


def test_lm_distinct_hashes_and_places():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 1000, 70_000):
        for h in (rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 50, n).astype(np.uint64) * np.uint64(1 << 50), rng.integers(0, 9, n).astype(np.uint64) + np.uint64(5 << 40)):
            for got, want in zip(lm._distinct(h), np.unique(h, return_inverse=True)):
                assert (got == want).all()


def test_lm_hashes_survive_packing():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, (1 << 64) - 1, 1000, np.uint64))
    segments = lm.Filter.segment(h)
    assert len(lm._unpack(lm._pack(h[:0]), 5)) == 0
    for s in np.unique(segments).tolist():
        own = h[segments == s]
        assert (lm._unpack(lm._pack(own), s) == own & lm.KEY).all() and len(lm._pack(own)) == 4 * len(own) + 64
    for n in (1, 1 << 16, (1 << 16) + 1, 1 << 24, (1 << 24) + 1):
        places = np.array([0, n // 2, n - 1])
        assert (lm._places(lm._unsigned(places, n), 3) == places).all()


def test_lm_reads_back_small_filters_exactly():
    for n in (1, 20, 40):
        h, level = lm.token_hashes(" ".join(f"a{i}" for i in range(n))), np.full(n + 1, 5)
        assert (lm.Segment.of(h, level).levels(h) == level).all()


def test_lm_segments_follow_their_entries():
    rng = np.random.default_rng(0)
    for n in (10, 1000, 300_000):
        h, level = rng.integers(0, (1 << 54) - 1, n, np.uint64), rng.integers(1, 9, n)
        s = lm.Segment.of(h, level)
        assert s.width >= level.sum() * lm.BITS_PER_ENTRY and (s.levels(h) >= level).all() and (s.levels(h) == level).mean() > 0.95


# 7


def test_codewords_are_apart():
    for k in (1, 2, 3, 4, 6, 9, 40):
        code = language.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k and set(np.unique(code)) <= {-1.0, 1.0}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op7_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.97 * n


def test_pieces_of_a_long_text_count_as_the_whole():
    for text in ("", "  a", "abc def", "Ärger, 漢字😀 x!! y", prose(4, 300), "é" * 50 + " . " * 9):
        whole = language.ngram_counts(text)
        for piece in (1, 2, 3, 7, len(text) or 1):
            got = language.ngram_counts(text, piece)
            assert (whole is None and got is None) or (whole == got).all()


def test_language_awkward(spark):
    docs = awkward(spark)
    rows = {r["doc_id"]: r for r in language.identify(docs, language.learn(docs), ["doc_id", "text"]).collect()}
    assert all((r["lang_pred"] == "und") == (not any(ch.isalpha() for ch in r["text"] or "")) for r in rows.values())
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert language.learn(empty(spark)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None, ["doc_id"]).collect()} == {"und"}
    assert language.identify(empty(spark), None, ["doc_id"]).count() == 0
    one = language.learn(docs.withColumn("lang", F.lit("xx")))
    assert {r["lang_pred"] for r in language.identify(docs, one, ["doc_id"]).collect()} == {"xx", "und"}


# 8


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 1), (4, 0), (6, 0), (8, 1), (99, 1)], "doc_id long, quality int")
    for y in (labels, labels.limit(0), labels.filter("quality = 1")):
        rows = quality.assess(docs, quality.learn(docs, y), ["doc_id"]).collect()
        assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.assess(empty(spark), quality.grow(np.zeros((0, 25)), np.zeros(0)), ["doc_id"]).count() == 0


def test_forest_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(quality.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    f = quality.grow(x[:3000], y[:3000])
    assert ((f.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


# 9


def test_best_fit_decreasing_against_one_by_one():
    r = random.Random(3)
    for _ in range(30):
        sizes = [r.randint(1, 60) for _ in range(120)]
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [(room, b) for b, room in enumerate(rooms) if room >= s]
            if fits:
                rooms[min(fits)[1]] -= s
            else:
                rooms.append(100 - s)
        runs = sharding.best_fit_decreasing(list(Counter(sizes).items()), 100, 10_000)
        assert 1 + max(b for _, b, _ in runs) == len(rooms)
        loads = Counter()
        for s, b, n in runs:
            loads[b] += s * n
        assert sorted(100 - v for v in loads.values()) == sorted(rooms)


def test_sharding(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(100 + i, prose(i, 40), "en", "a", 0, 9, "k", 7) for i in range(400)], SCHEMA))
    rows = sharding.shard_by_bytes(docs, 6).collect()
    assert len(rows) == docs.count()
    groups, loads = {}, Counter()
    for r in rows:
        groups.setdefault(bytes(r["grp"]), set()).add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in groups.values())
    for s in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    rest = sorted(loads.values())[:-1]  # the longest text has a shard of its own
    assert max(rest) - min(rest) < 0.05 * max(rest)
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


# 10


def brute_classes(rows):
    sets = [(i, frozenset(jaccard.ngram_set(t).tolist()) or frozenset([("text", t or "")])) for i, t in rows]
    near = [[a != b and len(x & y) >= 0.8 * len(x | y) - 1e-9 for b, (_, y) in enumerate(sets)] for a, (_, x) in enumerate(sets)]
    label = list(range(len(sets)))
    while True:
        new = [min([label[a], *(label[b] for b, hit in enumerate(near[a]) if hit)]) for a in range(len(sets))]
        if new == label:
            break
        label = new
    ids = {}
    for (i, _), c in zip(sets, label):
        ids[c] = min([i, ids.get(c, i)], key=lambda v: (v is not None, v))
    return sorted((str(i), str(ids[c]), sum(n)) for (i, _), c, n in zip(sets, label, near))


def test_jaccard_against_brute_force_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    base = prose(50, 150).split()
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark).filter("doc_id != 7 or doc_id is null").collect()]
    for i in range(70):
        words = list(base)
        words[(i * 7) % 150] = f"new{i}"
        rows.append((200 + i, " ".join(words[: 150 - i % 3])))
    rows += [(400 + i, prose(i % 40, 60)) for i in range(80)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_links string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard.jaccard_classes(df).collect())
    assert got == brute_classes(rows)
    assert jaccard.jaccard_classes(empty(spark)).count() == 0


def test_band_shape_reaches_its_recall():
    bands, rows = jaccard.band_shape()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 200


# pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(9001, "*** 123", "en", "src0", 7), (9002, None, None, None, None)], docs.schema))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at.collect()
        at = common.materialise(stage(spark, at, SF), name)
        after = at.collect()
        assert at.columns == docs.columns
        if name == "language_id":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {9001, 9002}
        if name == "quality":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
            assert len(bad & {r["doc_id"] for r in after}) <= 1 and len(after) > 0.6 * len(before)
        if name == "near_duplicates":
            kept = {c for _, c, _ in brute_classes([(r["doc_id"], r["text"]) for r in before])}
            assert sorted(str(r["doc_id"]) for r in after) == sorted(kept)
        if name == "mixing":
            assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert packed.select(F.sum("length")).first()[0] == packed.filter("start = 0").select(F.sum("doc_tokens")).first()[0]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicates_keeps_each_class_though_ids_are_null_or_shared(spark):
    import corpus_pipeline

    rows = [(None, prose(i, 60), "en", "a", 9) for i in range(5)] + [(7, prose(20, 60), "en", "a", 9), (7, prose(21, 60), "en", "a", 9)]
    rows += [rows[0], rows[5], (None, prose(30, 60), "en", "a", 9), (8, prose(30, 60), "en", "a", 9), (7, prose(40, 60), "en", "a", 9), (9, prose(40, 60) + " end", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert got == Counter({(r[0], r[1]): 1 for r in [*rows[:7], rows[10], rows[11]]})


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and very long texts, one id on several texts, repeated rows, clashing names, empty tables."""
    import corpus_pipeline
    from collections import defaultdict

    stages = dict(corpus_pipeline.STAGES)
    docs = awkward(spark).unionByName(spark.createDataFrame([(1, prose(77, 80), "en", "a", 0, 9, "k", 7), (2, "", "en", "a", 0, 9, "k", 7)] + [(50, prose(78, 80), "en", "z", 0, 9, "k", 7)] * 3, SCHEMA))
    docs = docs.withColumnsRenamed({"key": "text_hash", "rank": "block", "size": "draws"})
    key = lambda r: (r["doc_id"], r["text"] or "")
    every = Counter(map(key, docs.collect()))
    for name in ("language_id", "quality"):
        kept = Counter(map(key, (rows := stages[name](spark, docs, SF)).collect()))
        assert rows.columns == corpus_pipeline.COLUMNS and all(kept[k] == every[k] for k in kept)
    assert not {k for k in Counter(map(key, stages["language_id"](spark, docs, SF).collect())) if not any(ch.isalpha() for ch in k[1])}
    # One of each class, told by brute force over distinct rows.
    distinct = list(every)
    sets = [frozenset(jaccard.ngram_set(t).tolist()) or frozenset([t]) for _, t in distinct]
    label = list(range(len(distinct)))
    for _ in distinct:
        label = [min(label[b] for b in range(len(distinct)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9) for a in range(len(distinct))]
    classes = defaultdict(list)
    for k, c in zip(distinct, label):
        classes[c].append(k)
    got = Counter(map(key, stages["near_duplicates"](spark, docs, SF).collect()))
    assert set(got.values()) == {1} and all(sum(k in got for k in members) == 1 for members in classes.values())
    for members in classes.values():
        assert next(k for k in members if k in got)[0] == min((i for i, _ in members), key=lambda i: (i is None, i))
    # As often as the mix draws each, and in its order.
    mixed = Counter(map(key, stages["mixing"](spark, docs, SF).collect()))
    texts = {k: r for r in mixing.mix(docs).collect() for k in distinct if k[0] == r["doc_id"]}
    draws = Counter((r["doc_id"], r["text_hash"]) for r in mixing.mix(docs).collect())
    hashes = {key(r): r["h"] for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    assert mixed == Counter({k: draws[k[0], hashes[k]] for k in every}) and texts
    one = stages["mixing"](spark, docs.coalesce(1), SF)
    order = [hashes[key(r)] for r in common.materialise(one.coalesce(1), "one").collect()]
    wanted = defaultdict(list)
    for r in sorted(mixing.mix(docs).collect(), key=lambda r: (r["block"], r["place"])):
        wanted[r["block"]].append(r["text_hash"])
    while order:
        block = next(b for b, w in wanted.items() if order[: len(w)] == w)
        order = order[len(wanted.pop(block)) :]
    assert not wanted
    packed = stages["packing"](spark, docs, SF)
    assert packed.select(F.sum("length")).first()[0] == packed.filter("start = 0").select(F.sum("doc_tokens")).first()[0]
    for stage in stages.values():
        assert stage(spark, docs.limit(0), SF).count() == 0
