"""Operator 6, language-model scoring with n-gram counts in a log-frequency Bloom filter.

Tokens are ASCII-lower-cased words between white space and one end per document. N-grams of 1 to ``ORDER`` neighbouring
tokens are counted over all training documents: a task sorts and counts blocks of them by their 64-bit hashes and sends each
block, cut by segment of the hash, as packed bytes through one shuffle. There and in the filter an n-gram is told by the
first 46 bits of its hash, 10 of them its segment; longer n-grams that share them pass for one, which is rarer than a false positive. A count c is quantised to the
level 1 + floor(log c / log BASE), and the filter holds (n-gram, j) for each j up to its level; probing j = 1, 2, ...
until one is missing gives the level back, which false positives can only raise. The filter is cut into
``SEGMENTS`` segments by hash. Each is as wide as its own entries need, without a bound, and is built by the task that sums
its n-grams; the filter is a table and never in one place. A block of documents sends its distinct n-grams to their
segments in a shuffle and has their levels sent back. Blocks are cut twice, once to ask and once to score, instead of being
written; the table's partitions and their order must be the same both times, as those of files are, or the job fails.

The model interpolates: P_1(w) = (c(w) + 1) / (N + V + 1), and P_n(w | v) = LAMBDA * c(v, w) / C(v) + (1 - LAMBDA) * P_n-1(w), or P_n-1
itself where the context v was never seen. Counts c are the least of their levels, N the sum of those of words, and C
the largest count of a level, so that no context's followers have more than all of the odds.

The base score uses exact counts. Those of the most frequent words (``TOP``, a bound) are broadcast; other
words of each document are joined to the count table in a shuffle.

Defined cases: a null text counts as empty (one end token); without training documents all counts are 0; a null id is trained
and folded as the empty id; repeated rows are scored and counted each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import doc_fold, lean, materialise, n_parts

BASE, LAMBDA, ORDER = 1.5, 0.4, 3
BITS_PER_ENTRY, PROBES, SEGMENTS = 12, 4, 1024
#: Bits of the smallest segment, 256 KB in all: in fewer, a step has so few places that false positives outnumber the design's.
LEAST_WIDTH = 2048
TOP = 1 << 18
BLOCK_TOKENS = 1_000_000
#: Bytes of texts that are cut into words at a time.
PIECE = 1 << 20
#: 10 bits of the segment and 36 more.
KEY = ~np.uint64((1 << 18) - 1)
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)


GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True
#: The first n bytes of a little-endian word.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, its length and 8 bytes after 8 mixed in; words of one length up to 8 have one each. ``raw`` goes on for 8 bytes after the last."""
    import xxhash

    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    sizes = ends - starts
    out = sizes.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    left, at = np.flatnonzero(sizes <= 64), 0
    while len(left):
        out[left] = _mix(out[left] + (eight[starts[left] + at] & FIRST[np.minimum(sizes[left] - at, 8)])) * np.uint64(0x9E3779B97F4A7C15)
        at += 8
        left = left[sizes[left] > at]
    out = _mix(out)
    for i in np.flatnonzero(sizes > 64).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


def _piece_hashes(texts: list[bytes]) -> list[np.ndarray]:
    raw = b" " + b" ".join(texts).lower() + b" " * 9
    gap = GAP[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))  # words of the texts so far
    stops = upto + np.arange(len(texts))
    out, word = np.full(len(starts) + len(texts), END), np.ones(len(starts) + len(texts), bool)
    word[stops] = False
    out[word] = _word_hashes(raw, starts, ends)
    return np.split(out, stops[:-1] + 1)


def hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Each text's words, then the end."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= PIECE:
            yield from _piece_hashes(held)
            held, size = [], 0
    if held:
        yield from _piece_hashes(held)


def token_hashes(text: str | None) -> np.ndarray:
    return next(hashes([text]))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and each given one's place among them: np.unique's, which takes four times as long, from one sort of first bits and places."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    keys = np.sort(h & ~low | np.arange(len(h), dtype=np.uint64))
    at = (keys & low).astype(np.int64)
    own, done = h[at], 0
    # The few that differ in last bits only are in the order of their places still.
    for i in np.flatnonzero(own[1:] < own[:-1]).tolist():
        if i >= done:
            start, done = np.searchsorted(keys, keys[i] & ~low), np.searchsorted(keys, keys[i] | low, "right")
            at[start:done] = at[start:done][np.argsort(own[start:done], kind="stable")]
            own[start:done] = h[at[start:done]]
    first = np.append(True, own[1:] != own[:-1])
    place = np.empty(len(h), np.int64)
    place[at] = np.cumsum(first) - 1
    return own[first], place


def gram_hashes(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order, the hash of the n-gram that ends at each token; a START of its length before the first of each document."""
    out = [tokens]
    for size in range(1, order):
        before = np.empty_like(tokens)
        before[1:] = out[-1][:-1]
        before[starts] = START + np.uint64(size)
        out.append(_mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens))
    return out


def _pack(h: np.ndarray) -> bytes:
    """The 36 bits that tell a segment's sorted hashes: how many have each value of the first 4, then the other 32."""
    v = h >> np.uint64(18)
    return np.bincount((v >> np.uint64(32)).astype(np.int64) & 15, minlength=16).astype("<u4").tobytes() + v.astype("<u4").tobytes()


def _unpack(raw: bytes, segment: int) -> np.ndarray:
    """Those hashes without the last 18 bits."""
    first = np.repeat(np.arange(16, dtype=np.uint64), np.frombuffer(raw, "<u4", 16)) + np.uint64(segment << 4)
    return (first << np.uint64(32) | np.frombuffer(raw, "<u4", offset=64)) << np.uint64(18)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The least whole count of a level."""
    return np.where(levels > 0, np.ceil(BASE ** (np.maximum(levels, 1) - 1) - 1e-9), 0)


def most_of(levels: np.ndarray) -> np.ndarray:
    """The largest whole count of a level."""
    return np.where(levels > 0, np.ceil(BASE ** np.maximum(levels, 1) - 1e-9) - 1, 0)


class Filter:
    """Bits in SEGMENTS segments of ``width`` bits (a power of two, at least 64) each."""

    def __init__(self, width: int, words: np.ndarray | None = None):
        self.width = width
        self.words = np.zeros(SEGMENTS * width // 8, np.uint8) if words is None else words

    @staticmethod
    def segment(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(54)).astype(np.int64)

    def places(self, h: np.ndarray, j) -> list[np.ndarray]:
        a = _mix((h & KEY) + np.uint64(0xA0761D6478BD642F) * np.asarray(j).astype(np.uint64))
        b = (a >> np.uint64(33)) | np.uint64(1)
        return [((a + np.uint64(i) * b) & np.uint64(self.width - 1)).astype(np.int64) for i in range(PROBES)]

    def levels(self, h: np.ndarray, most: int = 80) -> np.ndarray:
        """The level of each n-gram by repeated membership probes, 0 if it isn't held."""
        out, alive, offset = np.zeros(len(h), np.int64), np.arange(len(h)), self.segment(h) * self.width
        j = 1
        while len(alive) and j <= most:
            hit = np.ones(len(alive), bool)
            for p in self.places(h[alive], j):
                at = offset[alive] + p
                hit &= (self.words[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            alive = alive[hit]
            out[alive] = j
            j += 1
        return out


class Segment(Filter):
    """One segment by itself."""

    @staticmethod
    def segment(h: np.ndarray) -> np.ndarray:
        return np.zeros(len(h), np.int64)

    @classmethod
    def of(cls, h: np.ndarray, level: np.ndarray) -> "Segment":
        """Holds n-grams, each up to its level."""
        width = LEAST_WIDTH
        while width < int(level.sum()) * BITS_PER_ENTRY:
            width *= 2
        out, on, j = cls(width, np.zeros(0, np.uint8)), np.zeros(width, bool), 1
        while len(h):
            for p in out.places(h, j):
                on[p] = True
            j += 1
            h, level = h[level >= j], level[level >= j]
        out.words = np.packbits(on, bitorder="little")
        return out


def _summed(h: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sums of their counts."""
    h, c = np.concatenate(h), np.concatenate(c)
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def _build(batches):
    """(segment, words, h, c), by segment: each row a block's n-grams and counts, words first, in full. Gives words with their counts, and the segments of the filter."""
    import pyarrow as pa

    names, at, rows = ["size", "h", "c", "bits"], None, []

    def done():
        counts = [np.frombuffer(c, np.uint32).astype(np.int64) for _, _, c in rows]
        word, word_c = _summed([np.frombuffer(h, np.uint64, n) for n, h, _ in rows], [c[:n] for (n, _, _), c in zip(rows, counts)])
        rest, rest_c = _summed([_unpack(h[8 * n :], at) for n, h, _ in rows], [c[n:] for (n, _, _), c in zip(rows, counts)])
        if len(word):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(word), np.int8)), pa.array(word.view(np.int64)), pa.array(word_c), pa.nulls(len(word), pa.binary())], names=names)
        bits = Segment.of(np.concatenate([word, rest]), level_of(np.concatenate([word_c, rest_c]))).words.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([at], pa.int64()), pa.array([len(word) + len(rest)], pa.int64()), pa.array([bits], pa.binary())], names=names)

    for batch in batches:
        for segment, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != at:
                if rows:
                    yield from done()
                at, rows = segment, []
            rows.append(row)
    if rows:
        yield from done()


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(size, h, c, bits) over all training rows (id, text): the words (size 1) with their counts and the filter's
    segments (size 0; h is the segment, c its n-grams), which hold all n-grams up to the order."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def flush():
            tokens, _, starts = _starts(held)
            grams = gram_hashes(tokens, starts, order)
            (one, one_c), (more, more_c) = (np.unique(g, return_counts=True) for g in (tokens, np.concatenate([tokens[:0], *grams[1:]])))
            one_at, more_at = _cuts(one), _cuts(more)
            for a in range(0, SEGMENTS, 128):
                own = range(a, a + 128)
                parts = [(slice(one_at[s], one_at[s + 1]), slice(more_at[s], more_at[s + 1])) for s in own]
                h = [one[a].tobytes() + _pack(more[b]) for a, b in parts]
                c = [np.concatenate([one_c[a], more_c[b]]).astype(np.uint32).tobytes() for a, b in parts]
                words = pa.array(np.diff(one_at[own.start : own.stop + 1]), pa.int32())
                some = pa.array([bool(x) for x in c])
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), words, pa.array(h, pa.binary()), pa.array(c, pa.binary())], names=["segment", "words", "h", "c"]).filter(some)

        for batch in batches:
            for tokens in hashes(batch.column(0).to_pylist()):
                held.append(tokens)
                n += len(held[-1])
                if n >= BLOCK_TOKENS:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    rows = docs.select("text").mapInArrow(lean(run), "segment int, words int, h binary, c binary")
    spread = rows.repartition(n_parts(docs.sparkSession), "segment").sortWithinPartitions("segment")
    return materialise(spread.mapInArrow(lean(_build, 2000), "size byte, h long, c long, bits binary"), "counts")


def _level() -> F.Column:
    return (1 + F.floor(F.log(F.col("c").cast("double")) / float(np.log(BASE)) + 1e-9)).cast("int")


def level_histogram(words: DataFrame) -> list:
    """Numbers of words by level: as many rows as there are levels."""
    return words.groupBy(_level().alias("level")).agg(F.count("*").alias("n")).collect()


def frequent_level(histogram: list) -> int:
    """The least level whose words, with all above, are at most TOP."""
    held, least = 0, 1_000
    for level, n in sorted(((r["level"], r["n"]) for r in histogram), reverse=True):
        held += n
        if held > TOP:
            break
        least = level
    return least


def _probe(batches):
    """(segment, block, data), by segment and block: a segment's bits first, then each block's n-grams; gives their levels, compressed."""
    import pyarrow as pa
    import zstandard

    packer = zstandard.ZstdCompressor(level=1, write_checksum=False)
    at, held = None, None
    for batch in batches:
        segments, blocks, data = (batch.column(i).to_pylist() for i in range(3))
        i, out = 0, []
        while i < len(segments):
            if segments[i] != at:
                at, held = segments[i], None
            if blocks[i] is None:
                held = Segment(8 * len(data[i]), np.frombuffer(data[i], np.uint8))
                i += 1
                continue
            j = i
            while j < len(segments) and segments[j] == at:
                j += 1
            h = np.concatenate([_unpack(d, at) for d in data[i:j]])
            levels = (held.levels(h) if held else np.zeros(len(h))).astype(np.uint8)
            ends = np.cumsum([len(d) // 4 - 16 for d in data[i:j]])
            out += [(at, block, packer.compress(part.tobytes())) for block, part in zip(blocks[i:j], np.split(levels, ends[:-1]))]
            i = j
        if out:
            s, k, v = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int64()), pa.array(v, pa.binary())], names=["segment", "block", "levels"])


def _unsigned(x: np.ndarray, n: int) -> bytes:
    """Places among n in as few bytes as they need."""
    width = 2 if n <= 1 << 16 else 3 if n <= 1 << 24 else 4
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _places(raw: bytes, n: int) -> np.ndarray:
    out, width = np.zeros((n, 4), np.uint8), len(raw) // n
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
    return out.view("<u4").ravel()


def _blocks(batches, block):
    """Cuts a task's (id, text) rows into blocks of about BLOCK_TOKENS tokens; yields what block(uid, ids, tokens of each text) does."""
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts, first, n = [], 0, 0
        for i, tokens in enumerate(hashes(batch.column(1).to_pylist())):
            texts.append(tokens)
            n += len(texts[-1])
            if n >= BLOCK_TOKENS or i == batch.num_rows - 1:
                yield from block(uid, batch.column(0).slice(first, len(texts)), texts)
                uid += len(texts)
                first, texts, n = i + 1, [], 0


def _starts(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    return np.concatenate(texts), sizes, np.cumsum(sizes) - sizes


def _cuts(h: np.ndarray) -> np.ndarray:
    """Where each segment begins among sorted hashes, and their number."""
    return np.append(np.searchsorted(Filter.segment(h), np.arange(SEGMENTS)), len(h))


def _ask(order: int):
    """(segment, block, data): a block's n-grams, each once, by segment, sorted."""

    def block(uid, ids, texts):
        import pyarrow as pa

        tokens, _, starts = _starts(texts)
        grams = np.sort(np.concatenate(gram_hashes(tokens, starts, order)))  # np.unique alone would hash, and take 30 times as long
        grams = grams[np.concatenate([[True], grams[1:] != grams[:-1]])]
        cuts = _cuts(grams)
        filled = np.flatnonzero(np.diff(cuts))
        data = [_pack(grams[cuts[s] : cuts[s + 1]]) for s in filled]
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(np.full(len(filled), uid, np.int64)), pa.array(data, pa.binary())], names=["segment", "block", "data"])

    return lambda batches: _blocks(batches, block)


def _finish(mass: float, vocabulary: int, training_docs: int, order: int):
    """(block, segment, levels, splits, places, and lists over the block's documents), by block and segment, a block's own row first."""

    def scores(sizes, splits, places, parts):
        starts, n = np.cumsum(sizes) - sizes, int(sizes.sum())
        split = np.frombuffer(splits, np.int32)
        if [(s, len(v)) for s, v in parts] != [(s, split[s]) for s in np.flatnonzero(split)]:
            raise RuntimeError("the documents' partitions changed between two readings")
        levels = np.concatenate([v for _, v in parts]).astype(np.int64)
        place = np.arange(n) - np.repeat(starts, sizes)
        odds = context = None
        for size in range(order):
            level = levels[_places(places[size], n)]
            if size == 0:
                odds = (count_of(level) + 1) / (mass + vocabulary + 1)
            else:
                share = np.minimum(1.0, count_of(level) / np.maximum(context, 1.0))
                odds = np.where(context > 0, LAMBDA * share + (1 - LAMBDA) * odds, odds)
            context = np.empty(n)
            context[1:] = most_of(level)[:-1]
            context[starts] = training_docs
            context[place < size] = 0  # the next longer n-gram would begin before the document
        return np.add.reduceat(np.log10(odds), starts)

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        names = ["doc_id", "n_tokens", "known", "base", "rest"]
        own, parts = None, []

        def done():
            uid, splits, places, columns = own
            score = scores(columns[1].to_numpy(), splits, places, parts)
            return pa.RecordBatch.from_arrays([*columns, pa.array(uid + np.arange(len(score))), pa.array(score)], names=[*names, "uid", "score"])

        for batch in batches:
            blocks, segments = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                if segments[i] is None:
                    if own:
                        yield done()
                    own, parts = (blocks[i], *(batch.column(c)[i].as_py() for c in (3, 4)), [batch.column(c)[i].values for c in range(5, 10)]), []
                else:
                    parts.append((segments[i], np.frombuffer(unpacker.decompress(batch.column(2)[i].as_py()), np.uint8)))
        if own:
            yield done()

    return run


def _release(spark) -> None:
    """Has Spark delete the shuffle files of tables already written; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # Python lets go of the JVM's objects in the background, after the first round
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def score(docs: DataFrame, counts: DataFrame, training_docs: int, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row; ``order`` at most that of the counts."""
    spark = docs.sparkSession
    _release(spark)
    words = counts.filter("size = 1").select("h", "c")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, vocabulary = int(totals["n"]), int(totals["v"])
    below = float(np.log10(n_train + vocabulary + 1))
    histogram = level_histogram(words)
    mass = float(sum(count_of(np.array([r["level"]]))[0] * r["n"] for r in histogram))
    top = words.filter(_level() >= frequent_level(histogram)).toPandas()
    by_hash = np.argsort(top["h"].to_numpy().view(np.uint64), kind="stable")
    shared = spark.sparkContext.broadcast((top["h"].to_numpy().view(np.uint64)[by_hash], top["c"].to_numpy()[by_hash].astype(float)))
    kind = docs.schema[id_col].dataType.simpleString()
    whole = vocabulary <= TOP

    def run(batches):
        import pyarrow as pa

        top_h, top_c = shared.value

        def block(uid, ids, texts):
            tokens, sizes, starts = _starts(texts)
            one, inverse = _distinct(tokens)
            # Exact counts of frequent words.
            at = np.minimum(np.searchsorted(top_h, one), max(len(top_h) - 1, 0))
            found = top_h[at] == one if len(top_h) else np.zeros(len(one), bool)
            exact = np.where(found, top_c[at], 0.0) if len(top_h) else np.zeros(len(one))
            base = np.where(found | whole, np.log10(exact + 1) - below, 0.0)[inverse]
            known = np.add.reduceat(found[inverse].astype(np.int64), starts)
            rest = ~(found[inverse] | whole)
            ends = np.concatenate([[0], np.cumsum(np.add.reduceat(rest.astype(np.int64), starts))]).astype(np.int32)
            grams, at = _distinct(np.concatenate(gram_hashes(tokens, starts, order)))
            splits = np.diff(_cuts(grams)).astype(np.int32)
            places = [_unsigned(x, len(grams)) for x in np.split(at, order)]
            lists = [ids, pa.array(sizes), pa.array(known), pa.array(np.add.reduceat(base, starts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[rest].view(np.int64)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uid]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([splits.tobytes()]), pa.array([places], pa.list_(pa.binary())), *(pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), x) for x in lists)],
                names=["block", "segment", "levels", "splits", "places", "ids", "n_tokens", "known", "base", "rest"],
            )

        yield from _blocks(batches, block)

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n = n_parts(spark)
    bits = counts.filter("size = 0").select(F.col("h").cast("int"), F.lit(None).cast("long"), "bits")
    # The documents come first in both unions: a block is named by its partition's number there.
    asked = narrow.mapInArrow(lean(_ask(order), 2000), "segment int, block long, data binary").union(bits).repartition(n, "segment").sortWithinPartitions("segment", "block")
    levels = materialise(asked.mapInArrow(lean(_probe, 2000), "segment int, block long, levels binary"), "levels")
    del asked
    _release(spark)
    lists = {"ids": kind, "n_tokens": "long", "known": "long", "base": "double", "rest": "array<long>"}
    own = narrow.mapInArrow(lean(run, 2000), "block long, segment int, levels binary, splits binary, places array<binary>, " + ", ".join(f"{c} array<{t}>" for c, t in lists.items()))
    nulls = [F.lit(None).cast(f.dataType) for f in own.schema.fields[3:]]
    own = own.union(levels.select("block", "segment", "levels", *nulls)).repartition(n, "block").sortWithinPartitions("block", "segment")
    scored = own.mapInArrow(lean(_finish(mass, vocabulary, training_docs, order), 2000), f"doc_id {kind}, n_tokens long, known long, base double, rest array<long>, uid long, score double")
    scored = materialise(scored, "scored")
    del own
    _release(spark)
    rare = scored.select("uid", F.explode("rest").alias("h")).join(words, "h", "left")
    added = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1) - below).alias("rare_base"), F.count("c").alias("rare_known"))
    return scored.join(added, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def held_out(doc_id) -> F.Column:
    return doc_fold(doc_id) % 7 == 2


def op6_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = count_ngrams(training)
    scored = score(docs, counts, training.count())
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
