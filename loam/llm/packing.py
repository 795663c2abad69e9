"""Operator 4, packing: token sequences of a fixed window, planned by non-negative least squares.

A document's ids (byte-level BPE, then one end id 0) are cut into full windows, each a sequence of its own,
and a tail. The tails' lengths form a histogram of at most ``window - 1`` entries, counted over the whole corpus. All combinations of
two or three lengths at hand that fill a window exactly are enumerated; non-negative least squares finds how often
to repeat each so that the histogram is used up; the counts are rounded to whole ones that the histogram can pay for. The plan
is the corpus's: each tail's rank among all of its length, a task's own count added to those of the tasks before it, names the combination
and the place in it that the tail takes, wherever it is stored, so that no ids are moved and the number of tasks changes nothing.
Tails that no whole combination takes are packed greedily in their task, the longest first, cutting a piece
where a window is full. The last, unfilled window of a task is cut into sequences whose lengths are powers
of two, which need no padding.

Defined cases: a null text counts as empty and yields just the end id; repeated rows are packed once per row;
extra columns are ignored; an empty table gives no rows. A very long text is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import lean, materialise, shared_memory, small

WINDOW = 1024
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Tails packed greedily together in a task; bounds its memory at BLOCK * WINDOW * 4 bytes.
BLOCK = 8192
#: Distinct pieces of text whose ids a worker remembers, and the bytes by which it tells that a piece came before: one for each
#: place of a hash. A piece is remembered when it comes in a second batch; most never do.
CACHE, MARKS = 300_000, 1 << 22
#: The letters by which a byte-level tokenizer writes bytes that aren't printable in Latin-1.
LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    The tokenizer splits a text by a fixed pattern and encodes each piece alone. Pieces recur, so each is
    encoded once a batch, and those that come again are remembered. That is done only for texts of Latin letters and common signs, on which
    the pattern's character classes are beyond doubt; other texts go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The public byte-level tokenizer's split pattern, its classes of letters and numbers spelled out for Latin text.
        word, number = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
        self.pieces = re.compile(rf" ?[{word}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{word}{number}]+|\s+(?!\S)|\s+").findall
        self.odd = re.compile(r"[^\x09\x0A\x0D\x20-\x7E¡-¬®-ſ‐-―‘-‟]").search
        self.known: dict[str, bytes] = {}
        self.met = np.zeros(MARKS, bool)
        self.model = self.tokenizer.model

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """By the tokenizer's model, which takes a piece's bytes as letters; nothing is split once more. No piece holds a zero byte."""
        tokenize = self.model.tokenize
        letters = "\0".join(pieces).encode().decode("latin-1").translate(LETTERS).split(LETTERS[0])
        return {p: array("I", [t.id for t in tokenize(x)]).tobytes() for p, x in zip(pieces, letters)}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as 32-bit numbers (little-endian, as are all machines Spark runs on today)."""
        known = self.known
        split = [None if self.odd(t) else self.pieces(t) for t in texts]
        found = self._encode_pieces(list(set().union(*(p for p in split if p is not None)).difference(known)))
        self._remember(found)
        for text, pieces in zip(texts, split):
            if pieces is None:
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                yield b"".join([known[p] if p in known else found[p] for p in pieces])

    def _remember(self, found: dict[str, bytes]) -> None:
        """Those of the new pieces that an earlier batch held (or one of the same hash, which does no harm), as long as there is room."""
        marks = np.fromiter(map(hash, found), np.int64, len(found)) % MARKS
        again = self.met[marks].tolist()
        self.met[marks] = True
        self.known.update(islice(compress(found.items(), again), max(CACHE - len(self.known), 0)))


_encoders: dict[str, Encoder] = {}
shared_memory["tokens"] = _encoders.clear


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids cut into windows and a tail: doc_id, start, length, doc_tokens, ids (little-endian uint32), the
    task that cut it, the piece's rank among the task's pieces of that length and its number among all of the task."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, task, seen, cut_before = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, start, length, total, blob, nth = [], [], [], [], [], []
            for i, tokens in enumerate(enc.encode(texts)):
                raw, n = tokens + END_ID.to_bytes(4, "little"), len(tokens) // 4 + 1
                for s in range(0, n, window):
                    m = min(window, n - s)
                    row.append(i)
                    start.append(s)
                    length.append(m)
                    total.append(n)
                    blob.append(raw[4 * s : 4 * (s + window)])
                    nth.append(int(seen[m]))
                    seen[m] += 1
            longs = [pa.array(x, pa.int64()) for x in (start, length, total)]
            number = pa.array(np.arange(cut_before, cut_before + len(row)))
            cut_before += len(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *longs, pa.array(blob, pa.binary()), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64()), number],
                names=["doc_id", "start", "length", "doc_tokens", "ids", "task", "nth", "number"],
            )

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(lean(cut, keep="tokens"), f"doc_id {id_type}, start long, length long, doc_tokens long, ids binary, task int, nth long, number long")


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of (a, b, c), a >= b >= c, that sum to the window; a and b are of ``lengths``, c too or 0 (a pair). At most about window^2 / 12."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    c, b = np.meshgrid(np.arange(window // 3 + 1), np.arange(1, window), indexing="ij")
    a = window - b - c
    fine = (a >= b) & (b >= c) & there[b] & there[np.maximum(a, 0)] & (there[c] | (c == 0))
    return np.stack([a[fine], b[fine], c[fine]], 1)


def nnls_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400, gain: float = 0.02) -> np.ndarray:
    """Non-negative counts x that minimise |A x - h|, A[l, j] the times combination j uses length l.

    Accelerated projected gradient; A has at most three entries a column and is never made dense. The step
    is the inverse of a bound on A'A's largest eigenvalue (largest row sum times largest column sum). Ends once 20 rounds
    lower what is left of the histogram by less than ``gain`` of it.
    """
    used = combos > 0
    size = len(histogram)

    def forward(x):
        return np.bincount(combos[used], np.broadcast_to(x[:, None], combos.shape)[used], size)

    def backward(r):
        return np.where(used, r[combos], 0.0).sum(1)

    bound = forward(np.ones(len(combos))).max() * 3
    x = y = np.zeros(len(combos))
    t, left = 1.0, np.inf
    for i in range(rounds):
        new = np.maximum(0.0, y - backward(forward(y) - histogram) / bound)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / nt * (new - x), new, nt
        if i % 20 == 19:
            now = np.abs(forward(x) - histogram).sum()
            if now > left * (1 - gain):
                break
            left = now
    return x


def whole_counts(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """``x`` rounded to whole counts that use no length more often than the histogram holds it: first the whole parts, the
    largest counts first, then one more of each, the largest remainders first, as long as its lengths are left."""
    left, out = histogram.tolist(), np.zeros(len(combos), np.int64)
    whole = np.floor(x + 1e-9).astype(np.int64)
    needs = combos.tolist()
    for order, want in ((np.argsort(-x, kind="stable"), whole), (np.argsort(whole - x, kind="stable"), np.ones_like(whole))):
        for j in order[want[order] > 0].tolist():
            parts = [c for c in needs[j] if c]
            n = min(int(want[j]), *(left[c] // parts.count(c) for c in parts))
            if n:
                out[j] += n
                for c in parts:
                    left[c] -= n
    return out


def recipe(histogram: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often each is packed."""
    h = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        h[length] = n
    combos = combinations(window, np.flatnonzero(h))
    if not len(combos):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    counts = whole_counts(combos, nnls_counts(combos, h.astype(float)), h)
    return combos[counts > 0], counts[counts > 0]


class Plan:
    """Who takes part in which sequence: the tails of a length, by rank, fill the places for it of one combination after another."""

    SPAN = 1 << 44

    def __init__(self, combos: np.ndarray, counts: np.ndarray):
        slot = np.broadcast_to(np.arange(3), combos.shape)
        places = [(length, j) for j, combo in enumerate(combos.tolist()) for length in dict.fromkeys(c for c in combo if c)]
        self.length, self.combo = (np.array(v, np.int64) for v in zip(*sorted(places))) if places else (np.zeros(0, np.int64),) * 2
        uses = combos[self.combo] == self.length[:, None]
        self.times = uses.sum(1)
        taken = counts[self.combo] * self.times
        upto = np.cumsum(taken)
        first = np.searchsorted(self.length, self.length)
        self.start = upto - taken - (upto - taken)[first]
        self.taken, self.keys = taken, self.length * self.SPAN + self.start
        before = np.cumsum(combos, 1) - combos
        self.offset = before[self.combo, np.where(uses, slot[self.combo], 3).min(1, initial=3)] if len(places) else self.length
        self.base = np.cumsum(counts) - counts

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For tails of these lengths and ranks: whether the plan takes them, the sequence's number and the offset in it."""
        if not len(self.keys):
            return np.zeros(len(length), bool), np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        at = np.maximum(np.searchsorted(self.keys, length * self.SPAN + rank, "right") - 1, 0)
        into = rank - self.start[at]
        taken = (self.length[at] == length) & (into >= 0) & (into < self.taken[at])
        times = self.times[at]
        return taken, self.base[self.combo[at]] + into // times, self.offset[at] + into % times * length


def pack_rest(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences over tails 0..n-1, each a list of (tail, from, length): the longest first, cut where the window is full; all but the last few are full."""
    out, current, room = [], [], window
    for i in np.argsort(-lengths, kind="stable").tolist():
        at, n = 0, int(lengths[i])
        while at < n:
            m = min(room, n - at)
            current.append((i, at, m))
            at, room = at + m, room - m
            if not room:
                out.append(current)
                current, room = [], window
    if current:
        # Powers of two, the largest first, from what is left of the window.
        left = window - room
        want = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        got, room = [], want[0]
        for i, at, n in current:
            while n:
                m = min(room, n)
                got.append((i, at, m))
                at, n, room = at + m, n - m, room - m
                if not room:
                    out.append(got)
                    want = want[1:]
                    got, room = [], want[0] if want else 0
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids and places: doc_id, start, length, doc_tokens, ids, sequence_id, offset. Sequences of the plan are
    numbered from 0; each of those that a task makes by itself (full windows, what the plan leaves) is numbered by its first piece, as the
    stored table of pieces names it, and where in that piece it begins. So numbers are the same whatever is done to the result."""
    pieces = materialise(token_pieces(docs, tokenizer_path, window, id_col, text_col), "pieces", whole_partitions=True)
    counts = pieces.filter(F.col("length") < window).groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = materialise(counts.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "ahead")
    histogram = ahead.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most window - 1 rows
    plan = Plan(*recipe({r["length"]: r["n"] for r in histogram}, window))
    ranked = pieces.join(small(ahead.drop("n")), ["length", "task"], "left").select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("nth") + F.col("ahead")).alias("rank"), ((F.col("task") + 1).cast("long") * (1 << 40) + F.col("number") * (1 << 10)).alias("name"))

    def place(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]

        def packed(held):
            table = pa.Table.from_batches(held)
            lengths, starts, blobs, name = table.column(2).to_numpy(), table.column(1).to_numpy(), table.column(4).to_pylist(), table.column(6).to_numpy()
            row, start, length, blob, seq, offset = [], [], [], [], [], []
            for pieces_of in pack_rest(lengths, window):
                at, number = 0, int(name[pieces_of[0][0]]) + pieces_of[0][1]
                for i, a, n in pieces_of:
                    row.append(i)
                    start.append(starts[i] + a)
                    length.append(n)
                    blob.append(blobs[i] if n == lengths[i] else blobs[i][4 * a : 4 * (a + n)])
                    seq.append(number)
                    offset.append(at)
                    at += n
            take = pa.array(row, pa.int64())
            cols = [table.column(0).take(take), pa.array(start, pa.int64()), pa.array(length, pa.int64()), table.column(3).take(take), pa.array(blob, pa.binary()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            yield from pa.Table.from_arrays(cols, names=names).to_batches(500)

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(2).to_numpy(), batch.column(5).fill_null(0).to_numpy()
            full = length == window
            taken, seq, offset = plan.places(length, rank)
            taken |= full
            seq[full], offset[full] = batch.column(6).to_numpy()[full], 0
            known, batch = batch.filter(pa.array(taken)), batch.filter(pa.array(~taken))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([*known.columns[:5], pa.array(seq[taken]), pa.array(offset[taken])], names=names)
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(lean(place, 2048), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))
