"""Operator 12, benchmark decontamination: texts are streamed through a suffix automaton of all test items.

The generalised suffix automaton holds every run of consecutive words of every item once. Walking a text through it keeps, at
each word, the longest run ending there that some item holds. Where that is at least a window's length, the window's state
names the items that hold it; items shorter than a window are met whole, by the marks on the states above. Words in such
runs are hit; ``clean`` cuts the hit spans out of the texts and drops texts with too large a share of hit words.

Items are dealt, by prefix sums of their words, to blocks of ``BLOCK_WORDS`` words; one task builds a block's automaton, whose size
is thus bounded, and one block at a time is broadcast. With one block (any benchmark of up to a megabyte) a text's result comes out of the
scan that reads it; with more, every block is a scan of its own, only hit texts' spans are kept, and they
meet their rows by the text's digest. Items that are longer than a block are cut into overlapping pieces, so that no window is lost.

Defined cases: null texts have no words, as do items without any, which match nothing; rows that repeat are rows of their own; items that repeat, or
share an id, count once by their id; an item without an id hits words but isn't listed; texts of any length are cut into words
a piece at a time; extra columns are ignored; without documents there are no rows, without items nothing is hit.
"""

from __future__ import annotations

import pickle
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import lean, materialise, ranked
from loam.llm.words import TABLE, word_lists, words

WINDOW = 10
BLOCK_WORDS = 1 << 17


class Automaton:
    """A generalised suffix automaton over word numbers, with the items that each window and each short item is found by."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.length, self.link, self.following = [0], [-1], [{}]
        runs = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in run]) for name, run in items]
        for _, run in runs:
            last = 0
            for w in run:
                last = self._extend(last, w)
        self._mark(runs)

    def _state(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.following.append(following)
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of the run so far with ``w`` behind it; ``last`` is the state of the run so far."""
        there = self.following[last].get(w)
        if there is not None:  # another item has this run already
            return there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and w not in self.following[at]:
            self.following[at][w] = new
            at = self.link[at]
        if at >= 0:
            there = self.following[at][w]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._split(at, w, there)
        return new

    def _split(self, at: int, w: int, there: int) -> int:
        """Takes the runs of at most length[at] + 1 words out of the state ``there`` into one of their own."""
        part = self._state(self.length[at] + 1, self.link[there], dict(self.following[there]))
        self.link[there] = part
        while at >= 0 and self.following[at].get(w) == there:
            self.following[at][w] = part
            at = self.link[at]
        return part

    def _mark(self, runs) -> None:
        """``items``: by state, who holds its window; ``short``: by state, (length, item) of items shorter than a window that end as it does;
        ``nearest``: by state, itself or the nearest one above with such items, or 0."""
        self.items, self.short = {}, {}
        for name, run in runs:
            at = held = 0
            for w in run:
                at, held = self.following[at][w], held + 1
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                held = min(held, self.length[at])
                if held >= self.window:
                    self.items.setdefault(at, set()).add(name)
            if 0 < len(run) < self.window:
                self.short.setdefault(at, set()).add((len(run), name))
        self.nearest = [0] * len(self.length)
        for at in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.nearest[at] = at if at in self.short else self.nearest[self.link[at]]

    def _whole(self, at: int, held: int):
        """(length, item) of the short items that a run of ``held`` words in state ``at`` ends with."""
        mark = self.nearest[at]
        while mark:
            yield from (x for x in self.short[mark] if x[0] <= held)
            mark = self.nearest[self.link[mark]]

    def scan(self, text: bytes | None) -> tuple[int, list[list[int]], set, int]:
        """Number of words, hit spans [from, to) in words, items met, and the longest run of words that an item holds."""
        following, link, length, nearest, window = self.following, self.link, self.length, self.nearest, self.window
        number, spans, windows, names, longest = self.vocabulary.get, [], set(), set(), 0
        n = at = held = 0

        def hit(start, end):
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        for some in word_lists(text):
            for w in map(number, some):
                n += 1
                if w is None:
                    at = held = 0
                    continue
                to = following[at].get(w)
                while to is None and at:
                    at = link[at]
                    held = length[at]
                    to = following[at].get(w)
                if to is None:
                    at = held = 0
                    continue
                at, held = to, held + 1
                if held > longest:
                    longest = held
                if held >= window:
                    hit(n - window, n)
                    windows.add(at)
                if nearest[at]:
                    for m, name in self._whole(at, held):
                        hit(n - m, n)
                        names.add(name)
        for at in windows:
            while length[link[at]] >= window:
                at = link[at]
            names |= self.items[at]
        names.discard(None)
        return n, spans, names, longest


def pieces_of(name: str | None, run: list[bytes], most: int, window: int = WINDOW) -> list[tuple[str | None, list[bytes]]]:
    """The item's words in pieces of at most ``most``, each repeating the last window - 1 words of the one before."""
    step = max(1, most - window + 1)
    return [(name, run[a : a + most]) for a in range(0, max(1, len(run) - window + 1), step)] if len(run) > most else [(name, run)]


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(block, automaton): pickled automata over blocks of items of about ``block_words`` words, at most twice as many."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [p for name, text in zip(*[c.to_pylist() for c in batch.columns]) for p in pieces_of(name, words(text), block_words, window)]
            rows = [(name, b" ".join(run), len(run)) for name, run in rows if run]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64()))], names=["name", "words", "n"])

    def build(key, rows):
        import pandas as pd

        held = sorted(zip(rows["name"].tolist(), rows["words"].tolist()), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        made = Automaton([(name, bytes(run).split()) for name, run in held], window)
        return pd.DataFrame({"block": [int(key[0])], "automaton": [pickle.dumps(made, protocol=5)]})

    runs = items.select(F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(lean(cut), "name string, words binary, n long").distinct()
    placed = ranked(materialise(runs, "items"), [], ["words", "name"], "n").withColumn("block", F.expr(f"before div {block_words}L"))
    return materialise(placed.select("block", "name", "words").groupBy("block").applyInPandas(build, "block long, automaton binary"), "automata")


_loaded: dict[str, Automaton] = {}


def _load(key: str, blob) -> Automaton:
    """The broadcast automaton, unpacked once a worker; another one takes its place."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(blob.value)
    return _loaded[key]


FOUND = "n_words long, spans array<array<int>>, items array<string>, longest int"


def scan(docs: DataFrame, automaton: bytes, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and what one block's automaton finds: n_words, hit spans in words, items (sorted as strings) and the longest run."""
    blob, key = docs.sparkSession.sparkContext.broadcast(automaton), uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        made = _load(key, blob)
        kinds = (pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.int32())
        for batch in batches:
            rows = [(n, spans, sorted(names), longest) for n, spans, names, longest in map(made.scan, batch.column(len(keep)).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=[*keep, "n_words", "spans", "items", "longest"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", " + FOUND
    return docs.select(*keep, F.col(f"`{text_col}`").cast("binary").alias("_text")).mapInArrow(lean(run), schema)


def _together(batches):
    """One row of spans, items and longest runs from those of several blocks."""
    import pyarrow as pa

    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        spans, items = [], []
        for parts in columns["found"]:
            out = []
            for a, b in sorted(s for p in parts for s in p["spans"]):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(b, out[-1][1])
                else:
                    out.append([a, b])
            spans.append(out)
            items.append(sorted({x for p in parts for x in p["items"]}))
        longest = [max(p["longest"] for p in parts) for parts in columns["found"]]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32())],
            names=["_digest", "spans", "items", "longest"],
        )


def find(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """Every row's ``keep`` columns with n_words, hit spans in words, the items met and the longest run of words that an item holds."""
    blocks = automata(items, window, block_words)
    numbers = sorted(r["block"] for r in blocks.select("block").collect())  # one number for every ``block_words`` words

    def automaton(b):
        return bytes(blocks.filter(F.col("block") == b).first()["automaton"])

    nothing, keep = pickle.dumps(Automaton([], window)), list(keep)
    if len(numbers) <= 1:
        return scan(docs, automaton(numbers[0]) if numbers else nothing, keep, text_col)
    named = docs.select(*keep, F.col(f"`{text_col}`").alias("_text"), F.unhex(F.sha2(F.col(f"`{text_col}`").cast("binary"), 256)).alias("_digest"))
    met = None  # equal texts are met alike, so that a text's digest is enough to bring its rows and the blocks' hits together
    for b in numbers:
        hits = scan(named, automaton(b), ["_digest"], "_text").filter("longest > 0").groupBy("_digest").agg(F.first(F.struct("spans", "items", "longest")).alias("found"))
        hits = materialise(hits, "hits")
        met = hits if met is None else met.unionByName(hits)
    met = met.groupBy("_digest").agg(F.collect_list("found").alias("found"))  # at most one a block
    met = materialise(met.mapInArrow(lean(_together), "_digest binary, spans array<array<int>>, items array<string>, longest int"), "met")
    counted = scan(named, nothing, [*keep, "_digest"], "_text").drop("spans", "items", "longest")
    return counted.join(met, "_digest", "left").select(
        *keep, "n_words", F.coalesce("spans", F.expr("cast(array() as array<array<int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"),
    )


def n_hit(spans: str = "spans") -> F.Column:
    return F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s[1] - s[0])")


def without(text: str, spans: list) -> str:
    """The text without the words of the spans, from the first one's first byte to the last one's last byte."""
    raw = text.encode()
    flat, out, at, nth = raw.translate(TABLE), [], 0, 0
    ends, end = [], 0
    for a, b in spans:
        while nth < b:
            start = end
            while start < len(flat) and flat[start] == 32:
                start += 1
            end = flat.find(b" ", start)
            end = len(flat) if end < 0 else end
            if nth == a:
                ends.append(start)
            nth += 1
        ends.append(end)
    for a, b in zip(ends[::2], ends[1::2]):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()


def clean(found: DataFrame, least_span: int = WINDOW, most_share: float = 0.5) -> DataFrame:
    """What ``find`` gave with doc_id and text kept, and ``cleaned`` (the text without hit spans of at least ``least_span`` words) and ``kept`` (whether
    at most ``most_share`` of its words are hit)."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([t if t is None or s is None or not len(s) else without(t, [x for x in s if x[1] - x[0] >= least_span]) for t, s in zip(texts, spans)])

    hit = F.size("spans") > 0
    return found.select(
        "doc_id", "n_words", "spans", "items", "longest", F.when(hit, cut(F.when(hit, F.col("text")), F.when(hit, F.col("spans")))).otherwise(F.col("text")).alias("cleaned"),
        (n_hit() <= most_share * F.col("n_words")).alias("kept"),
    )


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
