"""Vectors of texts from an embedding service, asked in ordered batches: each different text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.sources.store import stored

#: A batch's texts; characters of a text that are sent; what a refused text is cut by, at least to, and how often.
BATCH, MOST_CHARS, SHRINK, LEAST_CHARS, TRIES = 16, 6553, 0.6, 600, 5


class TooLarge(Exception):
    """The service refuses a text for its size."""


def ask(client: Callable[[list[str]], list[tuple[int, list[float]]]], texts: list[str]) -> list[list[float]]:
    """Vectors in the order of the texts; the client may give (index, vector) in any order.

    A refused batch is asked again text by text; a refused text is cut to 0.6 of what was sent, but not below 600 characters, up to five tries in all. So what
    is sent of a text doesn't depend on its neighbours.
    """

    def once(some: list[str]) -> list[list[float]]:
        got = sorted(client(some), key=lambda x: x[0])
        if [i for i, _ in got] != list(range(len(some))):
            raise ValueError(f"asked for {len(some)} vectors, got {len(got)}")
        return [v for _, v in got]

    try:
        return once([t[:MOST_CHARS] for t in texts])
    except TooLarge:
        if len(texts) > 1:
            return [v for t in texts for v in ask(client, [t])]
    room = MOST_CHARS
    for left in range(TRIES - 1, 0, -1):
        room = max(LEAST_CHARS, int(room * SHRINK))
        try:
            return once([texts[0][:room]])
        except TooLarge:
            if left == 1 or room <= LEAST_CHARS:
                raise
    raise TooLarge


def embedded(texts: DataFrame, client: Callable, batch: int = BATCH) -> DataFrame:
    """texts (id, text) with ``vector``, null for a null text. The client is called in tasks, for each different text once; vectors are
    written, so that they aren't asked for again."""
    keyed = texts.select("id", "text", F.sha2(F.col("text"), 256).alias("key"))
    different = keyed.filter("text is not null").groupBy("key").agg(F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                vectors = ask(client, some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "vector"])

    vectors = stored(different.mapInArrow(run, "key string, vector array<double>"), "vectors")
    return keyed.join(vectors, "key", "left").select("id", "text", "vector")
