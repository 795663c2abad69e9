"""Operator 11, Merkle dataset manifest: one hash tree per source, one over the sources, and a proof for every row.

Rows are range-sorted by source and id; the counts of the partitions before, per source, make each row's position known
without gathering a source. A task then hashes, in one pass over its run of consecutive leaves, every subtree that lies
whole in it (aligned at powers of ``ARITY``). Only what is ragged, at most ``ARITY - 1`` nodes at either end of a run and
level, is shuffled by its coordinate (source, level, run), and the upper levels are finished from it, one level a round. Proofs
go down the same way: each run of nodes gets its parent's path and one step more, and a row's proof is its own run and that path.

Nodes travel as 32 bytes; what is hashed is the lowercase hex text of the children one after another.

Defined cases: each null field is ``-``, an empty text is ``0:``; the null source is a source of its own, before all others
(the empty one next); rows of one source with one id, or with null ids (first), are ordered by their leaves; rows that repeat
whole have equal leaves and a proof each; a null id is never in the tampered fifth; extra columns are ignored; an empty table
has no rows and no root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import lean, materialise, ranked, small

ARITY = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<slot:int,members:binary>>"


def field(value: F.Column) -> F.Column:
    """``-`` if null, else UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**columns: F.Column) -> F.Column:
    """The row's digest (32 bytes) of FIELDS in their order, each as in ``columns`` or by its own name."""
    return F.unhex(F.sha2(F.concat(*[field(columns.get(c, F.col(f"`{c}`"))) for c in FIELDS]), 256))


def parent(members: bytes) -> bytes:
    """The node over children given as one string of 32-byte digests."""
    return hashlib.sha256(members.hex().encode()).digest()


def parent_column(members: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.lower(F.hex(members)), 256))


RUNS = "grp string, level int, run long, slot int, whole boolean, hashes binary, tags array<string>, others array<binary>"


def _subtrees(batches):
    """From (grp, rank, leaf, tag, other) rows: the runs of nodes that are whole here, and the pieces of those that aren't."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary())]
    names = ["grp", "level", "run", "slot", "whole", "hashes", "tags", "others"]
    out: list[tuple] = []
    open_runs: list[list] = []  # a level: [index of the first node, its digests, tags, others]
    grp = after = None

    def close(level):
        first, hashes, tags, others = open_runs[level]
        if hashes:
            whole = len(hashes) == ARITY
            out.append((grp, level, first // ARITY, first % ARITY, whole, b"".join(hashes), tags if level == 0 else None, others if level == 0 else None))
            open_runs[level] = [0, [], [], []]
            if whole:
                add(level + 1, first // ARITY, parent(out[-1][5]), None, None)

    def add(level, index, digest, tag, other):
        if level == len(open_runs):
            open_runs.append([0, [], [], []])
        held = open_runs[level]
        if not held[1]:
            held[0] = index
        held[1].append(digest)
        held[2].append(tag)
        held[3].append(other)
        if index % ARITY == ARITY - 1:
            close(level)

    def close_all():
        level = 0
        while level < len(open_runs):
            close(level)
            level += 1

    def flushed():
        rows = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    for batch in batches:
        for g, rank, digest, tag, other in zip(*[c.to_pylist() for c in batch.columns]):
            if g != grp or rank != after:
                close_all()
            grp, after = g, rank + 1
            add(0, rank, digest, tag, other)
        if len(out) > 256:
            yield flushed()
    close_all()
    if out:
        yield flushed()


@dataclass
class Tree:
    """``levels[l]``: runs of nodes of level l (grp, run, hashes, and for leaves tags, others); ``tops``: each group's (grp, level, subroot)."""

    levels: list[DataFrame]
    lone: DataFrame
    tops: DataFrame


def _nodes_at(n: str, level: int) -> F.Column:
    return F.expr(f"({n} + {ARITY**level - 1}L) div {ARITY**level}L")


def grow(rows: DataFrame, order: list[str]) -> Tree:
    """Trees over the rows (grp, leaf, tag, other and the columns of ``order``) of each group, in that order."""
    placed = ranked(rows, ["grp"], order)
    sizes = materialise(placed.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    sizes = small(sizes)
    built = materialise(placed.select("grp", "rank", "leaf", "tag", "other").mapInArrow(lean(_subtrees), RUNS), "runs")
    levels, tops, level, carry = [], [], 0, None
    while True:
        ragged = built.filter(f"level = {level} and not whole").alias("r").join(sizes.alias("s"), F.expr("r.grp <=> s.grp")).select("r.grp", "n", "run", "slot", "hashes", "tags", "others")
        pieces = ragged if carry is None else ragged.unionByName(carry, allowMissingColumns=True)
        pieces = pieces.withColumn("top", _nodes_at("n", level) == 1)  # of written tables, and few: read again rather than written
        tops.append(pieces.filter("top").select("grp", F.lit(level).alias("level"), F.col("hashes").alias("subroot"), "tags", "others"))
        if (largest + ARITY**level - 1) // ARITY**level <= 1:
            break
        # At most ARITY pieces, each of at most ARITY nodes, meet in a run.
        met = pieces.filter("not top").groupBy("grp", "run").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("slot", "hashes", "tags", "others"))).alias("p"))
        met = met.select(
            "grp", "n", "run", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.hashes))").alias("hashes"),
            F.expr("flatten(transform(p, x -> x.tags))").alias("tags"), F.expr("flatten(transform(p, x -> x.others))").alias("others"),
        )
        met = materialise(met, "met")
        levels.append(built.filter(f"level = {level} and whole").select("grp", "run", "hashes", "tags", "others").unionByName(met.drop("n")))
        carry = met.select("grp", "n", F.expr(f"run div {ARITY}L").alias("run"), F.expr(f"cast(run % {ARITY} as int)").alias("slot"), parent_column(F.col("hashes")).alias("hashes"))
        level += 1
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return Tree(levels, tops[0], found.select("grp", "level", "subroot"))


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """Runs of leaves with the steps from their parent up to what ``above`` (grp, steps) names for each group's subroot:
    grp, hashes, tags, others, alone (the leaf is the subroot), subroot, steps. A step is a node's slot and its whole run."""
    tops = tree.tops.alias("t").join(above.alias("a"), F.expr("t.grp <=> a.grp")).select("t.grp", "level", "subroot", "steps")
    tops = materialise(tops, "tops")
    lone = tree.lone.alias("t").join(tops.filter("level = 0").alias("a"), F.expr("t.grp <=> a.grp"))
    lone = lone.select("t.grp", F.col("t.subroot").alias("hashes"), "tags", "others", F.lit(True).alias("alone"), "a.subroot", "steps")
    known = None
    for level in range(len(tree.levels) - 1, -1, -1):
        # The subroots of this height stand as runs without members, so that their only child finds them.
        own = tops.filter(f"level = {level + 1}").select("grp", F.lit(0).cast("long").alias("run"), F.lit(None).cast("binary").alias("hashes"), "subroot", "steps")
        over = own if known is None else known.select("grp", "run", "hashes", "subroot", "steps").unionByName(own)
        joined = tree.levels[level].alias("c").join(over.alias("p"), F.expr(f"c.grp <=> p.grp and c.run div {ARITY}L = p.run"))
        step = F.expr(f"concat(array(struct(cast(c.run % {ARITY} as int) as slot, p.hashes as members)), p.steps)")
        known = joined.select("c.grp", "c.run", "c.hashes", "c.tags", "c.others", "p.subroot", F.when(F.col("p.hashes").isNull(), F.col("p.steps")).otherwise(step).alias("steps"))
    if known is None:
        return lone
    return known.select("grp", "hashes", "tags", "others", F.lit(False).alias("alone"), "subroot", "steps").unionByName(lone)


def manifest(docs: DataFrame, other: F.Column | None = None) -> tuple[DataFrame, bytes | None]:
    """Runs of at most ``ARITY`` leaves with their proofs, as ``paths`` gives them (tags: the rows' ids as text; others: ``other``
    of the rows, a digest that travels along), and the root of the whole dataset."""
    other = F.lit(None).cast("binary") if other is None else other
    rows = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), leaf().alias("leaf"), F.col("doc_id").cast("string").alias("tag"), other.alias("other"))
    # Rows equal in all are told apart by a stored number, so that a range may end among them.
    rows = materialise(rows.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    tree = grow(rows, ["id", "leaf", "nth"])
    tops = materialise(tree.tops, "subroots")
    sources = tops.select(F.lit("").alias("grp"), F.col("subroot").alias("leaf"), F.col("grp").alias("tag"), F.lit(None).cast("binary").alias("other"))
    upper = grow(sources, ["tag"])
    root = upper.tops.first()
    if root is None:
        none = docs.sparkSession.createDataFrame([], f"grp string, hashes binary, tags array<string>, others array<binary>, alone boolean, subroot binary, steps {STEPS}")
        return none, None
    top_runs = paths(upper, upper.tops.select("grp", F.expr(f"cast(array() as {STEPS})").alias("steps")))
    # One row a source: its slot among the sources and the way from there to the root.
    spread = top_runs.select("hashes", "alone", "steps", F.posexplode("tags").alias("slot", "source"))
    own = F.when(F.col("alone"), F.col("steps")).otherwise(F.expr("concat(array(struct(slot as slot, hashes as members)), steps)"))
    above = materialise(spread.select(F.col("source").alias("grp"), own.alias("steps")), "above")
    return paths(tree, above), bytes(root["subroot"])


def fold(digest: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its proof give: in each step the digest takes its slot among the run's members and the run is hashed."""
    for slot, members in steps:
        digest = parent(members[: 32 * slot] + digest + members[32 * slot + 32 :])
    return digest


def siblings(steps: list[tuple[int, bytes]]) -> bytes:
    return b"".join(members[: 32 * slot] + members[32 * slot + 32 :] for slot, members in steps)


def proofs(runs: DataFrame) -> DataFrame:
    """One row a leaf: source, tag, leaf, other, subroot and the steps of its proof."""
    at = F.posexplode(F.arrays_zip("tags", "others")).alias("slot", "x")
    out = runs.select("grp", "hashes", "alone", "subroot", "steps", at)
    own = F.expr("concat(array(struct(slot as slot, hashes as members)), steps)")
    return out.select(
        F.col("grp").alias("source"), F.col("x.tags").alias("tag"), F.expr("substring(hashes, 1 + 32 * slot, 32)").alias("leaf"), F.col("x.others").alias("other"),
        "subroot", F.when(F.col("alone"), F.col("steps")).otherwise(own).alias("steps"),
    )


def _checked(root: bytes):
    """Per leaf the digest of its siblings, and the root folded from ``other`` or else the leaf."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            rows = []
            for hashes, tags, others, alone, subroot, steps in zip(*[columns[c] for c in ("hashes", "tags", "others", "alone", "subroot", "steps")]):
                steps = [(s["slot"], s["members"]) for s in steps]
                rest = siblings(steps).hex()  # the same for all leaves of the run
                for slot, (tag, other) in enumerate(zip(tags, others)):
                    digest = hashes[32 * slot : 32 * slot + 32]
                    own = [] if alone else [(slot, hashes)]
                    proof = hashlib.sha256((siblings(own).hex() + rest).encode()).hexdigest()
                    got = fold(digest if other is None else other, own + steps)
                    rows.append((None if tag is None else int(tag), digest.hex(), subroot.hex(), root.hex(), proof, got.hex(), got == root))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else None) for i, c in enumerate(zip(*rows))], names=names)

    return run


CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    runs, root = manifest(docs, F.when(tampered, leaf(text=F.translate("text", UPPER, LOWER))))
    return runs.mapInArrow(lean(_checked(root or b"")), CHECKED)
