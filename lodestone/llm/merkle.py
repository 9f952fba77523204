"""A Merkle manifest of a table: a digest for each row, a tree for each group, a tree of their roots, and proofs.

Partial parents gather the digests of their children by index. A parent's arity follows from the size of its tree, so it knows
when it is complete; it then becomes a child of its own parent, and so on up as long as parents are complete. What stays
unresolved, the frontier, is shuffled again by wider keys, until each tree is one node. Links back from child to parent, with
the child's place and its siblings, make the proofs: from the top the path of each frontier node, and from these the paths
of the rows.

Rows are numbered by ranges of the order, so a group that holds most rows is many tasks; a key of a pass holds ``SPAN`` nodes
at most; what travels is a digest and a number for each row, never a text, and paths travel for a node in ``SPAN`` only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written
from lodestone.plans.patterns import dealt, running_by

#: Nodes of one key of a pass, at most.
SPAN = 1 << 14

#: Rows of a range, about.
RANGE = 1 << 18

PROOF = "array<struct<slot: int, siblings: array<string>>>"
_LINK = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))

Node = tuple[int, int]


def value_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values, one after the other: ``-`` for a null, else the number of its UTF-8 bytes, a colon
    and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(digest: Column, step: Column) -> Column:
        others, slot = step["siblings"], step["slot"]
        left, right = F.slice(others, F.lit(1), slot), F.slice(others, slot + 1, F.size(others))
        return F.sha2(F.concat(F.array_join(left, ""), digest, F.array_join(right, "")), 256)

    return F.aggregate(proof, leaf, up)


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf to the root and from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), ""), 256)


def combined(nodes: Iterable[tuple[int, int, str]], size: int, arity: int, to_level: int) -> tuple[dict[Node, tuple[int, list[str]]], dict[Node, str]]:
    """(links, frontier) of nodes (level, index, digest), in any order, of a tree of ``size`` leaves: for each node whose parent
    became complete its slot and siblings; and the nodes that are left, without a complete parent or on ``to_level``, above which
    an only child would rise out of its key."""
    widths = [size]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // arity))
    partial: dict[Node, dict[int, str]] = {}
    links: dict[Node, tuple[int, list[str]]] = {}
    tops: dict[Node, str] = {}
    for level, index, digest in nodes:
        while True:
            if widths[level] == 1 or level == to_level:
                tops[level, index] = digest
                break
            parent = index // arity
            held = partial.setdefault((level + 1, parent), {})
            held[index % arity] = digest
            if len(held) < min(arity, widths[level] - parent * arity):
                break
            del partial[level + 1, parent]
            row = [held[i] for i in range(len(held))]
            for slot in range(len(row)):
                links[level, parent * arity + slot] = slot, row[:slot] + row[slot + 1 :]
            level, index, digest = level + 1, parent, hashlib.sha256("".join(row).encode()).hexdigest()
    for (level, parent), held in partial.items():
        for slot, digest in held.items():
            tops[level - 1, parent * arity + slot] = digest
    return links, tops


def _climb(links: dict[Node, tuple[int, list[str]]], node: Node, arity: int) -> tuple[list[tuple[int, list[str]]], Node]:
    """The path of a node to its last ancestor that is known, and that ancestor."""
    path = []
    while node in links:
        path.append(links[node])
        node = node[0] + 1, node[1] // arity
    return path, node


def _as_proofs(paths: list[list[tuple[int, list[str]]]]) -> pa.Array:
    return pa.array([[{"slot": slot, "siblings": others} for slot, others in path] for path in paths], type=_LINK)


def _pass(nodes: DataFrame, arity: int, to_level: int) -> DataFrame:
    """``nodes`` (tree, size, level, index, digest), each with its last known ancestor (up_level, up_index, up_digest) after a pass
    with a key for each node of ``to_level``."""

    def run(table: pa.Table) -> pa.Table:
        levels, indexes = table.column("level").to_pylist(), table.column("index").to_pylist()
        links, tops = combined(zip(levels, indexes, table.column("digest").to_pylist(), strict=True), table.column("size")[0].as_py(), arity, to_level)
        known = {}
        for node in zip(levels, indexes, strict=True):
            known[node] = _climb(links, node, arity)[1]
        up = [known[node] for node in zip(levels, indexes, strict=True)]
        return table.select(["tree", "size", "level", "index", "digest"]).append_column("up_level", pa.array([u[0] for u in up], pa.int64())).append_column("up_index", pa.array([u[1] for u in up], pa.int64())).append_column("up_digest", pa.array([tops[u] for u in up]))

    zoned = nodes.withColumn("zone", _zone(arity, to_level))
    return zoned.groupBy("tree", "zone").applyInArrow(run, "tree string, size long, level long, index long, digest string, up_level long, up_index long, up_digest string")


def _zone(arity: int, level: int) -> Column:
    """The number of a node's ancestor on ``level``; nodes of that level or above are their own."""
    power = F.pow(F.lit(float(arity)), F.greatest(F.lit(level) - F.col("level"), F.lit(0))).cast("long")
    return F.floor(F.col("index") / power).cast("long") if arity != 2 else F.expr(f"shiftright(index, cast(greatest({level} - level, 0) as int))")


def _paths(nodes: DataFrame, above: DataFrame, arity: int, to_level: int, extra: Sequence[str]) -> DataFrame:
    """``nodes`` (tree, size, level, index, digest and ``extra`` columns) with ``top``, ``root`` and ``proof``, where ``above`` (tree,
    level, index, top, root, proof) has those of the nodes that a pass to ``to_level`` leaves."""
    schema = nodes.select(*extra).schema if extra else None
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema) if schema else ""

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        levels, indexes = table.column("level").to_pylist(), table.column("index").to_pylist()
        if not levels:
            return pa.Table.from_arrays([*(table.column(c) for c in extra), *(table.column(c) for c in ("tree", "level", "index")), pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], _LINK)], names=[*extra, "tree", "level", "index", "top", "root", "proof"])
        links, _ = combined(zip(levels, indexes, table.column("digest").to_pylist(), strict=True), table.column("size")[0].as_py(), arity, to_level)
        known = {(u["level"], u["index"]): (u["top"], u["root"], [(s["slot"], s["siblings"]) for s in u["proof"]]) for u in upper.select(["level", "index", "top", "root", "proof"]).to_pylist()}
        top, root, proofs = [], [], []
        for node in zip(levels, indexes, strict=True):
            path, last = _climb(links, node, arity)
            t, r, rest = known[last]
            top.append(t)
            root.append(r)
            proofs.append(path + rest)
        told = [pa.array(top, pa.string()), pa.array(root, pa.string()), _as_proofs(proofs)]
        return pa.Table.from_arrays([*(table.column(c) for c in extra), *(table.column(c) for c in ("tree", "level", "index")), *told], names=[*extra, "tree", "level", "index", "top", "root", "proof"])

    zone = _zone(arity, to_level)
    here, there = nodes.withColumn("zone", zone).groupBy("tree", "zone"), above.withColumn("zone", zone).groupBy("tree", "zone")
    return here.cogroup(there).applyInArrow(run, f"{fields}tree string, level long, index long, top string, root string, proof {PROOF}")


def manifest(leaves: DataFrame, *, order: str, group: str | None = None, arity: int = 2) -> DataFrame:
    """Every row of ``leaves``, which has a column ``leaf`` (hex digest), with ``subroot``, ``root`` and ``proof``.

    The rows of a group are the leaves of its tree, by ``order``, then by ``leaf``; null comes first, and is a group of its own.
    While a level has more than one node, each run of ``arity`` nodes (the last may be shorter, of one even) becomes the digest of
    their hex digests. The tops are the ``subroot``s, which by group make the tree of ``root``; without ``group`` there is one tree,
    and its top is both. ``proof`` has, from the leaf to the root, the place among siblings and the digests of the others.

    Repeated rows are leaves each. A null leaf is refused by the tree's definition, so it counts as the digest of nothing. An
    empty table gives no rows. Columns of the result replace those of the same names.
    """
    if arity < 2:
        raise ValueError("arity must be 2 at least")
    names = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    packed = leaves.select(
        F.struct(*(leaves[c] for c in names)).alias("row"),
        (F.coalesce(F.concat(F.lit("1"), leaves[group].cast("string")), F.lit("0")) if group else F.lit("")).alias("tree"),
        leaves[order].alias("place"),
        F.coalesce(leaves["leaf"], F.lit(hashlib.sha256(b"").hexdigest())).alias("digest"),
    )
    stored = written(packed.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    total = stored.count()
    if not total:
        return leaves.select(*names).withColumns({"subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string"), "proof": F.lit(None).cast(PROOF)})
    usual = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", "place", "digest", "tie"]
    ranges = dealt(stored, keys, max(min(usual, -(-total // 4096)), -(-total // RANGE)))
    placed = running_by(ranges, keys, {"n": F.lit(1)}, ["tree"]).select("row", "tree", F.col("all_n").alias("size"), F.lit(0).cast("long").alias("level"), (F.col("cum_n") - 1).alias("index"), "digest")
    rounds = [written(placed, "placed")]
    step = max(1, math.floor(math.log(SPAN, arity) + 1e-9))
    largest, to_level = rounds[0].agg(F.max("size")).first()[0], 0
    while True:
        to_level += step
        passed = _pass(rounds[-1].select("tree", "size", "level", "index", "digest"), arity, to_level).select("tree", "size", F.col("up_level").alias("level"), F.col("up_index").alias("index"), F.col("up_digest").alias("digest"))
        rounds.append(written(passed.distinct(), "frontier"))
        if arity**to_level >= largest:
            break
    tops = rounds[-1]
    if group is None:
        above = tops.select("tree", "level", "index", F.col("digest").alias("top"), F.col("digest").alias("root"), F.expr(f"cast(array() as {PROOF})").alias("proof"))
    else:
        own = manifest(tops.select(F.col("tree"), F.col("digest").alias("leaf")), order="tree", arity=arity)
        above = tops.join(own.select("tree", "root", "proof"), "tree").select("tree", "level", "index", F.col("digest").alias("top"), "root", "proof")
    for i in range(len(rounds) - 2, -1, -1):
        above = _paths(rounds[i], above, arity, (i + 1) * step, ["row"] if i == 0 else [])
        if i:
            above = written(above, "paths")
    return above.select("row.*", F.col("top").alias("subroot"), "root", "proof")
