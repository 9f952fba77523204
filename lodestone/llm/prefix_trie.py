"""The trie of all conversation prefixes, encoded by preorder intervals.

A node is a distinct sequence of first turns. Its name is a sum over its turns of digests of depth and turn, so the names of
all prefixes of a conversation are running totals, dealt over ranges: no task holds a long conversation.

Distinct conversations are ranked lexicographically (by the digests of their turns, a prefix before what extends it); of a
path only the turns at which another conversation leaves it are compared. A node covers an interval of ranks; nodes ordered by
their first rank and depth are in preorder, and the subtree of a node ends with the last node that its last rank begins. Leaves
and savings of subtrees are then differences of prefix sums over that order.

Texts are read once, for their digests, and never shuffled. Joins whose keys may be hot (a common first turn, a long
conversation) send heavy keys apart (``split_join``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written
from lodestone.plans.patterns import dealt, running_by, split_join

_PIECES = ("s0", "s1", "s2", "s3")


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, said, cost) of every row of ``conversations`` (conv_id, turn, role, text) that has a conv_id: its number in
    its conversation from 0, by turn (null first; ties by what is said), the digest of role and text, the bytes of its text.
    A null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    read = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), F.octet_length(text).cast("long").alias("cost"))
    order = ["conv_id", F.asc_nulls_first("turn"), "said", "tie"]
    ranges = dealt(read.withColumn("tie", F.monotonically_increasing_id()), order)
    return running_by(ranges, order, {"n": F.lit(1)}, ["conv_id"]).select("conv_id", (F.col("cum_n") - 1).alias("place"), "said", "cost")


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums)))


def _ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the numbers of a node's conversations, ascending; a stream, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends_sha256"])
                done = []
        if state is not None:
            done.append((current, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends_sha256"])

    return members.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, place, said, cost; the order of a conversation is by place, which is
    unique in it): conv_id (least conversation that starts with it), depth, parent_conv_id, n_convs, n_children, n_leaves (nodes
    without children in its subtree), saved_tokens (over its subtree, conversations but one times the cost of the last turn),
    ends_sha256 (of the numbers of the conversations that end there), position and subtree_end in preorder.

    ``conversations`` (conv_id) adds conversations without turns, which end at the root. Rows without conv_id are left out; no
    conversation gives no rows, else there is a root. Equal conversations share all nodes.
    """
    own = turns.filter("conv_id is not null").select("conv_id", "place", "said", "cost")
    placed = dealt(own, ["conv_id", "place"])
    depths = written(running_by(placed, ["place"], {"n": F.lit(1)}, ["conv_id"]).withColumnsRenamed({"cum_n": "depth", "all_n": "length"}), "depths")
    piece = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "said"), 256)
    pieces = {s: F.conv(F.substring(piece, 1 + 8 * i, 8), 16, 10).cast("long") for i, s in enumerate(_PIECES)}
    summed = running_by(depths.withColumns({f"own_{s}": c for s, c in pieces.items()}), ["place"], {s: F.col(f"own_{s}") for s in _PIECES}, ["conv_id"])
    names = {"node": _node(F.col("depth"), [F.col(f"cum_{s}") for s in _PIECES]), "parent": _node(F.col("depth") - 1, [F.col(f"cum_{s}") - F.col(f"own_{s}") for s in _PIECES])}
    prefixes = written(summed.withColumns(names).select("conv_id", "depth", "length", "node", "parent", "said", "cost"), "prefixes")
    total = prefixes.count()
    root = _node(F.lit(0), [F.lit(0)] * 4)

    ids = prefixes.filter("depth = length").select("conv_id", "node", "length")
    if conversations is not None:
        more = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        ids = ids.unionByName(more.join(ids.select("conv_id"), "conv_id", "left_anti").select("conv_id", root.alias("node"), F.lit(0).cast("long").alias("length")))
    members = written(ids, "members")
    each = prefixes.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("cost").alias("cost"))
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(root.alias("node"), "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("cost"))
    all_nodes = written(each.unionByName(top), "nodes")
    children = all_nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(all_nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")

    # ranks of distinct conversations, by the turns at which others leave their path
    distinct = written(members.groupBy("node").agg(F.min(F.struct("conv_id", "length")).alias("c")).select("c.*"), "distinct")
    paths = split_join(prefixes.select("conv_id", "said", "depth", "node", "parent"), distinct, ["conv_id"], "length", total)
    forks = nodes.filter("n_children > 1").select(F.col("node").alias("parent"), "n_convs")
    turned = split_join(paths.drop("length"), forks, ["parent"], "n_convs", total)
    keys = turned.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "said"))).alias("turned"))
    keyed = distinct.join(keys, "conv_id", "left").select("conv_id", "length", F.coalesce(F.transform("turned", lambda t: t["said"]), F.array().cast("array<string>")).alias("path"))
    order = ["path", "length"]
    ranks = written(running_by(dealt(keyed, order), order, {"n": F.lit(1)}).select("conv_id", "length", (F.col("cum_n") - 1).alias("rank")), "ranks")

    # intervals of ranks, and the preorder
    spans = split_join(prefixes.select("conv_id", "node"), ranks, ["conv_id"], "length", total).groupBy("node").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    whole = ranks.agg(F.min("rank").alias("first"), F.max("rank").alias("last")).filter("first is not null").select(root.alias("node"), "first", "last")
    order = ["first", "depth"]
    own_sums = {"n": F.lit(1), "leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("cost")}
    placed_nodes = running_by(dealt(nodes.join(spans.unionByName(whole), "node"), order), order, own_sums)
    ordered = written(placed_nodes.drop("__range", "all_n", "all_leaf", "all_saved"), "preorder")
    begun = ordered.groupBy(F.col("first").alias("last")).agg(*(F.max(f"cum_{s}").alias(f"end_{s}") for s in own_sums))
    ends_of = begun.join(ordered.groupBy("last").agg(F.count("*").alias("meets")), "last")
    n_nodes = ordered.count()
    closed = split_join(ordered, ends_of, ["last"], "meets", n_nodes)
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    known = split_join(written(closed, "intervals"), parents, ["parent"], "weight", n_nodes, how="left")
    return known.join(_ends(members), "node", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("end_leaf") - F.col("cum_leaf") + own_sums["leaf"]).alias("n_leaves"),
        (F.col("end_saved") - F.col("cum_saved") + own_sums["saved"]).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        (F.col("cum_n") - 1).alias("position"),
        F.col("end_n").alias("subtree_end"),
    )


def with_shared_heads(turns: DataFrame, conversations: DataFrame, head: Column, source: Column, longest: int) -> DataFrame:
    """Conversations that begin with another one's turns: each conv_id has the first ``head`` turns (``longest`` at most) of
    conversation ``source`` (all, if it has fewer; none, if there is none), then its own turns after its first ``head``. Both
    are columns of conv_id."""
    ids = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    asked = ids.select(F.col("conv_id").alias("to_id"), source.alias("conv_id"), head.alias("head"))
    heads = turns.filter(F.col("place") < longest).join(asked, "conv_id").filter("place < head").select(F.col("to_id").alias("conv_id"), "place", "said", "cost")
    return heads.unionByName(turns.filter(F.col("place") >= head).select("conv_id", "place", "said", "cost"))
