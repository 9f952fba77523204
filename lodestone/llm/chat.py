"""Reply trees to chat text: paths by pointer doubling, branches by score, one conversation for each chosen path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import written
from lodestone.llm.words import tidied

#: Control strings of the template. In texts, the escape character doubles and each control string gets one after its first
#: character, which no control string has; taking it out again gives the text back.
BEGIN, END, OPEN, CLOSE, SYSTEM, SYSTEM_END = "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"
CONTROLS = (BEGIN, END, OPEN, CLOSE, SYSTEM, SYSTEM_END)
ESCAPE = "\\"
#: The tree of turns without a conversation.
NO_CONVERSATION = -(1 << 63)


def escaped(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE + ESCAPE)
    for c in (*CONTROLS, "<r:"):
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescaped(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, i = [], 0
    while (k := text.find(ESCAPE, i)) >= 0:
        out.append(text[i:k])
        if text[k + 1 : k + 2] == ESCAPE:
            out.append(ESCAPE)
            k += 1
        i = k + 1
    return "".join(out) + text[i:]


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """(before, body, after) of a turn; the body is the escaped text, the rest template."""
    body = escaped(text)
    if role == "assistant":
        return "", body, END
    if role == "user":
        return f"{BEGIN}{OPEN}", body, CLOSE
    if role == "system":
        return f"{SYSTEM}", body, SYSTEM_END
    return f"<r:{escaped(role).replace('>', ESCAPE + '>')}>", body, END


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    i = 0
    while i < len(formatted):
        if formatted.startswith(BEGIN + OPEN, i):
            role, i, stop = "user", i + len(BEGIN + OPEN), CLOSE
        elif formatted.startswith(SYSTEM, i):
            role, i, stop = "system", i + len(SYSTEM), SYSTEM_END
        elif formatted.startswith("<r:", i):
            k = i + 3
            while formatted[k] != ">":
                k += 2 if formatted[k] == ESCAPE else 1
            role, i, stop = unescaped(formatted[i + 3 : k]), k + 1, END
        else:
            role, stop = "assistant", END
        k = formatted.index(stop, i)
        yield role, unescaped(formatted[i:k])
        i = k + len(stop)


def single_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each tree and node: of several the one of greatest score (null: 0), then of greatest parent, role and text, of the
    columns that there are."""
    others = [c for c in ("parent", "role", "text") if c in nodes.columns]
    first = F.max(F.struct(F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), *others)).alias("one")
    return nodes.groupBy("tree", "node").agg(first).select("tree", "node", "one.*")


def root_paths(nodes: DataFrame, *, best: int | None = None, unique: bool = False) -> DataFrame:
    """Every node of every root-to-leaf path of reply trees: (tree, leaf, place, node), place 0 at the root.

    Takes ``tree``, ``node``, ``parent`` (null at a root; a parent that is missing makes a root) and ``score`` (null: 0). Of rows of
    one node one counts (``single_nodes``), unless the caller knows that nodes are ``unique``. Paths grow by self-joins: round k extends each path by its nodes' ancestors at distance 2^k, so
    their number is the logarithm of the longest path, and only ids move. ``best``: keep that many paths of each tree, by
    the mean score of their nodes (ties: smaller leaf); None keeps all. A cycle has no leaf of its own and gives no path;
    rows with a null tree or node are left out; an empty table gives no rows. A node whose ancestors lead into a cycle gives
    no path either: no path has more nodes than its tree.
    """
    nodes = nodes if unique else single_nodes(nodes.select("tree", "node", "parent", "score"))
    known = nodes.filter("tree is not null and node is not null").select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    parents = known.select("tree", F.col("node").alias("parent")).distinct()
    up = known.filter("parent is not null").select("tree", "node", "parent").join(parents, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up"))
    leaves = known.select("tree", "node").join(up.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    most = known.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, hops = [written(up, "chat-jumps")], 1
    while True:  # jump k leads 2^k levels up; it is empty once no path is that long
        one = jumps[-1]
        two = one.select("tree", "node", F.col("up").alias("via")).join(one.select("tree", F.col("node").alias("via"), "up"), ["tree", "via"]).select("tree", "node", "up")
        two = written(two, "chat-jumps")
        hops *= 2
        if two.isEmpty():
            break
        if hops > most:  # further up than the tree has nodes: these go round a cycle
            leaves = leaves.join(two.select("tree", "node"), ["tree", "node"], "left_anti")
            break
        jumps.append(two)
    if best is not None:
        leaves = _best_leaves(leaves, jumps, known, best)
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        further = paths.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        paths = paths.unionByName(further)
        if k % 4 == 0:
            paths = written(paths, "chat-paths")
    length = paths.groupBy("tree", "leaf").agg((F.max("above")).alias("top"))
    return paths.join(length, ["tree", "leaf"]).select("tree", "leaf", (F.col("top") - F.col("above")).alias("place"), "node")


def _best_leaves(leaves: DataFrame, jumps: list[DataFrame], known: DataFrame, best: int) -> DataFrame:
    """(tree, node) of the leaves of the ``best`` paths of each tree by mean score. Sums double with the jumps: that of 2^k
    nodes is that of the first half and of the half above it; a leaf then climbs from the longest jump down, a row a round, so
    no path but the chosen ones is ever expanded. Trees of one leaf need no sums."""
    rivals = leaves.join(leaves.groupBy("tree").count().filter(F.col("count") > best).select("tree"), "tree", "left_semi")
    if rivals.isEmpty():
        return leaves
    own = known.select("tree", "node", "score")
    sums = [jumps[0].join(own, ["tree", "node"])]  # the node's own score, without the one above
    for longer in jumps[1:]:
        half = sums[-1].select("tree", F.col("node").alias("via"), F.col("score").alias("upper"))
        joined = longer.join(sums[-1].select("tree", "node", F.col("up").alias("via"), "score"), ["tree", "node"]).join(half, ["tree", "via"])
        sums.append(written(joined.select("tree", "node", "up", (F.col("score") + F.col("upper")).alias("score")), "chat-sums"))
    at = rivals.select("tree", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("total"), F.lit(1).cast("long").alias("nodes"))
    for k in reversed(range(len(sums))):
        step = at.join(sums[k], ["tree", "node"], "left")
        at = step.select("tree", "leaf", F.coalesce("up", "node").alias("node"), (F.col("total") + F.coalesce("score", F.lit(0.0))).alias("total"), (F.col("nodes") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("nodes"))
    mean = (F.col("total") + F.col("score")) / F.col("nodes")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    chosen = at.join(own, ["tree", "node"]).select("tree", "leaf", mean.alias("mean")).withColumn("rank", rank).filter(F.col("rank") <= best).select("tree", F.col("leaf").alias("node"))
    return leaves.join(rivals.select("tree").distinct(), "tree", "left_anti").select("tree", "node").unionByName(chosen)


def format_paths(messages: DataFrame, *, best: int | None = 1, unique: bool = False) -> DataFrame:
    """(tree, leaf, n_turns, formatted, spans) of each chosen root-to-leaf path of ``messages``.

    Takes ``tree``, ``node``, ``parent``, ``score``, ``role`` and ``text``; others are not read. ``spans``: (begin, end) in
    code points of ``formatted`` under the loss mask, the assistant's texts. A null text is empty and a null role ``user``. Rows
    are sorted by path and read as a stream, so a task holds one conversation at a time. ``unique``: as in ``root_paths``.
    """
    messages = messages if unique else written(single_nodes(messages), "chat-nodes")
    paths = root_paths(messages, best=best, unique=True)
    said = messages.select("tree", "node", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(said, ["tree", "node"]).repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place").select("tree", "leaf", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = turns = size = 0
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            tree, leaf, n, text, marks = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(tree, type=pa.int64()), pa.array(leaf, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array(text, type=pa.string()), pa.array(marks, type=kind)], names=["tree", "leaf", "n_turns", "formatted", "spans"])

        for batch in batches:
            for tree, leaf, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (tree, leaf):
                    if key is not None:
                        out.append((*key, turns, "".join(parts), [{"begin": a, "end": b} for a, b in spans]))
                        size += at
                    if size > 4 << 20:
                        yield batch_of()
                        out, size = [], 0
                    key, parts, spans, at, turns = (tree, leaf), [], [], 0, 0
                before, body, after = format_turn(role, text)
                parts += (before, body, after)
                if role == "assistant":
                    spans.append((at + len(before), at + len(before) + len(body)))
                at += len(before) + len(body) + len(after)
                turns += 1
        if key is not None:
            out.append((*key, turns, "".join(parts), [{"begin": a, "end": b} for a, b in spans]))
        if out:
            yield batch_of()

    return rows.mapInArrow(tidied(run), "tree long, leaf long, n_turns long, formatted string, spans array<struct<begin: long, end: long>>")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as messages of chains: each replies to the turn before it, by ``turn`` (null first; equal turns
    in the order of role and text). ``node`` is the place in that order; turns of a null ``conv_id`` are one conversation too, of
    tree ``NO_CONVERSATION`` (an id that must not occur)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return placed.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
