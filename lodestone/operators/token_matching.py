"""BERTScore from token embeddings: the greatest similarity of each token on the other side of its example, in blocks.

The tokens of an example and side are cut into blocks. Pairs of blocks of one example meet by their numbers, so an example of many
tokens is many tasks; each pair gives the greatest cosine of its tokens, and greatest values are merged by block. Weights
are inverse document frequencies from counts over all references, joined to the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.neighbours import usable
from lodestone.plans.durable import written
from lodestone.plans.patterns import split_join

#: Tokens of a block.
TOKENS = 512


def token_weights(references: DataFrame, tokens: DataFrame) -> DataFrame:
    """``tokens`` (example, token, ...) with ``weight``: ln((n + 1) / (d + 1)) for a token that d of the n examples of ``references``
    have. A token that is common to many rows meets its weight by broadcast."""
    n = references.select("example").distinct().count()
    found = references.select("example", "token").distinct().groupBy("token").agg(F.count("*").alias("d"))
    used = tokens.groupBy("token").agg(F.count("*").alias("rows"))
    weights = used.join(found, "token", "left").select("token", "rows", F.log((n + 1.0) / (F.coalesce("d", F.lit(0)) + 1)).alias("weight"))
    return split_join(tokens, weights, ["token"], "rows", tokens.count()).drop("rows")


def _blocks(tokens: DataFrame, side: str, dims: int) -> DataFrame:
    """(example, <side>_block, <side>, <side>_weight): unit vectors of about ``TOKENS`` tokens, and their weights."""
    rows = tokens.select("example", F.col("v").cast("array<double>").alias("v"), (F.col("weight").cast("double") if "weight" in tokens.columns else F.lit(1.0)).alias("weight"), "at")
    sizes = rows.groupBy("example").agg(F.count("*").alias("tokens"), F.ceil(F.count("*") / TOKENS).alias("parts"))
    dealt = split_join(rows, sizes, ["example"], "tokens", rows.count()).withColumn("block", F.pmod(F.xxhash64("at"), F.col("parts")).cast("int"))
    kind = tokens.schema["example"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        head = [table.column("example").slice(0, 1), table.column("block").slice(0, 1)]
        return pa.Table.from_arrays([*head, pa.array([x.tobytes()], pa.binary()), pa.array([table.column("weight").to_numpy().tobytes()], pa.binary())], names=["example", f"{side}_block", side, f"{side}_weight"])

    return dealt.select("example", "block", "v", "weight").groupBy("example", "block").applyInArrow(pack, f"example {kind}, {side}_block int, {side} binary, {side}_weight binary")


def bertscore(references: DataFrame, predictions: DataFrame, *, baseline: float | None = None) -> DataFrame:
    """(example, precision, recall, f1) of each example with tokens on both sides.

    Both have ``example``, ``at`` (the token's number in its side), ``v`` (its embedding) and, if wanted, ``weight``. Precision is the
    mean over predicted tokens of the greatest cosine with a reference token, recall the reverse, by the weights; each is
    rescaled as (s - b) / (1 - b) by ``baseline`` b. Vectors that are null, zero, not finite, or of another length than the first
    reference's take no part; weights that add up to 0 give null.
    """
    first = references.filter("v is not null").select(F.size("v")).limit(1).collect()
    dims = first[0][0] if first else 0
    kind = references.schema["example"].dataType.simpleString()
    sides = {s: written(_blocks(usable(t, "v", dims), s, dims), s) for s, t in (("r", references), ("p", predictions))} if dims else {}
    if not dims:
        return references.sparkSession.createDataFrame([], f"example {kind}, precision double, recall double, f1 double")
    pairs = sides["r"].select("example", "r_block").join(sides["p"].select("example", "p_block"), "example")
    both = pairs.join(sides["r"], ["example", "r_block"]).join(sides["p"], ["example", "p_block"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for example, rb, pb, r, p, rw, pw in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                sim = np.frombuffer(r).reshape(-1, dims) @ np.frombuffer(p).reshape(-1, dims).T
                out.append((example.as_py(), "r", rb, sim.max(1).tobytes(), rw))
                out.append((example.as_py(), "p", pb, sim.max(0).tobytes(), pw))
            kinds = (batch.column(0).type, pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True) if out else ([],) * 5, kinds, strict=True)], names=["example", "side", "block", "best", "weight"])

    met = both.select("example", "r_block", "p_block", "r", "p", "r_weight", "p_weight").mapInArrow(meet, f"example {kind}, side string, block int, best binary, weight binary")

    def merge(table: pa.Table) -> pa.Table:
        weight = np.frombuffer(table.column("weight")[0].as_py())
        best = np.full(len(weight), -np.inf)
        for b in table.column("best").to_pylist():
            best = np.maximum(best, np.frombuffer(b))
        head = [table.column(c).slice(0, 1) for c in ("example", "side")]
        return pa.Table.from_arrays([*head, pa.array([float(best @ weight)]), pa.array([float(weight.sum())])], names=["example", "side", "best", "weight"])

    sums = met.groupBy("example", "side", "block").applyInArrow(merge, f"example {kind}, side string, best double, weight double")
    share = lambda s: F.try_divide(F.sum(F.when(F.col("side") == s, F.col("best"))), F.sum(F.when(F.col("side") == s, F.col("weight"))))
    scores = sums.groupBy("example").agg(share("p").alias("precision"), share("r").alias("recall"))
    if baseline is not None:
        scores = scores.select("example", *(((F.col(c) - baseline) / (1 - baseline)).alias(c) for c in ("precision", "recall")))
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.when(total != 0, total))
    return scores.select("example", "precision", "recall", f1.alias("f1"))
