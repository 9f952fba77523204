"""Content-addressed store of token ids: chunks cut by a rolling hash, recipes of documents, Merkle manifests.

Format, all Parquet under one folder, ids as little-endian unsigned 16- or 32-bit integers:

* ``chunks`` (chunk, ids): each distinct chunk once, under the BLAKE2b-128 digest of its ids;
* ``recipes`` (shard, row, doc_id, n_tokens, local_start, recipe, leaf): documents in ascending doc_id order; shard s
  holds lower doc_ids than shard s + 1, ``row`` counts within it, ``local_start`` is the number of ids before it there,
  ``recipe`` the digests of its chunks one after the other, ``leaf`` the digest of the recipe;
* ``manifest`` (shard, n_docs, n_tokens, start, root): the number of ids before each shard and the Merkle root over the
  leaves of its documents, and a row for shard -1 with the root over all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import new_path, removed
from lodestone.llm.tokens import WordEncoder, read_vocabulary
from lodestone.llm.words import as_binary, slices, tidied

#: Ids of the rolling window, the least and most ids of a chunk, and the mean distance of cuts between them.
ROLL, LEAST, MOST, MEAN = 16, 64, 1024, 256
#: Documents of a shard, and the most shards: the manifest has a row for each and fits the driver.
SHARD_DOCS, MOST_SHARDS = 50_000, 1 << 16
_DIGEST = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=_DIGEST).digest()


class Roller:
    """Places where a polynomial over the last ``ROLL`` ids (modulo 2^64) falls under a bound."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(0, dtype=np.uint64)

    def _grown(self, n: int) -> None:
        with np.errstate(over="ignore"):
            back = np.uint64(pow(int(_ODD), -1, 1 << 64))
            self.powers = np.cumprod(np.full(n, _ODD, dtype=np.uint64))
            self.inverse = np.cumprod(np.full(n, back, dtype=np.uint64))

    def cuts(self, ids: np.ndarray) -> np.ndarray:
        """Ends of windows that may end a chunk; depends on these ``ROLL`` ids only."""
        n = len(ids)
        if n < ROLL:
            return np.zeros(0, dtype=np.int64)
        if n > len(self.powers):
            self._grown(max(n, 1 << 16))
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
            mixed ^= mixed >> np.uint64(29)
            upto = np.cumsum(mixed * self.powers[:n])
            window = upto[ROLL - 1 :].copy()
            window[1:] -= upto[: n - ROLL]
            window *= self.inverse[ROLL - 1 : n]
            window *= _MIX
        return np.flatnonzero(window < np.uint64((1 << 64) // MEAN)) + ROLL


def chunk_ends(allowed: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids: the first allowed place at least ``LEAST`` on, or ``MOST`` on."""
    ends, begin = [], 0
    for place in allowed:
        while place - begin > MOST:
            begin += MOST
            ends.append(begin)
        if place - begin >= LEAST:
            ends.append(place)
            begin = place
    while n - begin > MOST:
        begin += MOST
        ends.append(begin)
    if begin < n:
        ends.append(n)
    return ends


def _merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree; a node without a partner goes up as it is."""
    while len(leaves) > 1:
        leaves = [_digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else _digest(b"")


def write_store(docs: DataFrame, vocabulary_path: str, path: str, *, end_id: int = 2, seen: int = 1 << 18) -> None:
    """Encodes every whole text, appends ``end_id``, and writes the store to ``path``.

    Takes columns ``doc_id`` and ``text``; others are not read. A null or empty text is the end id alone; documents of equal
    or null doc_id are kept each (null first, equal ones in no set order); an empty table gives an empty store. Texts are
    encoded once, into a staging table; digests of the last ``seen`` chunks of a task save repeated payload there, and a
    distributed aggregate on the digest keeps one payload of each chunk.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, roller = WordEncoder(vocabulary.value), Roller()
        kind = "<u2" if len(encoder.ends) <= 1 << 16 else "<u4"
        width = int(kind[-1])
        sent: set[bytes] = set()
        for batch in batches:
            for some in slices(batch, limit=6 << 20):
                ids, at = encoder.encode(some.column(1), end=end_id)
                allowed = roller.cuts(ids)
                first = np.searchsorted(allowed, at)
                after = np.searchsorted(allowed, at + ROLL - 1, side="right")  # windows that begin in the document before
                data, ends = ids.astype(kind).tobytes(), at.tolist()
                recipes, payload, fresh = [], [], [0]
                for d in range(len(ends) - 1):
                    begin, stop = ends[d], ends[d + 1]
                    mine = (allowed[max(first[d], after[d]) : first[d + 1]] - begin).tolist()
                    recipe, a = [], begin * width
                    for e in chunk_ends(mine, stop - begin):
                        b = (begin + e) * width
                        chunk = data[a:b]
                        a = b
                        key = _digest(chunk)
                        recipe.append(key)
                        if key not in sent:
                            if len(sent) >= seen:
                                sent.clear()
                            sent.add(key)
                            payload.append({"chunk": key, "ids": chunk})
                    fresh.append(len(payload))
                    recipes.append(b"".join(recipe))
                new = pa.ListArray.from_arrays(pa.array(fresh, type=pa.int32()), pa.array(payload, type=pa.struct([("chunk", pa.binary()), ("ids", pa.binary())])))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(at)), pa.array(recipes, type=pa.binary()), new], names=["doc_id", "n_tokens", "recipe", "new"])

    staging = new_path(spark, "token-staging")
    schema = "doc_id long, n_tokens long, recipe binary, new array<struct<chunk: binary, ids: binary>>"
    docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidied(run), schema).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.schema(schema).parquet(staging)
    (staged.select(F.inline("new")).groupBy("chunk").agg(F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks"))
    _write_recipes(staged.select("doc_id", "n_tokens", "recipe"), path)
    removed(spark, staging)


def _write_recipes(staged: DataFrame, path: str) -> None:
    spark = staged.sparkSession
    shards = max(1, min(MOST_SHARDS, -(-staged.count() // SHARD_DOCS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            sizes = batch.column(1).to_numpy()
            upto = np.cumsum(sizes)
            leaves = [_digest(r) for r in batch.column(2).to_pylist()]
            cells = [pa.array(np.full(n, shard, dtype=np.int64)), pa.array(np.arange(row, row + n)), *batch.columns[:2], pa.array(start + upto - sizes), batch.column(2), pa.array(leaves, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["shard", "row", "doc_id", "n_tokens", "local_start", "recipe", "leaf"])
            row, start = row + n, start + int(upto[-1]) if n else start

    schema = "shard long, row long, doc_id long, n_tokens long, local_start long, recipe binary, leaf binary"
    ranged = staged.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(tidied(run), schema).write.option("compression", "zstd").parquet(f"{path}/recipes")

    rows, start = [], 0
    for shard, n, tokens, root in _roots(spark.read.schema(schema).parquet(f"{path}/recipes"), shards):
        rows.append((shard, n, tokens, start, root))
        start += tokens
    rows.append((-1, sum(r[1] for r in rows), start, 0, _merkle([r[4] for r in rows])))
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


_MANIFEST = "shard long, n_docs long, n_tokens long, start long, root binary"


def _roots(recipes: DataFrame, shards: int) -> list[tuple[int, int, int, bytes]]:
    """(shard, n_docs, n_tokens, root) of each shard from the leaves of its documents in the order of ``row``, which must run
    from 0 without gaps; a task holds a digest for each document of its shards, the driver a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list[bytes], list[int]]] = {}  # a task reads whole shards, sorted
        for batch in batches:
            for shard, row, leaf, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                leaves, sizes = found.setdefault(shard, ([], []))
                if row != len(leaves):
                    raise ValueError(f"shard {shard}: document {len(leaves)} is missing or there twice")
                leaves.append(leaf)
                sizes.append(n)
        rows = [(s, len(leaves), sum(sizes), _merkle(leaves)) for s, (leaves, sizes) in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "n_docs", "n_tokens", "root"])

    parts = recipes.select("shard", "row", "leaf", "n_tokens").repartition(shards, "shard").sortWithinPartitions("shard", "row")
    return sorted((s, n, t, bytes(r)) for s, n, t, r in parts.mapInArrow(tidied(run), "shard long, n_docs long, n_tokens long, root binary").collect())


def verify_store(spark: SparkSession, path: str) -> None:
    """Computes the Merkle roots of the recipes again and compares shards, counts and roots with the manifest, and the root over
    all shards with its rows; raises ValueError where they differ. Chunks and recipes are checked as they are read."""
    manifest = {r["shard"]: (r["n_docs"], r["n_tokens"], r["start"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").collect()}  # MOST_SHARDS rows at most
    top = manifest.pop(-1, None)
    start = 0
    found = _roots(spark.read.parquet(f"{path}/recipes"), max(1, len(manifest)))
    for shard, n, tokens, root in found:
        if manifest.get(shard) != (n, tokens, start, root):
            raise ValueError(f"shard {shard} does not match the manifest")
        start += tokens
    if len(found) != len(manifest) or top != (sum(r[1] for r in found), start, 0, _merkle([r[3] for r in found])):
        raise ValueError("the shards do not match the root of the manifest")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, put together from the chunks and checked against recipe, leaf and roots.

    ``start``: ids of all documents before it; ``ids``: little-endian unsigned 32-bit. Roots are computed again and compared
    with the manifest at once (``verify_store``); a chunk that does not match its digest, a recipe that does not match its
    leaf, or a document without its number of ids stops the job as it reads. A chunk that very many documents share is one row of
    the store met by many recipe rows, a join that adaptive execution splits.
    """
    verify_store(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = spark.read.parquet(f"{path}/chunks")
    manifest = spark.read.parquet(f"{path}/manifest").filter("shard >= 0").select("shard", "start")  # MOST_SHARDS rows at most
    wanted = recipes.select("shard", "row", F.posexplode(F.expr(f"transform(sequence(0, cast(length(recipe) / {_DIGEST} as int) - 1), i -> substring(recipe, i * {_DIGEST} + 1, {_DIGEST}))")).alias("pos", "chunk"))
    found = wanted.join(chunks, "chunk", "left").select("shard", "row", "pos", "chunk", "ids", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("binary").alias("leaf"))
    heads = recipes.join(F.broadcast(manifest), "shard").select("shard", "row", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("chunk"), F.lit(None).cast("binary").alias("ids"), "doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "leaf")
    together = heads.unionByName(found).repartition("shard", "row").sortWithinPartitions("shard", "row", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple | None = None
        keys: list[bytes] = []
        parts: list[bytes] = []
        out: list[tuple] = []
        size = 0

        def close() -> None:
            nonlocal size
            doc, start, n, leaf = head
            if _digest(b"".join(keys)) != leaf:
                raise ValueError(f"document {doc}: its recipe does not match the manifest")
            data = b"".join(parts)
            width = len(data) // n if n else 2
            if width not in (2, 4) or len(data) != n * width:
                raise ValueError(f"document {doc}: {len(data)} bytes do not hold {n} ids")
            ids = np.frombuffer(data, dtype=f"<u{width}").astype("<u4").tobytes()
            out.append((doc, start, n, ids))
            size += len(ids)

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for pos, key, ids, doc, start, n, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pos < 0:
                    if head is not None:
                        close()
                    head, keys, parts = (doc, start, n, leaf), [], []
                    if size > 8 << 20:
                        yield batch_of()
                        out, size = [], 0
                elif ids is None or _digest(ids) != key:
                    raise ValueError(f"chunk {key.hex()} is missing or does not match its digest")
                else:
                    keys.append(key)
                    parts.append(ids)
        if head is not None:
            close()
        if out:
            yield batch_of()

    return together.select("pos", "chunk", "ids", "doc_id", "start", "n_tokens", "leaf").mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids binary")
