"""N-grams of all texts, counted by blocks of texts, without a row for each n-gram.

A block is a row that holds the words of many texts as numbers. Blocks send the sorted 64-bit names of their n-grams, packed, with
what they know of each, to ranges of names; a range sends back, in the same order, what all blocks know. Words and pairs of words
go first; a longer n-gram is only sent if both n-grams that it is made of are in two texts at least, as it is in no more texts than
these. Blocks are written once, in the buckets that the answers are shuffled to, so they are never shuffled themselves.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.durable import new_path, written

#: Words and texts of a block, about; more are cut off only between texts.
BLOCK_WORDS, BLOCK_TEXTS = 1 << 21, 1 << 16
#: Ranges of names, and buckets of blocks, at least; the number of shuffle partitions where that is more.
RANGES = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _M1
    x = (x ^ x >> np.uint64(33)) * _M2
    return x ^ x >> np.uint64(33)


def word_names(words: pa.Array) -> np.ndarray:
    """A 64-bit name of each word: the sum of a mixed number for each byte and its place, mixed with the length."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(ends)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    place = (np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)).astype(np.uint64)
    upto = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_mixed((place << np.uint64(8) | data) * _ODD + _M1), out=upto[1:])
    return _mixed(upto[ends[1:] - ends[0]] - upto[ends[:-1] - ends[0]] + size.astype(np.uint64) * _M2)


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, as those of most weight are nearly all alike."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else values
    return b"".join([len(values).to_bytes(8, "little"), pa.compress(planes.tobytes(), codec="zstd", asbytes=True)])


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T).view(kind).reshape(n)


def unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different names, where each is first, and the number of each element's name. Sorting the upper bits with the place below
    them is several times as fast as sorting places; where those bits do not tell names apart, places are sorted."""
    low = np.uint64(max(len(x) - 1, 1).bit_length())
    key = np.sort(x >> low << low | np.arange(len(x), dtype=np.uint64))
    at = (key & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)
    placed = x[at]
    if (placed[1:] < placed[:-1]).any():
        at = np.argsort(x, kind="stable")
        placed = x[at]
    head = np.ones(len(x), dtype=bool)
    head[1:] = placed[1:] != placed[:-1]
    which = np.empty(len(x), dtype=np.int64)
    which[at] = np.cumsum(head) - 1
    return placed[head], at[head], which


def _best_two(name: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest and the second count (0: none) of each of ``n`` names, equal ones included."""
    key = np.sort(name.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - count.astype(np.uint64)))
    name, count = (key >> np.uint64(32)).astype(np.int64), (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.uint32)
    first, second = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
    head = np.ones(len(name), dtype=bool)
    head[1:] = name[1:] != name[:-1]
    at = np.flatnonzero(head)
    first[name[at]] = count[at]
    after = at[at + 1 < len(name)] + 1
    after = after[~head[after]]
    second[name[after]] = count[after]
    return first, second


class Block:
    """Texts of one row: ``codes`` of their words, side after side, and ``text``, the text of each word."""

    def __init__(self, row: dict, sides: int) -> None:
        self.hashes, self.codes, sizes = _unpacked(row["hashes"], np.uint64), _unpacked(row["codes"], np.uint32), _unpacked(row["sizes"], np.uint32)
        self.sizes = sizes.reshape(sides, -1).astype(np.int64)
        self.n = self.sizes.shape[1]
        self.segment = np.repeat(np.arange(sides * self.n), self.sizes.ravel())
        self.text, self.side = self.segment % max(self.n, 1), self.segment // max(self.n, 1)

    def places(self, n: int) -> np.ndarray:
        """Where an n-gram begins."""
        if len(self.segment) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.segment[n - 1 :] == self.segment[: len(self.segment) - n + 1])

    def names(self, n: int, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            out = _mixed(out * _ODD + self.hashes[self.codes[at + k]])
        return out

    def text_names(self, n: int, at: np.ndarray) -> np.ndarray:
        """Names that also tell the block's texts apart."""
        return _mixed(self.names(n, at) + self.text[at].astype(np.uint64) * _ODD)

    def levels(self, known: dict[int, list[np.ndarray]], order: int, start: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, places, different names, name of each place) for n from ``start``, 1 or 2, to ``order``, of the n-grams that are sent. What
        comes back, by n in the order of names, is in ``known``; for 3 and more it must be there for n - 1, at least as flags."""
        shared = np.zeros(0, dtype=bool)
        for n in range(start, order + 1):
            at = self.places(n)
            if n > 2:
                at = at[shared[at] & shared[at + 1]]
            some, _, which = unique(self.names(n, at))
            yield n, at, some, which
            if n in known:
                shared = np.zeros(len(self.codes) + 1, dtype=bool)
                shared[at] = known[n][0][which] > 0


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and how many each has; a text is an array of words, or a string to split at ASCII white space."""
    if pa.types.is_list(column.type):
        return column.flatten().cast(pa.string()), np.diff(column.offsets.to_numpy())
    split = pc.ascii_split_whitespace(column)
    words, ends = split.flatten(), split.offsets.to_numpy()
    some = pc.not_equal(words, "")  # there are empty ones before and after white space
    upto = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(some.to_numpy(zero_copy_only=False), out=upto[1:])
    return words.filter(some), np.diff(upto[ends - ends[0]])


def _encoded(sides: int, cut: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, sizes, held = [], [[] for _ in range(sides)], [[] for _ in range(sides)], 0

        def told() -> pa.RecordBatch:
            every = pa.chunked_array([w for side in words for w in side], type=pa.string()).combine_chunks()
            every = (every if isinstance(every, pa.Array) else pa.concat_arrays(every.chunks)).dictionary_encode()
            codes = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            often = np.argsort(-np.bincount(codes, minlength=len(every.dictionary)), kind="stable")
            rank = np.empty(len(often), dtype=np.uint32)
            rank[often] = np.arange(len(often), dtype=np.uint32)
            hashes = word_names(every.dictionary)[often]
            every_key = pa.concat_arrays(keys)
            row = [pa.array([int.from_bytes(os.urandom(8), "little") >> 1]), pa.ListArray.from_arrays(pa.array([0, len(every_key)], type=pa.int32()), every_key), *(pa.array([x], type=pa.binary()) for x in (_packed(hashes), _packed(rank[codes]), _packed(np.concatenate([s for side in sizes for s in side]).astype(np.uint32))))]
            return pa.RecordBatch.from_arrays(row, names=["block", "keys", "hashes", "codes", "sizes"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                keys.append(some.column(0))
                for k in range(sides):
                    for held_by, part in zip((words, sizes), cut(some.column(k + 1)), strict=True):
                        held_by[k].append(part)
                    held += len(words[k][-1])
                if held >= BLOCK_WORDS or 256 * len(keys) >= BLOCK_TEXTS:
                    yield told()
                    keys, words, sizes, held = [], [[] for _ in range(sides)], [[] for _ in range(sides)], 0
        if keys:
            yield told()

    return run


def _rows(batches: Iterator[pa.RecordBatch], sides: int) -> Iterator[tuple[dict, Block, dict[int, list[np.ndarray]]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "keys"}
            row["keys"] = batch.column("keys")[i].values
            parts: dict[int, list[tuple]] = {}
            for x in row.pop("known", None) or ():
                parts.setdefault(x["n"], []).append((x["range"], [_unpacked(x["flags"], np.uint8)] if x["a"] is None else [_unpacked(x[c], np.uint32) for c in "ab"]))
            known = {n: [np.concatenate(c) for c in zip(*(p[1] for p in sorted(v, key=lambda p: p[0])), strict=True)] for n, v in parts.items()}
            yield row, Block(row, sides), known


def gram_scores(df: DataFrame, key: str, words: list[Column], order: int, top: bool, score: Callable[[Block, dict, int], dict[str, np.ndarray]], schema: str, cut: Callable[[pa.Array], tuple[pa.Array, np.ndarray]] = split_words) -> DataFrame:
    """(key, ...): what ``score`` makes of a block and of what is known of its n-grams, a value a text; ``schema``: of these columns.

    ``words``: for each side an array of words, or a string that ``cut`` splits, at ASCII white space by default, without nulls; n-grams of the first are counted, those of others only ask. Known of an n-gram are
    two numbers: the texts that have it and 0, or, with ``top``, the greatest and the second of its counts in texts; both are 0
    if it is in fewer than two texts. ``key`` tells rows apart. N-grams are told apart by 64 bits.
    """
    spark, sides = df.sparkSession, len(words)
    kind = df.schema[key].dataType.simpleString()
    parts = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = df.select(F.col(key), *(w.alias(f"w{k}") for k, w in enumerate(words)))
    encoded = split.mapInArrow(_encoded(sides, cut), f"block long, keys array<{kind}>, hashes binary, codes binary, sizes binary")
    table = f"blocks_{uuid.uuid4().hex}"
    encoded.write.bucketBy(parts, "block").option("path", new_path(spark, "blocks")).saveAsTable(table)
    blocks, answers = spark.table(table), None

    def met(orders: tuple[int, ...], flags: bool = True) -> DataFrame:
        if not orders:
            return blocks.withColumn("known", F.lit(None).cast("array<struct<n:int,range:int,flags:binary,a:binary,b:binary>>"))
        held = [F.when(F.lit(flags == (c == "flags")), F.col(c)).alias(c) for c in ("flags", "a", "b")]
        return blocks.join(answers.filter(F.col("n").isin(*orders)).select("block", F.struct("n", "range", *held).alias("x")).groupBy("block").agg(F.collect_list("x").alias("known")), "block", "left")

    def sent(new: tuple[int, ...]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, block, known in _rows(batches, sides):
                for n, at, some, which in block.levels(known, max(new), min(min(new), 2)):
                    if n not in new:
                        continue
                    own = block.side[at] == 0
                    pair, count = np.unique(which[own] * max(block.n, 1) + block.text[at[own]], return_counts=True)
                    a, b = _best_two(pair // max(block.n, 1), count, len(some)) if top else (np.bincount(pair // max(block.n, 1), minlength=len(some)).astype(np.uint32), np.zeros(0, dtype=np.uint32))
                    to = ((some >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                    ends = np.searchsorted(to, np.arange(parts + 1))
                    out = []
                    for r in range(parts):
                        x = slice(ends[r], ends[r + 1])
                        if ends[r + 1] > ends[r]:
                            out.append((row["block"], n, r, _packed(np.diff(some[x], prepend=np.uint64(0))), _packed(a[x]), _packed(b[x])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["block", "n", "range", "names", "a", "b"])

        return run

    def merged(group: pa.Table) -> pa.Table:
        names = [np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in group["names"]]
        ends = np.cumsum([len(x) for x in names])[:-1]
        some, _, which = unique(np.concatenate(names))
        a, b = (np.concatenate([_unpacked(x.as_py(), np.uint32) for x in group[c]]) for c in "ab")
        if top:
            has = b > 0
            first, second = _best_two(np.concatenate([which, which[has]]), np.concatenate([a, b[has]]), len(some))
            shared = second > 0
        else:
            first = np.bincount(which, weights=a, minlength=len(some)).astype(np.uint32)
            second, shared = np.zeros(len(some), dtype=np.uint32), first > 1
        back = [[_packed(x) for x in np.split(np.where(shared, v, 0).astype(np.uint32)[which], ends)] for v in (first, second)]
        flags = [_packed(x) for x in np.split(shared.astype(np.uint8)[which], ends)]
        return pa.table({"block": group["block"], "n": group["n"], "range": group["range"], "flags": pa.array(flags, type=pa.binary()), "a": pa.array(back[0], type=pa.binary()), "b": pa.array(back[1], type=pa.binary())})

    for new in [tuple(range(1, min(order, 2) + 1)), *((n,) for n in range(3, order + 1))]:
        asked = met(tuple(range(2, new[0]))).mapInArrow(sent(new), "block long, n int, range int, names binary, a binary, b binary")
        found = written(asked.groupBy("n", "range").applyInArrow(merged, "block long, n int, range int, flags binary, a binary, b binary"), "answers")
        answers = found if answers is None else answers.unionByName(found)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, known in _rows(batches, sides):
            out = score(block, known, order)
            yield pa.RecordBatch.from_arrays([row["keys"], *(pa.array(v) for v in out.values())], names=[key, *out])

    return met(tuple(range(1, order + 1)), flags=False).mapInArrow(scored, f"`{key}` {kind}, {schema}")
