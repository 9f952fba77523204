"""Matches of tuples by keys of their words, counted by blocks of scenes, without a row for each tuple.

A block is a row that holds what many scenes still have to match, packed: the tuples of one side only, as numbers of words, and the
different words of these. Blocks send their words, each once and packed, to ranges of words, where they meet the table of keys;
blocks are written once, in the buckets that the keys come back to, so tuples are never shuffled.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.gram_blocks import _mixed, _packed, _unpacked, unique, word_names
from lodestone.plans.durable import new_path, written

#: Tuples and scenes of a block, about; more are cut off only between scenes.
BLOCK_TUPLES, BLOCK_SCENES = 1 << 19, 1 << 16
#: Ranges of words, and buckets of blocks, at least; the number of shuffle partitions where that is more.
RANGES = 64
#: Scenes whose tuples are cut at once.
_SLICE = 64

#: Words, where the up to three words of each tuple are among them (-1: none), and how many tuples each item has.
Cut = Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]]


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _whole(tuples: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Items that are tuples already; those of no word or of over three are left out."""
    n = lengths(tuples)
    good = (n >= 1) & (n <= 3)
    at = (np.cumsum(n) - n)[good][:, None] + np.arange(3)
    at[np.arange(3) >= n[good][:, None]] = -1
    return tuples.flatten(), at, good.astype(np.int64)


def _packed_words(words: pa.Array) -> bytes:
    """Words, large strings without nulls: how long each is, and their bytes."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = _packed(np.diff(ends).astype(np.uint32))
    return b"".join([len(sizes).to_bytes(8, "little"), sizes, _packed(np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]])])


def _unpacked_words(data: bytes) -> pa.Array:
    after = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(np.append(0, _unpacked(data[8:after], np.uint32)), dtype=np.int64)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(_unpacked(data[after:], np.uint8)))


def _ranges(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words range by range, in their order, and where each range begins and the last one ends."""
    to = ((word_names(words) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(parts + 1))


def _numbers(parts: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``unique`` of the rows of ``parts``, numbers under ``sizes``; rows are told apart exactly."""
    out, n = parts[0].astype(np.uint64), sizes[0]
    for part, size in zip(parts[1:], sizes[1:], strict=True):
        if n * size >= 1 << 63:
            some, _, which = unique(_mixed(out))
            out, n = which.astype(np.uint64), len(some)
        out, n = out * np.uint64(size) + part.astype(np.uint64), n * size
    return unique(_mixed(out))


def _encoded(cuts: tuple[Cut, Cut]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        images, words, places, scenes, scenes_so_far, words_so_far = [], [], ([], []), ([], []), 0, 0

        def told() -> pa.RecordBatch:
            image = pa.concat_arrays(images)
            every = pa.concat_arrays(words).dictionary_encode()
            code = pc.fill_null(every.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(1)
            bad = np.zeros(len(every.dictionary) + 1, dtype=bool)
            bad[0] = True
            bad[1:] = pc.equal(every.dictionary, "").to_numpy(zero_copy_only=False)
            bad, code = np.append(bad[code], False), np.append(code, np.int32(0))  # the last one is the word that a tuple does not have
            at, scene = np.concatenate([x for side in places for x in side]), np.concatenate([x for side in scenes for x in side])
            good = ~bad[at].any(axis=1)
            own = int(good[: sum(map(len, scenes[0]))].sum())
            at, scene = code[at[good]], scene[good]
            some, first, which = _numbers([scene, *at.T], [len(image), *[len(every.dictionary) + 1] * 3])
            has = np.zeros((2, len(some)), dtype=bool)
            has[0][which[:own]], has[1][which[own:]] = True, True
            cell = scene[first].astype(np.int64) * 3 + (at[first] > 0).sum(axis=1) - 1
            count = lambda which: np.bincount(cell[which], minlength=3 * len(image))
            named = image.is_valid().to_numpy(zero_copy_only=False)[scene[first]]  # a scene without a name matches nothing
            counts = np.concatenate([count(has[0]), count(has[1]), count(has[0] & has[1] & named)])
            alone = (has[0] != has[1]) & named
            both = (count(alone & has[0]) > 0) & (count(alone & has[1]) > 0)
            left = np.sort(first[alone & both[cell]])  # by side and scene
            at = at[left]
            often = np.bincount(at.ravel(), minlength=len(every.dictionary) + 1)[1:]
            # Words about as frequent are together, in alphabetical order, which packs well; numbers of frequent ones are small.
            kept = np.flatnonzero(often)
            kept = kept[pc.sort_indices(every.dictionary.take(pa.array(kept))).to_numpy()]
            kept = kept[np.argsort(-np.frexp(often[kept])[1], kind="stable")]
            rank = np.zeros(len(often) + 1, dtype=np.uint32)
            rank[kept + 1] = np.arange(1, len(kept) + 1, dtype=np.uint32)
            packed = (counts.astype(np.uint32), (left >= own).astype(np.uint8), scene[left].astype(np.uint32), *rank[at].T)
            row = [pa.array([int.from_bytes(os.urandom(8), "little") >> 1]), pa.ListArray.from_arrays(pa.array([0, len(image)], type=pa.int32()), image), pa.array([_packed_words(every.dictionary.take(pa.array(kept)))], type=pa.binary()), *(pa.array([_packed(np.ascontiguousarray(x))], type=pa.binary()) for x in packed)]
            return pa.RecordBatch.from_arrays(row, names=["block", "images", "words", "counts", "side", "scene", "a", "b", "c"])

        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                some = batch.slice(begin, _SLICE)
                images.append(some.column(0))
                for side, cut in enumerate(cuts):
                    column = some.column(side + 1)
                    part, at, n = cut(column.flatten())
                    words.append(part.cast(pa.large_string()))
                    places[side].append(np.where(at < 0, -1, at + words_so_far).astype(np.int32))
                    scenes[side].append(np.repeat(np.repeat(np.arange(scenes_so_far, scenes_so_far + len(column), dtype=np.int32), lengths(column)), n))
                    words_so_far += len(part)
                scenes_so_far += some.num_rows
                if sum(len(x) for side in scenes for x in side) >= BLOCK_TUPLES or scenes_so_far >= BLOCK_SCENES:
                    yield told()
                    images, words, places, scenes, scenes_so_far, words_so_far = [], [], ([], []), ([], []), 0, 0
        if images:
            yield told()

    return run


def _sent(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                words = _unpacked_words(data.as_py())
                order, ends = _ranges(words, parts)
                to = np.flatnonzero(np.diff(ends))
                some = [_packed_words(words.take(pa.array(order[ends[r] : ends[r + 1]]))) for r in to]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(to), type=pa.int64()), pa.array(to, type=pa.int32()), pa.array(some, type=pa.binary())], names=["block", "range", "words"])

    return run


def _placed(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, ends = _ranges(batch.column("word").cast(pa.large_string()), parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts), np.diff(ends)), type=pa.int32()), *(batch.column(c).take(pa.array(order)) for c in ("word", "keys"))], names=["range", "word", "keys"])

    return run


def _found(blocks: pa.Table, known: pa.Table) -> pa.Table:
    """Which of each block's words of a range have keys (hits: their places), how many, and these."""
    rows = []
    if len(blocks) and len(known):
        words = [_unpacked_words(x.as_py()) for x in blocks["words"]]
        at = pc.fill_null(pc.index_in(pa.concat_arrays(words), value_set=known["word"].combine_chunks().cast(pa.large_string())), -1).to_numpy(zero_copy_only=False)
        keys = known["keys"].combine_chunks()
        for block, r, part in zip(blocks["block"].to_pylist(), blocks["range"].to_pylist(), np.split(at, np.cumsum([len(w) for w in words])[:-1]), strict=True):
            hits = np.flatnonzero(part >= 0)
            if len(hits):
                own = keys.take(pa.array(part[hits]))
                rows.append((block, r, _packed(hits.astype(np.uint32)), _packed(lengths(own).astype(np.uint32)), _packed_words(own.flatten().cast(pa.large_string()))))
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3)
    return pa.table([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["block", "range", "hits", "n", "keys"])


def _paired(tuples: list[tuple[int, tuple[str, ...], list[tuple[int, ...]]]]) -> Iterator[int]:
    """The size of each match of one scene's tuples (side, words, names): candidates, in order, have the first free reference that
    shares a name."""
    by, free = defaultdict(list), {}
    for _, words, names in sorted((t for t in tuples if t[0]), key=lambda t: t[1], reverse=True):
        free[words] = True
        for name in names:
            by[name].append(words)  # the first one is at the end
    for _, _, names in sorted((t for t in tuples if not t[0]), key=lambda t: t[1]):
        for name in names:
            while by.get(name) and not free[by[name][-1]]:
                by[name].pop()
        found = [by[name][-1] for name in names if by.get(name)]
        if found:
            free[min(found)] = False
            yield len(min(found))


def _matched(parts: int) -> Callable:
    """Counts of each scene, with the matches by keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda c, kind=np.uint32: _unpacked(batch.column(c)[i].as_py(), kind).astype(np.int64)  # noqa: B023, E731
                image, words, known = batch.column("images")[i].values, _unpacked_words(batch.column("words")[i].as_py()), batch.column("known")[i].as_py()
                counts = of("counts").reshape(3, -1)
                if known:
                    order, ends = _ranges(words, parts)
                    codes = np.concatenate([order[ends[x["range"]] :][_unpacked(x["hits"], np.uint32)] for x in known]) + 1
                    n = np.concatenate([_unpacked(x["n"], np.uint32) for x in known]).astype(np.int64)
                    key = pa.concat_arrays([_unpacked_words(x["keys"]) for x in known]).dictionary_encode()
                    key, ends = key.indices.to_numpy(zero_copy_only=False) + len(words) + 1, np.cumsum(n)
                    name, many, has = np.arange(len(words) + 1), np.zeros(len(words) + 1, dtype=bool), np.zeros(len(words) + 1, dtype=bool)
                    has[codes], many[codes], name[codes] = True, n > 1, key[ends - 1]
                    side, scene, at = of("side", np.uint8), of("scene"), np.stack([of(c) for c in "abc"], axis=1)
                    some = has[at].any(axis=1)
                    side, scene, at = side[some], scene[some], at[some]
                    apart = np.zeros(len(image), dtype=bool)
                    apart[scene[many[at].any(axis=1)]] = True
                    one = ~apart[scene]
                    numbers, first, which = _numbers([scene[one], *name[at[one]].T], [len(image), *[len(words) + len(key) + 1] * 3])
                    m = np.minimum(*(np.bincount(which[side[one] == k], minlength=len(numbers)) for k in (0, 1)))
                    np.add.at(counts[2], scene[one][first] * 3 + (at[one][first] > 0).sum(axis=1) - 1, m)
                    if apart.any():
                        text, of_code = words.to_pylist(), {c: key[e - k : e].tolist() for c, e, k in zip(codes.tolist(), ends.tolist(), n.tolist(), strict=True)}
                        held = defaultdict(list)
                        for s, x, t in zip(scene[~one].tolist(), side[~one].tolist(), at[~one].tolist(), strict=True):
                            held[s].append((x, tuple(text[c - 1] for c in t if c), list(itertools.product(*(of_code.get(c, [c]) for c in t)))))
                        for s, tuples in held.items():
                            for size in _paired(tuples):
                                counts[2][s * 3 + size - 1] += 1
                by = counts.reshape(3, -1, 3)
                some = by[:2].sum(axis=(0, 2)) > 0
                yield pa.RecordBatch.from_arrays([image.filter(pa.array(some)), *(pa.array(by[x, some, k]) for x in range(3) for k in range(3))], names=["image", *(f"{x}{k}" for x in "crm" for k in (1, 2, 3))])

    return run


def keyed_counts(scenes: DataFrame, synonyms: DataFrame, cuts: tuple[Cut, Cut] | None = None) -> DataFrame:
    """(image, c1, c2, c3, r1 .. m3): tuples of each size of both sides, and matches, of scenes (image, own, other), a row for each image.

    ``own`` and ``other`` are arrays of tuples, or of what ``cuts`` make tuples of, one for each side; words are compared as they are.
    A tuple with an empty word or a null counts as none.
    """
    spark, kind = scenes.sparkSession, scenes.schema["image"].dataType.simpleString()
    known = written(synonyms.select("word", "key").filter("word is not null and key is not null").distinct(), "known")
    shared = known.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    keys = written(known.join(shared, "key").groupBy("word").agg(F.collect_list("key").alias("keys")), "keys")
    encoded = scenes.select("image", "own", "other").mapInArrow(_encoded(cuts or (_whole, _whole)), f"block long, images array<{kind}>, words binary, counts binary, side binary, scene binary, a binary, b binary, c binary")
    table, parts = f"scenes_{uuid.uuid4().hex}", max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    encoded.write.bucketBy(parts, "block").option("path", new_path(spark, "scenes")).saveAsTable(table)
    blocks = spark.table(table)
    asked = blocks.select("block", "words").mapInArrow(_sent(parts), "block long, range int, words binary")
    told = keys.mapInArrow(_placed(parts), "range int, word string, keys array<string>")
    found = asked.groupBy("range").cogroup(told.groupBy("range")).applyInArrow(_found, "block long, range int, hits binary, n binary, keys binary")
    answers = found.groupBy("block").agg(F.collect_list(F.struct("range", "hits", "n", "keys")).alias("known"))
    return blocks.join(answers, "block", "left").mapInArrow(_matched(parts), f"image {kind}, " + ", ".join(f"{x}{k} long" for x in "crm" for k in (1, 2, 3)))
