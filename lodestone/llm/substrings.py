"""Removal of every byte that a repeated long substring covers, over a whole corpus.

A window is a string of ``length`` bytes. Sampled positions stand for windows: the *anchor* of a window is its k-gram of
least hash (leftmost on ties), which depends on the window's bytes only, so equal windows have equal anchors at equal
distance. Names are induced from the sample to all windows, coarse to fine, and each level only takes up what the one
before it leaves open:

1. anchors whose k-gram is nowhere else cannot belong to a repeated window and end there;
2. the windows of an anchor go in blocks of neighbouring distances. If the bytes common to a block's windows (its core)
   are unique, so are its windows; if the bytes that they cover together (its hull) occur twice, all of them do;
3. only blocks at the edge of a repeat are left, and their windows are named one by one.

Each step is a count by name with partial sums before the shuffle, so a passage that a third of all documents share is one
row of each task, and no list of its places is ever made. Equal texts are one class and go through once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written
from lodestone.llm.words import tidied

#: Bytes of an anchor's k-gram, and distances of a block.
GRAM, SPAN = 64, 64

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ROOT = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(17).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(33)) * _M1
        x = (x ^ x >> np.uint64(33)) * _M2
    return x ^ x >> np.uint64(33)


class Hasher:
    """64-bit names of all substrings of a text from prefix sums of a polynomial."""

    power = inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, data: bytes) -> None:
        n = len(data)
        with np.errstate(over="ignore"):
            if n > len(Hasher.power):
                size = max(1 << 17, 1 << n.bit_length())
                Hasher.power = np.cumprod(np.full(size, _ROOT, dtype=np.uint64))
                Hasher.inverse = np.cumprod(np.full(size, pow(_ROOT, -1, 1 << 64), dtype=np.uint64))
            self.upto = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_TABLE[np.frombuffer(data, dtype=np.uint8)] * Hasher.power[:n], out=self.upto[1:])
        self.n = n

    def every(self, length: int) -> np.ndarray:
        """Names of the substrings of that length, by their start."""
        with np.errstate(over="ignore"):
            return _mixed((self.upto[length:] - self.upto[: self.n - length + 1]) * Hasher.inverse[: self.n - length + 1])

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.upto[end] - self.upto[begin]) * Hasher.inverse[begin])


def anchors(h: Hasher, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, name of its k-gram), in order of windows, for a text of ``length`` bytes at least."""
    names = h.every(gram)
    bits = np.uint64(max(20, int(h.n).bit_length()))
    value = names >> bits << bits | np.arange(len(names), dtype=np.uint64)
    width, m = length - gram + 1, h.n - length + 1
    blocks = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(value)] = value
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], first, np.append(first[1:] - 1, m - 1), names[place[first]].view(np.int64)


def _batch(columns: list[list[np.ndarray]], digests: list[str], counts: list[int], names: list[str]) -> pa.RecordBatch:
    index = pa.array(np.repeat(np.arange(len(digests)), counts).astype(np.int32))
    digest = pa.DictionaryArray.from_arrays(index, pa.array(digests, type=pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([digest, *(c if isinstance(c, pa.Array) else pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int64)) for c in columns)], names=["digest", *names])


def _anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(digest, keys): the k-gram names of each text's anchors, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [anchors(Hasher(d), length, gram)[3] for d in batch.column(1).cast(pa.binary()).to_pylist()]
            at = np.zeros(len(keys) + 1, dtype=np.int32)
            np.cumsum([len(k) for k in keys], out=at[1:])
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["digest", "keys"])

    return texts.select("digest", "text").mapInArrow(tidied(run), "digest string, keys array<long>")


def _blocks(texts: DataFrame, length: int, gram: int, span: int) -> DataFrame:
    """(digest, lo, hi, core, hull) of the blocks of the anchors whose names are in ``keys``: their windows lo to hi, the names
    of core and hull (null where the hull leaves the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = length - gram
        for batch in batches:
            digests, counts = [], []
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for digest, data, keys in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = Hasher(data)
                p, first, last, name = anchors(h, length, gram)
                mine = np.isin(name, np.array(keys, dtype=np.int64))
                p, first, last = p[mine], first[mine], last[mine]
                low, high = p - last, p - first  # distances
                b0, b1 = low // span, high // span
                n = b1 - b0 + 1
                p, low, high = np.repeat(p, n), np.repeat(low, n), np.repeat(high, n)
                d0 = (np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b0, n)) * span
                d1 = np.minimum(d0 + span - 1, top)
                with np.errstate(over="ignore"):
                    salt = d0.astype(np.uint64) * np.uint64(2)
                    core = _mixed(h.at(p - d0, p - d1 + length) + salt).view(np.int64)
                    inside = (p - d1 >= 0) & (p - d0 + length <= h.n)
                    a, b = np.where(inside, p - d1, 0), np.where(inside, p - d0 + length, 0)
                    hull = _mixed(h.at(a, b) + salt + np.uint64(1)).view(np.int64)
                for o, v in zip(out, (p - np.minimum(d1, high), p - np.maximum(d0, low), core, hull, inside), strict=True):
                    o.append(v)
                digests.append(digest)
                counts.append(len(p))
            if digests:
                hulls = pa.array(np.concatenate(out[3]), mask=~np.concatenate(out[4]))
                yield _batch([*out[:3], hulls], digests, counts, ["lo", "hi", "core", "hull"])

    return texts.select("digest", "text", "keys").mapInArrow(tidied(run), "digest string, lo long, hi long, core long, hull long")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(digest, at, name) of the windows in each text's ``ranges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts = [], []
            out: list[list[np.ndarray]] = [[], []]
            for digest, data, ranges in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges])
                out[0].append(at)
                out[1].append(Hasher(data).at(at, at + length).view(np.int64))
                digests.append(digest)
                counts.append(len(at))
            if digests:
                yield _batch(out, digests, counts, ["at", "name"])

    return texts.select("digest", "text", "ranges").mapInArrow(tidied(run), "digest string, at long, name long")


def _cleaned(texts: DataFrame, length: int) -> DataFrame:
    """(digest, kept_text, n_removed, n_spans, kept_sha256, spans) of texts without the bytes of the windows in ``ranges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, data, ranges in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"] + length) for r in ranges):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                edges = [0, *(x for s in spans for x in s), len(data)]
                parts = [data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)]
                kept = b"".join(parts)
                out.append((digest, "".join(x.decode("utf-8", "ignore") for x in parts), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"begin": a, "end": b} for a, b in spans]))
            if out:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["digest", "kept_text", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.select("digest", "text", "ranges").mapInArrow(tidied(run), "digest string, kept_text string, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>")


def _twice(names: DataFrame) -> DataFrame:
    """The names that occur more than once; counted before they are shuffled."""
    return names.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name")


def repeated_ranges(docs: DataFrame, *, length: int = 400, gram: int = GRAM, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(classes, found): (digest, n_bytes, copies) of each distinct text, and (digest, text, ranges) of those with repeated
    windows that are not a copy as a whole, where ``ranges`` are the windows lo to hi."""
    text = F.coalesce("text", F.lit(""))
    known = docs.select(F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), text.alias("text"))
    counted = known.select("digest", F.octet_length("text").cast("long").alias("n_bytes")).groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))
    classes = written(counted, "texts")
    # k-gram names of all rows, one set of a text's anchors for each distinct text
    keyed = written(_anchored(known.filter(F.octet_length("text") >= length), length, gram).groupBy("digest").agg(F.first("keys").alias("keys")), "anchors")
    each = keyed.select("digest", F.explode("keys").alias("name"))
    shared = each.distinct().join(_twice(each), "name").groupBy("digest").agg(F.collect_list("name").alias("keys"))
    distinct = known.filter(F.octet_length("text") >= length).groupBy("digest").agg(F.first("text").alias("text"))
    texts = written(distinct.join(shared, "digest"), "repeats")  # texts with an anchor that is also elsewhere
    blocks = written(_blocks(texts, length, gram, span), "blocks")
    names = blocks.select(F.col("core").alias("name")).unionByName(blocks.filter("hull is not null").select(F.col("hull").alias("name")))
    twice = written(_twice(names), "names")
    cores, hulls = twice.select(F.col("name").alias("core")), twice.select(F.col("name").alias("hull"), F.lit(True).alias("whole"))
    judged = written(blocks.join(cores, "core").join(hulls, "hull", "left").withColumn("whole", F.coalesce("whole", F.lit(False))), "judged")
    open_cores = judged.filter("not whole").select("core").distinct()
    # of blocks with the same repeated hull one is enough to repeat the windows of those that are open
    helpers = judged.filter("whole").groupBy("core", "hull").agg(F.min(F.struct("digest", "lo", "hi")).alias("b")).join(open_cores, "core", "left_semi").select("b.*")
    fine = judged.filter("not whole").select("digest", "lo", "hi").unionByName(helpers).groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    windows = written(_windows(texts.select("digest", "text").join(fine, "digest"), length), "windows")
    single = windows.join(_twice(windows.select("name")), "name").select("digest", F.col("at").alias("lo"), F.col("at").alias("hi"))
    ranges = judged.filter("whole").select("digest", "lo", "hi").unionByName(single).groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    copied = classes.filter("copies > 1").select("digest")
    return classes, texts.select("digest", "text").join(ranges, "digest").join(copied, "digest", "left_anti")


def remove_repeats(docs: DataFrame, *, length: int = 400, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """Every row of ``docs`` with ``kept_text`` (null if nothing was removed; bytes of a character that is cut in two go too), n_bytes, n_removed, n_spans, kept_sha256 and
    ``spans`` (removed runs, by bytes): each byte goes that a string of ``length`` bytes covers which also starts anywhere
    else, in the same text or another.

    Takes ``text``; all other columns are passed on, and those that have one of these names are replaced by it. A null or empty text has no bytes;
    texts shorter than ``length`` keep all; equal texts of that length lose all; an empty table gives no rows.
    """
    classes, found = repeated_ranges(docs, length=length, gram=gram, span=span)
    cleaned = written(_cleaned(found, length), "cleaned")
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    told = classes.join(cleaned, "digest", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    told = told.select(
        "digest",
        F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.col("spans")).alias("spans"),
    )
    own = docs.drop(*(c for c in docs.columns if c != "digest" and c in told.columns))
    return own.withColumn("__digest", digest).join(told.withColumnRenamed("digest", "__digest"), "__digest").drop("__digest")
