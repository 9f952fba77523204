"""Removal of words that a repeated window of words covers, where the first occurrence stays.

Every window of ``window`` words has a Rabin-Karp name (a polynomial of its words' digests, from prefix sums), and names are
counted in Spark:

1. 32 bits of each name and the bucket it falls in are counted over all windows; a window whose count is 1 is unique. A task
   sends a name once, however often its texts have it, and gets back which of its windows are left.
2. The windows that are left are named anew, by 80 further bits, and each name's first occurrence is found: all others are
   repeats. So no chance of the first count removes a word, and two windows are only taken for one if 80 bits and a bucket agree.
3. Repeated windows of a text merge into maximal runs of words, which go.

A bucket holds about ``BUCKET`` names; names and places travel as packed arrays, one for each pair of task slice and bucket.
Equal texts go through once and are told apart by row at the end, by joins whose keys are unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written
from lodestone.llm.words import Words, gather, slices, tidied

#: Names of a bucket, about.
BUCKET = 1 << 21

#: Bytes of text that share one exchange of names.
SLICE = 8 << 20

_ROOT = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(33)) * _M1
        x = (x ^ x >> np.uint64(33)) * _M2
    return x ^ x >> np.uint64(33)


class Powers:
    """Powers of the polynomial's root and of its inverse, as far as needed yet."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if n > len(cls.up):
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.full(size, _ROOT, dtype=np.uint64))
                cls.down = np.cumprod(np.full(size, pow(_ROOT, -1, 1 << 64), dtype=np.uint64))


def word_digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each word."""
    both = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words), dtype=np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def window_names(digests: np.ndarray, window: int, at: np.ndarray | None = None) -> np.ndarray:
    """Rabin-Karp names of the windows of a row of word digests that start at ``at`` (default: of all)."""
    n = len(digests)
    Powers.reach(n + 1)
    with np.errstate(over="ignore"):
        upto = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(digests * Powers.up[:n], out=upto[1:])
        if at is None:
            m = max(0, n - window + 1)
            return _mixed((upto[window:] - upto[:m]) * Powers.down[:m])
        return _mixed((upto[at + window] - upto[at]) * Powers.down[at])


def window_starts(first: np.ndarray, window: int) -> np.ndarray:
    """Places of the words at which a window starts that lies in one text; text i has the words ``first[i]`` to ``first[i + 1]``."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first[:-1] - (ends - counts), counts)


def _planes(values: np.ndarray) -> bytes:
    """An array with its first bytes together, then its second ones and so on: small numbers then compress to little."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as their distances."""
    return _planes(np.diff(places, prepend=0).astype(np.uint32))


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(data, np.uint32).astype(np.int64))


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each name, by its upper half."""
    return (names >> _HALF) % np.uint64(buckets)


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in it, ascending) of every bucket that has some."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets)))
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        yield int(bucket[order[lo]]), order[lo:hi]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLICE`` bytes of text (``text``): small ones together, large ones cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            if held and size + part.nbytes > SLICE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held and any(len(h) for h in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_SENT = "bucket long, slice long, names binary, marks binary, places binary, keys binary, first binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), *(pa.binary(),) * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "slice", "names", "marks", "places", "keys", "first"])


def _first_names(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """For each slice of ``texts`` (key, text): a row for each bucket with the names (32 bits), their places and a mark for those
    that the slice has twice; and a row with a negative bucket of the texts' keys and the places of names that it has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            known = batch.column(0).dictionary_encode()
            some = np.unique(known.indices.to_numpy(), return_index=True)[1]  # each text once
            keys, texts_ = known.dictionary, batch.column(1).take(pa.array(some))
            words = Words(texts_)
            starts = window_starts(words.first, window)
            if not len(starts):
                continue
            names = window_names(word_digests(words.distinct)[0][words.codes], window, starts)
            order = np.argsort(names)
            twice = names[order[1:]] == names[order[:-1]]
            again, first = np.zeros(len(names), dtype=bool), np.ones(len(names), dtype=bool)
            again[order[1:][twice]] = again[order[:-1][twice]] = True
            first[order[1:][twice]] = False
            joined = b"".join(keys.to_pylist())
            number = int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "little", signed=True)
            send = np.flatnonzero(first)
            sent = names[send]
            rows = [(-1 - (number % buckets), number, None, None, _steps(starts[again]), joined, words.first.astype(np.int64).tobytes())]
            for bucket, at in _by_bucket(_bucket(sent, buckets), buckets):
                rows.append((bucket, number, (sent[at] & _LOW).astype(np.uint32).tobytes(), np.packbits(again[send[at]]).tobytes(), _steps(starts[send[at]]), None, None))
            yield _sent(rows)

    return texts.select("key", "text").mapInArrow(tidied(run), _SENT)


_FOUND = "slice long, places binary, keys binary, first binary"


def _counted(sent: DataFrame) -> DataFrame:
    """(slice, places, keys, first): places of the names of each bucket that occur more than once; rows with keys are passed on."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["bucket", "slice", "names", "marks", "places", "keys", "first"]).to_pylist()
        out = [(r["slice"], r["places"], r["keys"], r["first"]) for r in rows if r["names"] is None]
        rows = [r for r in rows if r["names"] is not None]
        if rows:
            names = [np.frombuffer(r["names"], dtype=np.uint32) for r in rows]
            ends = np.cumsum([len(n) for n in names])
            marks = np.concatenate([np.unpackbits(np.frombuffer(r["marks"], dtype=np.uint8), count=len(n)).astype(bool) for r, n in zip(rows, names, strict=True)])
            coded = np.sort(np.concatenate(names).astype(np.uint64) << _HALF | np.arange(ends[-1], dtype=np.uint64))
            value, at = coded >> _HALF, (coded & _LOW).astype(np.int64)
            same = value[1:] == value[:-1]
            some = np.zeros(len(at), dtype=bool)
            some[at[1:][same]] = some[at[:-1][same]] = True
            some &= ~marks
            for r, n, end in zip(rows, names, ends.tolist(), strict=True):
                mine = np.flatnonzero(some[end - len(n) : end])
                if len(mine):
                    out.append((r["slice"], _steps(_places(r["places"])[mine]), None, None))
        return pa.Table.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True) if out else ([],) * 4, (pa.int64(), *(pa.binary(),) * 3), strict=True)], names=["slice", "places", "keys", "first"])

    return sent.groupBy("bucket").applyInArrow(run, _FOUND)


def _by_text(found: DataFrame) -> DataFrame:
    """(key, starts): the windows of each text among the places of its slice."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["slice", "places", "keys", "first"]).to_pylist()
        held = next(r for r in rows if r["keys"] is not None)
        first = np.frombuffer(held["first"], dtype=np.int64)
        places = np.unique(np.concatenate([_places(r["places"]) for r in rows]))
        edges = np.searchsorted(places, first)
        keys, starts = [], []
        for i in np.flatnonzero(np.diff(edges)).tolist():
            keys.append(held["keys"][16 * i : 16 * i + 16])
            starts.append(_steps(places[edges[i] : edges[i + 1]] - first[i]))
        return pa.Table.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.binary())], names=["key", "starts"])

    return found.groupBy("slice").applyInArrow(run, "key binary, starts binary")


def _second_names(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """As ``_first_names``, of the windows ``starts`` of ``texts`` (key, text, starts, doc_id): names of 80 bits, and of each name only
    the first occurrence in the slice, with the order of its text (``keys``: doc_id, whether it is null and key); the negative
    bucket has the places of the others, which are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            keys, starts = batch.column(0).to_pylist(), [_places(s) for s in batch.column(2).to_pylist()]
            ids = batch.column(3)
            order = sorted(range(len(keys)), key=lambda i: (ids[i].as_py() is None, ids[i].as_py() or 0, keys[i]))
            rank = np.empty(len(keys), dtype=np.int64)
            rank[order] = np.arange(len(keys))
            words = Words(batch.column(1))
            upper, lower = word_digests(words.distinct)
            counts = np.array([len(s) for s in starts])
            owner = np.repeat(np.arange(len(keys)), counts)
            at = np.concatenate(starts) + words.first[:-1][owner]
            one, two = window_names(upper[words.codes], window, at), window_names(lower[words.codes], window, at)
            by = np.lexsort((at, rank[owner], two, one))
            same = np.zeros(len(by), dtype=bool)
            same[1:] = (one[by[1:]] == one[by[:-1]]) & (two[by[1:]] == two[by[:-1]])
            repeat = np.zeros(len(by), dtype=bool)
            repeat[by[same]] = True
            joined = b"".join(keys)
            number = int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "little", signed=True)
            rows = [(-1 - (number % buckets), number, None, None, _steps(at[repeat]), joined, words.first.astype(np.int64).tobytes())]
            send = np.flatnonzero(~repeat)
            known = np.array([(k is not None) for k in ids.to_pylist()])
            plain = np.array([k or 0 for k in ids.to_pylist()], dtype=np.int64)
            for bucket, some in _by_bucket(_bucket(one[send], buckets), buckets):
                mine = send[some]
                who, times = np.unique(owner[mine], return_counts=True)
                head = plain[who].tobytes() + b"".join(keys[i] for i in who.tolist())
                names = two[mine].tobytes() + (one[mine] & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
                rows.append((bucket, number, names, np.packbits(known[who]).tobytes() + _planes(times.astype(np.uint32)), _steps(at[mine]), head, None))
            yield _sent(rows)

    return texts.select("key", "text", "starts", "doc_id").mapInArrow(tidied(run), _SENT)


def _later(sent: DataFrame) -> DataFrame:
    """(slice, places, keys, first): places of the names of each bucket that are not the first of theirs."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["bucket", "slice", "names", "marks", "places", "keys", "first"]).to_pylist()
        out = [(r["slice"], r["places"], r["keys"], r["first"]) for r in rows if r["names"] is None]
        rows = [r for r in rows if r["names"] is not None]
        if rows:
            two, tail, ids, null, keys, times = [], [], [], [], [], []
            for r in rows:
                n, t = len(r["names"]) // 10, len(r["keys"]) // 24
                two.append(np.frombuffer(r["names"], dtype=np.uint64, count=n))
                tail.append(np.frombuffer(r["names"], dtype=np.uint16, offset=8 * n))
                ids.append(np.frombuffer(r["keys"], dtype=np.int64, count=t))
                keys.append(np.frombuffer(r["keys"], dtype=">u8", offset=8 * t).reshape(-1, 2))
                bits = -(-t // 8)
                null.append(np.unpackbits(np.frombuffer(r["marks"][:bits], dtype=np.uint8), count=t) == 0)
                times.append(_unplaned(r["marks"][bits:], np.uint32))
            ends = np.cumsum([len(t) for t in two])
            both = np.concatenate(keys)
            order = np.lexsort((both[:, 1], both[:, 0], np.concatenate(ids), np.concatenate(null)))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            text = np.repeat(rank, np.concatenate(times))
            a, b = np.concatenate(two), np.concatenate(tail)
            by = np.lexsort((text, b, a))  # of one text and name, a slice sends the first
            later = np.zeros(len(by), dtype=bool)
            later[by[1:]] = (a[by[1:]] == a[by[:-1]]) & (b[by[1:]] == b[by[:-1]])
            for r, t, end in zip(rows, two, ends.tolist(), strict=True):
                mine = np.flatnonzero(later[end - len(t) : end])
                if len(mine):
                    out.append((r["slice"], _steps(_places(r["places"])[mine]), None, None))
        return pa.Table.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True) if out else ([],) * 4, (pa.int64(), *(pa.binary(),) * 3), strict=True)], names=["slice", "places", "keys", "first"])

    return sent.groupBy("bucket").applyInArrow(run, _FOUND)


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _cleaned(texts: DataFrame, window: int) -> DataFrame:
    """(key, kept_text, n_removed, spans, kept_sha256) of ``texts`` without the words of the windows ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            out = []
            for key, data, starts in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, at = data.split(), _places(starts)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((key, kept.decode(), int(gone.sum()), [{"begin": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)], hashlib.sha256(kept).hexdigest()))
            kinds = (pa.binary(), pa.string(), pa.int64(), _SPANS, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "kept_text", "n_removed", "spans", "kept_sha256"])

    return texts.select("key", "text", "starts").mapInArrow(tidied(run), "key binary, kept_text string, n_removed long, spans array<struct<begin: long, end: long>>, kept_sha256 string")


def _told(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, words_sha256) of every row: of all its words, joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for data in batch.column(2).cast(pa.binary()).to_pylist():
                words = data.split()  # bytes are split at the blank and at 09 to 0D only
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "key", "n_words", "words_sha256"])

    return docs.select("doc_id", "key", "text").mapInArrow(tidied(run), "doc_id long, key binary, n_words long, words_sha256 string")


def repeated_windows(docs: DataFrame, *, window: int = 20, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text, kept_sha256) of every row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``. Each word goes that a window of ``window`` words covers whose words also start earlier: in
    the same text, or in a row before it. Rows are ordered by doc_id (null last), then by the digest of their text, and
    of rows that are the same in both one is first. ``spans`` are the runs of removed words, ``kept_text`` the other words joined by
    one blank (null where no word goes), ``kept_sha256`` its digest.

    A null or empty text has no words; a text of fewer words than a window keeps them; equal texts keep the first alone; an
    empty table gives no rows; columns other than these two are not read.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"), text.alias("text"))
    rows = written(_told(keyed).withColumn("row", F.monotonically_increasing_id()), "rows")
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def buckets(total: int | None) -> int:
        return max(min(usual, (total or 0) // 200_000), -(-(total or 0) // bucket), 1)

    total = rows.agg(F.sum(F.greatest(F.col("n_words") - (window - 1), F.lit(0)))).first()[0]
    long_enough = keyed.filter(F.octet_length("text") >= 2 * window - 1)
    first = _by_text(_counted(_first_names(long_enough, window, buckets(total))))
    # the places of a text are the same whichever of its copies they come from
    candidates = first.groupBy("key").agg(F.max("starts").alias("starts"))
    distinct = long_enough.groupBy("key").agg(F.first("text").alias("text"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))["doc_id"].alias("doc_id"))
    held = written(distinct.join(candidates, "key"), "repeats")
    left = held.agg(F.sum(F.octet_length("starts") / 4)).first()[0]
    later = _by_text(_later(_second_names(held, window, buckets(int(left or 0)))))
    cleaned = _cleaned(held.select("key", "text").join(later, "key"), window)
    firsts = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))["row"].alias("row"))
    known = firsts.join(cleaned, "key", "left").drop("key").withColumn("is_first", F.lit(True))
    all_ = F.col("is_first").isNull() & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    no_spans = F.expr("cast(array() as array<struct<begin: long, end: long>>)")
    return rows.join(known, "row", "left").select(
        "doc_id",
        "n_words",
        F.when(all_, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", no_spans)).alias("spans"),
        F.when(all_, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(all_, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )
