"""Near-duplicates by SetSketch registers: bands propose, the joint likelihood sifts, full shingle sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.graph import components
from lodestone.llm.shared import written
from lodestone.llm.words import Words, gather, slices, tidied

#: Registers of a sketch, and the chance at which two sets at the threshold may share no band.
REGISTERS, MISS = 200, 3e-7
#: The base of the registers' exponential scale, and their greatest value.
BASE, TOP = 1.02, (1 << 16) - 1
#: A pair goes on to the full sets unless its registers are so unlikely at the threshold: twice the log-likelihood ratio;
#: a pair at the threshold fails this with a chance of 1.1e-5.
SIFT = 18.0
#: Members of a bucket in a block, and shingles of their sets; a task compares two blocks at a time.
BLOCK, NAMES = 1024, 1 << 21

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(33)) * _M1
        x = (x ^ x >> np.uint64(33)) * _M2
    return x ^ x >> np.uint64(33)


class Shingler:
    """The set of word shingles of each text of a column, as sorted distinct 64-bit names."""

    def __init__(self, words: int) -> None:
        self.n = words
        self.known: dict[bytes, int] = {}

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        w = Words(texts, fold=True)
        if len(self.known) > 1 << 17:
            self.known.clear()
        names = []
        for word in w.distinct:
            h = self.known.get(word)
            if h is None:
                h = xxhash.xxh3_64_intdigest(word)
                if len(word) <= 64:
                    self.known[word] = h
            names.append(h)
        every = np.array(names, dtype=np.uint64)[w.codes] if names else np.zeros(0, dtype=np.uint64)
        grams = every.copy()
        with np.errstate(over="ignore"):
            for k in range(1, self.n):
                grams = _mixed(grams[: len(every) - k] * np.uint64(3) + every[k:]) if len(every) >= k else grams[:0]
        out = []
        for a, b in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
            if b - a >= self.n:
                out.append(np.unique(grams[a : b - self.n + 1]))
            elif b > a:  # fewer words: the whole sequence, told apart by its length
                out.append(np.array([xxhash.xxh3_64_intdigest(every[a:b].tobytes(), seed=b - a)], dtype=np.uint64))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def _digest(names: np.ndarray) -> bytes:
    return hashlib.blake2b(names.tobytes(), digest_size=16).digest()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), REGISTERS) of 16-bit registers floor(1 - log_b(h)), h the least of the elements' exponential hash values:
    exponentially spaced, truncated minima. The register-wise maximum is that of the union."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(sets), REGISTERS), dtype="<u2")
    if not full:
        return out
    flat = _mixed(np.concatenate(full))
    starts = np.zeros(len(full), dtype=np.int64)
    np.cumsum([len(s) for s in full[:-1]], out=starts[1:])
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(full), REGISTERS), dtype=np.uint32)
    seeds = np.random.default_rng(20240229).integers(0, 1 << 32, size=(REGISTERS, 2), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for r in range(REGISTERS):
            h = low * (seeds[r, 0] | np.uint32(1))
            h += high ^ seeds[r, 1]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            least[:, r] = np.minimum.reduceat(h, starts)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    out[[i for i, s in enumerate(sets) if len(s)]] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")
    return out


def band_rows(percent: int) -> int:
    """Registers of a band: the most at which two sets of that similarity share a band but for a chance of ``MISS``; at 80 these
    are 5, in 40 bands, with 1 - (1 - 0.8^5)^40 > 1 - 2e-7. Similarities for which one register is too many are refused."""
    fit = [r for r in range(1, 9) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISS]
    if not fit or percent > 100:
        raise ValueError(f"{REGISTERS} registers cannot find sets of similarity {percent} %")
    return fit[-1]


def _bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands, rows); registers left over are in no band."""
    return regs[:, : REGISTERS // rows * rows].reshape(len(regs), REGISTERS // rows, rows)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) of 64-bit names of the bands, each with its number."""
    grouped = _bands(regs, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, grouped.shape[1] + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key.view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of register rows may have that similarity: the joint maximum-likelihood estimate from the counts of greater,
    smaller and equal registers is at least ``threshold``, or the counts are not too unlikely there (``SIFT``)."""
    up = (a > b).sum(1).astype(np.float64)
    down = (a < b).sum(1).astype(np.float64)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def value(j: np.ndarray) -> np.ndarray:
        share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        more, less = share(u - v * j), share(v - u * j)
        return sum(c * np.log(np.clip(p, 1e-12, 1)) for c, p in ((up, more), (down, less), (same, 1 - more - less)))

    at = value(np.minimum(threshold, top))
    best = np.full(len(a), -np.inf)
    where = np.zeros(len(a))
    for g in np.linspace(0, 1, 49):
        now = value(g * top)
        better = now > best
        best[better], where[better] = now[better], (g * top)[better]
    return (where >= threshold) | (2 * (best - at) <= SIFT)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for some in slices(batch):
                sets = shingler.sets(some.column(1))
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([_digest(s) for s in sets], type=pa.binary()), pa.array([r.tobytes() for r in regs], type=pa.binary())], names=["doc_id", "n", "digest", "regs"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidied(run), "doc_id long, n long, digest binary, regs binary")


def _banded(classes: DataFrame, rows: int) -> DataFrame:
    bands = REGISTERS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(batch.num_rows, REGISTERS)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(band_keys(regs, rows).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), keys], names=["id", "n", "keys"])

    return classes.select("id", "regs", "n").mapInArrow(tidied(run), "id long, n long, keys array<long>").select("id", "n", F.explode("keys").alias("key"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets hold 100 * intersection >= percent * union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    small = classes.select("id", "regs", "n")
    side = lambda c: texts.join(small, "id").select(*(F.col(x).alias(f"{x}_{c}") for x in ("id", "text", "regs", "n")))
    rows = pairs.join(side("b"), F.col("b") == F.col("id_b")).join(side("a"), F.col("a") == F.col("id_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        kept: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, _, _, regs_a, regs_b, n_a, n_b = batch.columns
            n_a, n_b = n_a.to_numpy(), n_b.to_numpy()
            table = lambda c: np.frombuffer(b"".join(c.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
            hopeful = np.flatnonzero((100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & likely(table(regs_a), table(regs_b), n_a, n_b, percent / 100))
            left, right = [], []
            ids_a, ids_b = a.to_numpy(), b.to_numpy()
            for i in hopeful.tolist():
                if kept[0] != ids_a[i]:
                    kept = (ids_a[i], shingler.sets(batch.column(2).slice(i, 1))[0])
                x, y = kept[1], shingler.sets(batch.column(3).slice(i, 1))[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    left.append(ids_a[i])
                    right.append(ids_b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["a", "b"])

    return rows.select("a", "b", "text_a", "text_b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(tidied(run), "a long, b long")


def _pairs(key: int, x: int, y: int, ids: np.ndarray, block: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later members) of two blocks of a bucket that are in different components and may be similar by the number of equal
    registers. Of the buckets that two members share, only that of their first common band reports the pair."""
    rows = band_rows(percent)
    band = int(np.flatnonzero(band_keys(regs[:1], rows)[0] == key)[0])
    for i in range(len(ids) - 1):
        rest = np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))) + i + 1
        if x != y:
            rest = rest[block[rest] != block[i]]
        if len(rest):
            equal = regs[rest] == regs[i]
            equal, rest = (v[equal.sum(1) >= REGISTERS * (percent / 100 - 0.2)] for v in (equal, rest))
            rest = rest[_bands(equal, rows).all(2).argmax(1) == band]
        if len(rest):
            yield i, rest


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows, over batches, whose first ``width`` columns are alike, where they have two rows or more."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != row[:width]:
                if len(held) > 1:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if len(held) > 1:
        yield key, held


def _table(regs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(regs), dtype="<u2").reshape(-1, REGISTERS)


def _suspects(rows: DataFrame, percent: int) -> DataFrame:
    """(key, x, y, block, id) of each member that may be similar, by its registers, to another of the two blocks: a row a
    member, however many such partners it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []  # pairs of many buckets, whose likelihood is computed together
        marked: dict[tuple, set[tuple[int, int]]] = {}

        def sift() -> None:
            where, a, b, n_a, n_b, regs_a, regs_b = zip(*found, strict=True)
            counts = [len(v) for v in b]
            repeated = lambda v: np.repeat(np.array(v), counts, axis=0)
            ok = likely(repeated(regs_a), np.concatenate(regs_b), repeated(n_a), np.concatenate(n_b), percent / 100)
            at = 0
            for group, left, right, c in zip(where, a, b, counts, strict=True):
                if (hits := ok[at : at + c]).any():
                    marked.setdefault(group, set()).update([left, *map(tuple, right[hits].tolist())])
                at += c
            found.clear()

        def told() -> pa.RecordBatch:
            out = [(*group, *m) for group, members in marked.items() for m in members]
            marked.clear()
            return pa.RecordBatch.from_pylist([dict(zip(("key", "x", "y", "block", "id"), r, strict=True)) for r in out], schema=pa.schema([("key", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("block", pa.int32()), ("id", pa.int64())]))

        total = 0
        for group, members in _groups(batches, 3):
            block, ids, comp, n = (np.array([m[k] for m in members]) for k in range(4))
            regs, named = _table([m[4] for m in members]), np.stack([block, ids], axis=1)
            for i, rest in _pairs(*group, ids, block, comp, n, regs, percent):
                found.append((group, (int(block[i]), int(ids[i])), named[rest], n[i], n[rest], regs[i], regs[rest]))
                total += len(rest)
                if total > 1 << 14:
                    sift()
                    total = 0
            if sum(map(len, marked.values())) > 1 << 14:
                if found:
                    sift()
                    total = 0
                yield told()
        if found:
            sift()
        if marked:
            yield told()

    return rows.mapInArrow(tidied(run), "key long, x int, y int, block int, id long")


def _named_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, digest, names) of each different set of an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for some in slices(batch):
                sets = shingler.sets(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([_digest(s) for s in sets], type=pa.binary()), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["id", "digest", "names"])

    return docs.select("id", "text").mapInArrow(tidied(run), "id long, digest binary, names binary").dropDuplicates(["id", "digest"])


def _joining(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold on the full sets, of each two blocks only those that join what was apart: fewer than members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, members in _groups(batches, 3):
            block, ids, comp = (np.array([m[k] for m in members]) for k in range(3))
            regs = _table([m[3] for m in members])
            every = [np.frombuffer(m[4], dtype=np.uint64) for m in members]
            offsets = np.zeros(len(every) + 1, dtype=np.int64)
            n = np.array([len(v) for v in every])
            np.cumsum(n, out=offsets[1:])
            names, codes = np.unique(np.concatenate(every), return_inverse=True)
            del members, every
            mark, left, right = np.zeros(len(names), dtype=bool), [], []
            for i, rest in _pairs(*group, ids, block, comp, n, regs, percent):  # comp changes as links are found
                rest = rest[likely(np.broadcast_to(regs[i], (len(rest), REGISTERS)), regs[rest], np.full(len(rest), n[i]), n[rest], percent / 100)]
                own = codes[offsets[i] : offsets[i + 1]]
                mark[own] = True
                for begin in range(0, len(rest), 64):
                    some = rest[begin : begin + 64]
                    some = some[comp[some] != comp[i]]
                    if not len(some):
                        continue
                    ends = np.cumsum(n[some])
                    both = np.add.reduceat(mark[gather(codes, offsets, some)].astype(np.int64), ends - n[some])
                    for j in some[100 * both >= percent * (n[some] + n[i] - both)].tolist():
                        if comp[j] != comp[i]:
                            left.append(min(ids[i], ids[j]))
                            right.append(max(ids[i], ids[j]))
                            comp[comp == comp[j]] = comp[i]
                mark[own] = False
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["a", "b"])

    return rows.mapInArrow(tidied(run), "a long, b long")


def _apart(bands: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b), true on the full sets, that join all components of which members share a bucket and are similar.

    The members of a bucket's largest component are joined already, so only the rest are compared, with each other and with
    them. Both sides are dealt by hash to blocks of about BLOCK members and NAMES shingles; a task compares two blocks at a
    time, first by registers, then those that may be similar by their sets. It returns members or joining links, not pairs.
    """
    placed = bands.join(parts, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    per = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("names"))
    mixed = per.groupBy("key").agg(F.count("*").alias("parts"), F.sum("c").alias("c"), F.sum("names").alias("names"), F.max(F.struct("c", "names", "component")).alias("top")).filter("parts > 1")
    blocks = lambda c, names: F.greatest(F.ceil(c / BLOCK), F.ceil(names / NAMES)).cast("int")
    mixed = mixed.select("key", F.col("top.component").alias("top"), blocks(F.col("c") - F.col("top.c"), F.col("names") - F.col("top.names")).alias("others"), blocks(F.col("top.c"), F.col("top.names")).alias("own"))
    joined = F.col("component") == F.col("top")
    hashed = F.xxhash64("id")
    dealt = placed.join(mixed, "key").withColumn("block", F.when(joined, F.col("others") + F.pmod(hashed, F.col("own"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int"))
    met = F.sequence(F.lit(0), F.when(joined, F.col("others") - 1).otherwise(F.col("others") + F.col("own") - 1))
    copies = dealt.select("key", "id", "component", "n", "block", F.explode(met).alias("other"))
    rows = copies.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "component", "n")
    together = lambda df: df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    suspects = written(_suspects(together(rows.join(classes.select("id", "regs"), "id").select("key", "x", "y", "block", "id", "component", "n", "regs")), percent), "suspects")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(suspects.select("id").distinct(), "id", "left_semi")
    sets = written(_named_sets(texts, words), "sets")
    known = suspects.join(parts, "id", "left").join(classes.select("id", "digest", "regs"), "id").join(sets, ["id", "digest"])
    return _joining(together(known.select("key", "x", "y", "block", "id", F.coalesce("component", "id").alias("component"), "regs", "names")), percent)


def near_duplicates(docs: DataFrame, *, words: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) of each row: documents whose sets of distinct word shingles hold
    100 * intersection >= percent * union are linked; a component is all that links reach.

    Takes ``doc_id`` and ``text``; others are not read. Words are runs without white space, A-Z lower-cased; a text of fewer
    words is one shingle; a null text or one without words has the empty set and is linked with nothing. Rows of one set
    are a class (``class_id``, its smallest doc_id) and only classes go on. A class proposes itself with the pivot of each of
    its buckets, the member of least hash, which many buckets share; links change components; then members of a bucket that are still in
    different components are compared in blocks, by registers and then, where these leave it open, on their sets, and only
    links that join components are returned, so that no component is lost to the choice of pivots and no bucket emits its pairs. Rows with a null doc_id keep their counts and have a
    null component; rows of one doc_id count as linked; an empty table gives no rows.
    """
    sketched = written(_sketched(docs, words), "sketches")
    classes = written(sketched.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")), "sketch-classes")
    bands = _banded(classes, band_rows(percent))
    pivot = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("p"), F.count("*").alias("c")).filter("c > 1").select("key", F.col("p.id").alias("pivot"))
    met = written(bands.join(pivot, "key"), "bands")  # buckets of one member end here
    pairs = met.filter("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = written(_confirmed(pairs, classes, docs, words, percent), "links")
    parts = components(links)
    more = written(_apart(met.select("key", "id", "n"), parts, classes, docs, words, percent), "links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    members = classes.select("digest", F.col("id").alias("class_id")).join(parts.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    known = sketched.select("doc_id", "n", "digest").join(members, "digest", "left")
    alone = F.col("n") == 0
    component = F.when(F.col("doc_id").isNull(), None).when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "class_id"))
    out = known.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
