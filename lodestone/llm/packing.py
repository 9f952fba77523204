"""Order-preserving packing of documents into fixed windows by dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.tokens import WordEncoder, read_vocabulary
from lodestone.llm.words import as_binary, slices, tidied

#: Ids that wait for cuts at a time, and windows at the end of a block that wait for the next block.
BLOCK_IDS = 1 << 22
CARRY_WINDOWS = 4

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def choose_cuts(ends: np.ndarray, penalty: np.ndarray, window: int, shortest: int = 1) -> np.ndarray:
    """Cuts of least cost: of the sorted allowed positions ``ends`` (the last one is always cut), so that no window is longer
    than ``window``. A window of n ids costs ``window - n`` of padding, or nothing if n is a power of two of ``shortest`` at
    least; a cut costs its ``penalty``. Gaps between neighbours must not exceed ``window``.

    f(j) = penalty(j) + min over i of f(i) + padding(end(j) - end(i)). As the padding is linear, the minimum over the sliding
    range of i is the head of a monotone queue on f(i) + end(i), so each position enters and leaves once; powers of two are
    at most log2(window) exact look-ups a position, found for all positions at once.
    """
    at = np.concatenate([[0], ends]).astype(np.int64)
    n = len(at)
    power, pairs = window, []
    while power >= max(1, shortest):
        if power & (power - 1) == 0:
            where = np.searchsorted(at, at[1:] - power)
            hits = np.flatnonzero(at[where] == at[1:] - power)
            pairs.append(np.stack([hits + 1, where[hits]]))
        power = 1 << (power - 1).bit_length() - 1 if power > 1 else 0
    both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
    order = np.argsort(both[0], kind="stable")
    later, earlier = [*both[0][order].tolist(), n], both[1][order].tolist()
    place, fine = at.tolist(), np.concatenate([[0.0], penalty]).tolist()
    best, back = [0.0] * n, [0] * n
    queue, keys, head, hit = [0], [0.0], 0, 0  # positions and f(i) + end(i), rising from ``head``
    for j in range(1, n):
        p = place[j]
        low = p - window
        while place[queue[head]] < low:
            head += 1
        i = queue[head]
        cost = keys[head] - low
        while later[hit] == j:
            k = earlier[hit]
            hit += 1
            if best[k] <= cost:
                cost, i = best[k], k
        best[j] = cost = cost + fine[j]
        back[j] = i
        key = cost + p
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        queue.append(j)
        keys.append(key)
    cuts = []
    j = n - 1
    while j:
        cuts.append(place[j])
        j = back[j]
    return np.array(cuts[::-1], dtype=np.int64)


class _Stream:
    """Documents of one partition in their order; gives the pieces of finished windows."""

    def __init__(self, window: int, cut_cost: float, hard_cost: float, longest: int, shortest: int, first_sequence: int) -> None:
        self.window, self.cut_cost, self.hard_cost, self.longest, self.shortest = window, cut_cost, hard_cost, longest, shortest
        self.sequence = first_sequence
        self.docs: list[tuple[int | None, np.ndarray, int, int]] = []  # doc_id, ids left, ids before, ids in all
        self.marks: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc: int | None, ids: np.ndarray, stops: np.ndarray) -> None:
        """``stops``: sorted places within the document after a sentence's last id."""
        inner = stops[(stops > 0) & (stops < len(ids))]
        self.docs.append((doc, ids, 0, len(ids)))
        self.marks.append(inner)
        self.waiting += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        if not self.docs:
            return []
        lengths = np.array([len(d[1]) for d in self.docs], dtype=np.int64)
        tops = np.cumsum(lengths)
        soft = np.concatenate([m + b for m, b in zip(self.marks, tops - lengths, strict=True)])
        allowed = np.concatenate([tops, soft])
        cost = np.concatenate([np.zeros(len(tops)), np.full(len(soft), self.cut_cost)])
        order = np.argsort(allowed, kind="stable")
        allowed, cost = allowed[order], cost[order]
        gaps = np.diff(allowed, prepend=0)
        wide = np.flatnonzero(gaps > self.longest)
        if len(wide):  # sentences longer than that get places between, at a higher cost
            extra = np.concatenate([np.arange(allowed[k] - gaps[k] + self.longest, allowed[k], self.longest) for k in wide])
            allowed, cost = np.concatenate([allowed, extra]), np.concatenate([cost, np.full(len(extra), self.hard_cost)])
            order = np.argsort(allowed, kind="stable")
            allowed, cost = allowed[order], cost[order]
        cuts = choose_cuts(allowed, cost, self.window, self.shortest)
        if not last:
            keep = len(cuts) - CARRY_WINDOWS
            cuts = cuts[: max(0, keep)]
            if not len(cuts):
                return []
        out = self._pieces(cuts, tops, lengths)
        end = int(cuts[-1])
        rest, marks = [], []
        for (doc, ids, before, whole), m, top, n in zip(self.docs, self.marks, tops.tolist(), lengths.tolist(), strict=True):
            if top > end:
                skip = max(0, end - (top - n))
                rest.append((doc, ids[skip:], before + skip, whole))
                marks.append(m[m > skip] - skip)
        self.docs, self.marks, self.waiting = rest, marks, int(tops[-1]) - end
        return out

    def _pieces(self, cuts: np.ndarray, tops: np.ndarray, lengths: np.ndarray) -> list[tuple]:
        out, begin, d = [], 0, 0
        bottoms = (tops - lengths).tolist()
        ends = tops.tolist()
        for cut in cuts.tolist():
            offset = 0
            while begin < cut:
                while ends[d] <= begin:
                    d += 1
                doc, ids, before, whole = self.docs[d]
                stop = min(cut, ends[d])
                a = begin - bottoms[d]
                part = ids[a : a + stop - begin]
                out.append((doc, before + a, len(part), part, whole, self.sequence, offset))
                offset += len(part)
                begin = stop
            self.sequence += 1
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, length, parts, whole, sequence, offset = zip(*rows, strict=True)
    at = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(length, out=at[1:])
    ids = as_binary(np.concatenate(parts).astype("<u4"), at)
    longs = [pa.array(x, type=pa.int64()) for x in (doc, start, length, whole, sequence, offset)]
    return pa.RecordBatch.from_arrays([*longs[:3], ids, *longs[3:]], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, vocabulary_path: str, *, window: int = 2048, end_id: int = 1, cut_cost: float = 8.0, hard_cost: float = 24.0, longest_sentence: int = 256, shortest_unpadded: int = 256) -> DataFrame:
    """Packs the ids of every document's whole text into windows of at most ``window`` ids, in the order of the stored rows.

    Takes columns ``doc_id`` and ``text``; others are not read. Windows are cut at document ends (free) or sentence ends
    (``cut_cost`` in ids of padding), by the cuts of least padding plus penalties. A sentence longer than
    ``longest_sentence`` ids may also be cut inside, at ``hard_cost``. A window whose length is a power of two, of
    ``shortest_unpadded`` ids at least, needs no padding. Nothing is shuffled: each input partition is a stream
    of its own and ends with one window that may be short; a partition is held ``BLOCK_IDS`` ids at a time.

    Returns one row for each piece of a document: ``start`` (ids of the document before it), ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens`` (with the end id), ``sequence_id`` and ``offset`` within it. A null or empty text is the end id
    alone; a null ``doc_id`` is kept as null; repeated rows are packed each; an empty table gives no rows.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary.value)
        stream = _Stream(window, cut_cost, hard_cost, min(longest_sentence, window), shortest_unpadded, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for some in slices(batch, limit=6 << 20):
                ids, at = encoder.encode(some.column(1), end=end_id)
                stops = np.flatnonzero(encoder.stops[ids]) + 1
                first = np.searchsorted(stops, at, side="right")
                for i, doc in enumerate(some.column(0).to_pylist()):
                    stream.add(doc, ids[at[i] : at[i + 1]], stops[first[i] : first[i + 1]] - at[i])
                if stream.waiting >= BLOCK_IDS and (rows := stream.flush(last=False)):
                    yield _batch(rows)
        if rows := stream.flush(last=True):
            yield _batch(rows)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidied(run), _SCHEMA)
