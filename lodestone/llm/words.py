"""Columnar helpers on UTF-8 text: slices of bounded size, words and ragged gathers.

All of them work on the bytes of an Arrow string column with NumPy, so that the cost of a text is a few passes over
its bytes and Python only sees distinct words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at a time; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

#: Blanks and the control characters U+0009 to U+000D end a word.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SOLID = bytes(0 if b in BLANKS else 1 for b in range(256))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives its free memory back: workers serve one stage after another."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def carried(docs: DataFrame, schema: str, carry: bool) -> tuple[DataFrame, str]:
    """(doc_id, text) of ``docs`` and the schema of what is made of them; with ``carry`` the first is each whole row as ``row``,
    which ``unpacked`` opens, so that a text travels once, and the second ends with it."""
    if not carry:
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), schema
    row = F.struct(*(docs[c] for c in docs.columns))
    return docs.select(row.alias("row")), f"{schema}, row {docs.schema.simpleString()}"


def unpacked(batch: pa.RecordBatch, carry: bool) -> pa.RecordBatch:
    """(doc_id, text), and ``row`` where it is carried."""
    if not carry:
        return batch
    row = batch.column(0)
    return pa.RecordBatch.from_arrays([row.field("doc_id").cast(pa.int64()), row.field("text"), row], names=["doc_id", "text", "row"])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold at most ``limit`` bytes together (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def joined(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """(bytes, starts): the texts in UTF-8, each followed by one blank; text i starts at ``starts[i]``. A null text is empty."""
    some = texts.cast(pa.binary()).to_pylist()
    some = [t or b"" for t in some]
    starts = np.zeros(len(some) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1, out=starts[1:])
    return b" ".join(some) + b" " * bool(some), starts


def pieces(data: bytes, ends: np.ndarray) -> pa.DictionaryArray:
    """Dictionary-encodes the byte strings of ``data`` that end at ``ends`` (each starts where the one before ends)."""
    offsets = np.zeros(len(ends) + 1, dtype=np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of every text of a column.

    ``codes``: for each word its place in ``distinct`` (byte strings); ``first``: for each text the place of its first
    word, with the number of words at the end; ``heads`` and ``lengths``: where each word is in ``data``.
    """

    def __init__(self, texts: pa.Array, fold: bool = False) -> None:
        """``fold``: lower-case A to Z first."""
        self.data, self.starts = joined(texts)
        if fold:
            self.data = self.data.translate(_FOLD)
        solid = np.frombuffer(self.data.translate(_SOLID), dtype=np.uint8)
        edges = np.flatnonzero(np.diff(solid, prepend=np.uint8(0)))  # every text ends with a blank, so edges come in pairs
        self.heads = edges[0::2]
        self.lengths = edges[1::2] - self.heads
        self.first = np.searchsorted(self.heads, self.starts)
        coded = pieces(self.data.translate(None, BLANKS), np.cumsum(self.lengths))
        self.codes = coded.indices.to_numpy()
        self.distinct: list[bytes] = coded.dictionary.to_pylist()


def gather(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Concatenates ``values[offsets[i]:offsets[i + 1]]`` for every i of ``index``."""
    lengths = np.diff(offsets)[index]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(offsets[:-1][index] - (ends - lengths), lengths)]


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums ``values`` over each run ``first[i]:first[i + 1]`` (empty runs: 0)."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def as_list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def as_binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each run ``offsets[i]:offsets[i + 1]`` of a fixed-width array as its bytes, little-endian."""
    values = np.ascontiguousarray(values)
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])
