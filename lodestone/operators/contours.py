"""Contours of masks, counted by bands of lines of an image, so that no shuffle has a row for each pixel.

Tasks gather the pixels of an image's strip of lines into one row as they read them. The strips of an image, which know its size
together, go to the bands of lines that need them, those within reach of a contour included; a band counts its own pixels only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a strip, and of a band at least: one is as high as the contour's reach where that is more.
STRIP, BAND = 64, 512
#: Pixels that a task gathers or measures at once, about.
PIXELS = 1 << 17


def _strips(lines: int, most: int) -> Callable:
    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        image, y, x, t, p = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        y, x = y.to_numpy(), x.to_numpy()
        number, strip = image.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64), y // lines
        order = np.lexsort((strip, number))
        number, strip, y, x = number[order], strip[order], y[order], x[order]
        begin = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (strip[1:] != strip[:-1])])
        ends = pa.array(np.r_[begin, len(y)].astype(np.int32))
        many = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(y), pa.array(x), t.take(order), p.take(order))]
        return pa.RecordBatch.from_arrays([image.take(order[begin]), pa.array(np.minimum.reduceat(y, begin)), pa.array(np.maximum.reduceat(y, begin)), pa.array(np.maximum.reduceat(x, begin)), *many], names=["image", "top", "bottom", "right", "y", "x", "t", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield told(held)
                held, n = [], 0
        if n:
            yield told(held)

    return run


def _inside(line: np.ndarray, at: np.ndarray, code: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether a pixel's run of its class goes on for d steps both ways. Pixels are in order of line, which is a flag where one begins."""
    head = line.copy()
    head[1:] |= (at[1:] - at[:-1] != 1) | (code[1:] != code[:-1])
    begin = np.flatnonzero(head)
    size = np.diff(begin, append=len(head))
    step = np.arange(len(head)) - np.repeat(begin, size)
    return (code >= 0) & (step >= d) & (np.repeat(size, size) - 1 - step >= d)


def _lines(*keys: np.ndarray) -> np.ndarray:
    head = np.ones(len(keys[0]), dtype=bool)
    head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return head


def _measured(batch: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
    """Cells (t, p, pixels, t_edge, p_edge, both) of a batch of bands, of ``size`` pixels each."""
    strips = batch.column("strips").flatten()
    y, x, t, p = (pc.struct_field(strips, c).flatten() for c in ("y", "x", "t", "p"))
    y, x, band = y.to_numpy(), x.to_numpy(), np.repeat(np.arange(batch.num_rows), size)
    named = pa.concat_arrays([t, p]).dictionary_encode()
    codes = named.indices.fill_null(-1).to_numpy().astype(np.int64)
    t, p = codes[: len(y)], codes[len(y) :]
    order = np.lexsort((x, y, band))
    y, x, band, t, p = y[order], x[order], band[order], t[order], p[order]
    d, height, own = (np.repeat(batch.column(c).to_numpy(), size) for c in ("d", "height", "band"))
    begins = _lines(band, y)
    rows = [np.where(_inside(begins, x, c, d), c, -1) for c in (t, p)]
    key = band * (np.int64(x.max()) - x.min() + 1) + (x - x.min())
    down = np.argsort(key.astype(np.min_scalar_type(int(key.max()))), kind="stable")  # lines ascend within a column as before
    begins, y, d, t, p = _lines(band[down], x[down]), y[down], d[down], t[down], p[down]
    edge = [(c >= 0) & ~_inside(begins, y, r[down], d) for c, r in zip((t, p), rows, strict=True)]
    mine = y // height[down] == own[down]
    some, which = np.unique(((t + 1) * (len(named.dictionary) + 1) + p + 1)[mine], return_inverse=True)
    counts = [np.bincount(which, weights=w[mine], minlength=len(some)).astype(np.int64) for w in (np.ones(len(y)), *edge, edge[0] & edge[1] & (t == p))]
    back = [named.dictionary.take(pa.array(c, mask=c < 0)) for c in (some // (len(named.dictionary) + 1) - 1, some % (len(named.dictionary) + 1) - 1)]
    return pa.RecordBatch.from_arrays([*back, *map(pa.array, counts)], names=["t", "p", "pixels", "t_edge", "p_edge", "both"])


def _cells(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strips = batch.column("strips")
            many, pixels = pc.list_value_length(strips).to_numpy(), pc.list_value_length(pc.struct_field(strips.flatten(), "y")).to_numpy()
            size = np.bincount(np.repeat(np.arange(batch.num_rows), many), weights=pixels, minlength=batch.num_rows).astype(np.int64)
            part = (np.cumsum(size) - size) // most
            ends = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield _measured(batch.slice(a, b - a), size[a:b])

    return run


def contour_cells(px: DataFrame, image: str, ratio_of_diagonal: float) -> DataFrame:
    """(t, p, pixels, t_edge, p_edge, both) of each pair of true and predicted class: pixels, those of them that are within d of the
    contour of their true and of their predicted class, and those within both of one class. d is that share of an image's diagonal,
    rounded, 1 at least.

    A pixel is within d of the contour if not all pixels of the square of d steps around it have its class. The square is two
    lines: first runs of a class along the row, then runs along the column of pixels whose row is whole, which serves all classes
    at once. Pixels (image, y, x, t, p) that are not there have no class, nor have those where it is null.
    """
    kind = px.select(F.array("t", "p").alias("c")).schema["c"].dataType.elementType.simpleString()
    own = px.select(F.col(image).alias("image"), *(F.col(c).cast("long").alias(c) for c in "yx"), *(F.col(c).cast(kind).alias(c) for c in "tp"))
    strips = own.mapInArrow(_strips(STRIP, PIXELS), f"image {own.schema['image'].dataType.simpleString()}, top long, bottom long, right long, y array<long>, x array<long>, t array<{kind}>, p array<{kind}>")
    whole = Window.partitionBy("image")
    size = F.greatest(F.lit(1.0), F.bround(ratio_of_diagonal * F.sqrt(F.pow(F.max("bottom").over(whole) + 1, 2.0) + F.pow(F.max("right").over(whole) + 1, 2.0))))
    sized = strips.withColumns({"d": size.cast("long"), "first": F.min("top").over(whole), "last": F.max("bottom").over(whole)}).withColumn("height", F.greatest(F.lit(BAND).cast("long"), F.col("d")))
    band = lambda line: F.floor(line / F.col("height"))
    reach = F.sequence(F.greatest(band(F.col("top") - F.col("d")), band(F.col("first"))), F.least(band(F.col("bottom") + F.col("d")), band(F.col("last"))))
    dealt = sized.select("image", F.explode(reach).alias("band"), "d", "height", F.struct("y", "x", "t", "p").alias("strip")).repartition("image", "band")
    bands = dealt.groupBy("image", "band").agg(F.first("d").alias("d"), F.first("height").alias("height"), F.collect_list("strip").alias("strips"))
    cells = bands.drop("image").mapInArrow(_cells(PIXELS), f"t {kind}, p {kind}, pixels long, t_edge long, p_edge long, both long")
    return cells.groupBy("t", "p").agg(*(F.sum(c).alias(c) for c in ("pixels", "t_edge", "p_edge", "both")))
