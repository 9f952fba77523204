"""Tables from files, and detection scenes from COCO JSON."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV and TSV (with header), Parquet, JSON lines or JSON, by the file's extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == "tsv" else ",")
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.json(path, multiLine=kind == "json")
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"{path}: unknown kind of table")


def from_coco(spark: SparkSession, truth: str, results: str) -> tuple[DataFrame, DataFrame]:
    """(truth, found) as (image, label, box, id[, score]) with corner boxes, from COCO annotations and a results list."""
    corners = lambda b: F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])
    a = spark.read.json(truth, multiLine=True).select(F.explode("annotations").alias("a")).select("a.*")
    r = spark.read.json(results, multiLine=True)
    t = a.select(F.col("image_id").cast("long").alias("image"), F.col("category_id").cast("int").alias("label"), corners(F.col("bbox")).alias("box"), F.col("id").cast("long").alias("id"))
    return t, r.select(F.col("image_id").cast("long").alias("image"), F.col("category_id").cast("int").alias("label"), corners(F.col("bbox")).alias("box"), F.col("score").cast("double").alias("score"), F.monotonically_increasing_id().alias("id"))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(image, y, row) of label masks in ``.npy`` and ``.npz`` files of a folder or pattern: a row for each line of pixels, so no mask is
    one value. ``image`` is the file's name without its extension, ``/``, and for an ``.npz`` the array's name; an array of three
    dimensions is a stack, whose number is added.

    Files are Spark's own binary source, so they are read by tasks from any file system that Spark reads, and the driver sees
    names only. Pixels must be integers or booleans. Files of Python objects are refused.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), (c.as_py() for c in batch.column(1)), strict=True):
                stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                found = np.load(io.BytesIO(content), allow_pickle=False)
                members = {stem: found} if isinstance(found, np.ndarray) else {f"{stem}/{k}": found[k] for k in found.files}
                for member, array in members.items():
                    if array.ndim not in (2, 3) or array.dtype.kind not in "iub":
                        raise ValueError(f"{member}: a mask has two or three dimensions of integers")
                    stack = {member: array} if array.ndim == 2 else {f"{member}/{i}": a for i, a in enumerate(array)}
                    for image, mask in stack.items():
                        lines = pa.FixedSizeListArray.from_arrays(pa.array(mask.astype(np.int32).ravel()), max(mask.shape[1], 1)).cast(pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array([image] * len(lines)), pa.array(range(len(lines)), pa.int32()), lines], names=["image", "y", "row"])

    return files.mapInArrow(run, "image string, y int, row array<int>")


def mask_pixels(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(image, y, x, t, p) of the masks of ``read_masks`` that are in both, matched by image and line; lines must be as long."""
    both = truth.select("image", "y", F.col("row").alias("t")).join(found.select("image", "y", F.col("row").alias("p")), ["image", "y"])
    same = F.assert_true(F.size("t") == F.size("p"), F.concat(F.lit("lines of different length: "), F.col("image")))
    return both.filter(same.isNull()).select("image", "y", F.posexplode(F.arrays_zip("t", "p")).alias("x", "c")).select("image", "y", "x", "c.t", "c.p")
