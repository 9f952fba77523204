"""Segmentation by the pixel cube, surfaces by image; detection is in ``detection.py``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.contours import contour_cells
from lodestone.operators.detection import average_precisions, detection_average_precision, matched_detections, mean_average_precision
from lodestone.plans.durable import written
from lodestone.plans.patterns import cube, one_vs_rest, ratio

__all__ = ["average_precisions", "boundary_iou", "box_iou", "detection_average_precision", "matched_detections", "mean_average_precision", "pixels", "segmentation_report", "segmentation_scores", "segmentation_summary", "surface_distances"]


def pixels(df: DataFrame, image: str, truth: str, pred: str) -> DataFrame:
    """(image, y, x, t, p) from masks as arrays of rows."""
    rows = df.select(image, F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(pred).alias("p"))).alias("y", "r"))
    return rows.select(image, "y", F.posexplode(F.arrays_zip(F.col("r.t").alias("t"), F.col("r.p").alias("p"))).alias("x", "c")).select(image, "y", "x", "c.t", "c.p")


def segmentation_scores(px: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, iou, dice, recall, support) of each class that is true or predicted (absent ones have no row)."""
    return _scores(cube(px, "t", "p", None, by), by)


def _scores(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``segmentation_scores`` from the weights of the pairs of true and predicted label."""
    c = one_vs_rest(cells, by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, "label", ratio(tp, tp + fp + fn, None).alias("iou"), ratio(2 * tp, 2 * tp + fp + fn, None).alias("dice"), ratio(tp, tp + fn, None).alias("recall"), (tp + fn).alias("support"))


def segmentation_summary(px: DataFrame) -> DataFrame:
    """(miou, dice, mean_pixel_accuracy, pixel_accuracy)."""
    s = segmentation_scores(px).agg(F.avg("iou").alias("miou"), F.avg("dice").alias("dice"), F.avg("recall").alias("mean_pixel_accuracy"))
    return s.crossJoin(px.agg(F.avg((F.col("t") == F.col("p")).cast("double")).alias("pixel_accuracy")))


def _edge(mask: np.ndarray) -> np.ndarray:
    padded = np.pad(mask, 1)
    inner = padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    return np.argwhere(mask & ~inner)


def surface_distances(px: DataFrame, image: str, *, percentile: float = 100.0) -> DataFrame:
    """(image, label, hausdorff, average_surface_distance) of each class but 0; infinite if it is in one mask only. A group
    is one image."""

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["y"].max()) + 1, int(rows["x"].max()) + 1
        t, p = np.zeros((h, w), dtype=int), np.zeros((h, w), dtype=int)
        t[rows["y"], rows["x"]], p[rows["y"], rows["x"]] = rows["t"], rows["p"]
        out = []
        for label in sorted((set(np.unique(t)) | set(np.unique(p))) - {0}):
            a, b = _edge(t == label), _edge(p == label)
            if not len(a) or not len(b):
                out.append((rows[image].iloc[0], int(label), np.inf, np.inf))
                continue
            d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
            ab, ba = d.min(1), d.min(0)
            out.append((rows[image].iloc[0], int(label), max(np.percentile(ab, percentile), np.percentile(ba, percentile)), (ab.sum() + ba.sum()) / (len(ab) + len(ba))))
        return pd.DataFrame(out, columns=[image, "label", "hausdorff", "average_surface_distance"])

    return px.groupBy(image).applyInPandas(measure, f"{image} long, label int, hausdorff double, average_surface_distance double")


def box_iou(a: str, b: str) -> str:
    """SQL for the overlap by union of boxes a and b with columns <a>_x1 ... <b>_y2."""
    inter = f"greatest(least({a}_x2, {b}_x2) - greatest({a}_x1, {b}_x1), 0.0) * greatest(least({a}_y2, {b}_y2) - greatest({a}_y1, {b}_y1), 0.0)"
    area = lambda c: f"({c}_x2 - {c}_x1) * ({c}_y2 - {c}_y1)"
    return f"({inter}) / nullif({area(a)} + {area(b)} - {inter}, 0)"


def boundary_iou(px: DataFrame, image: str = "image", *, ratio_of_diagonal: float = 0.02, ignore: int | None = None, background: int | None = 0) -> DataFrame:
    """(label, boundary_iou, support) of each class but the ``background``: the overlap by union of the pixels of both masks that are
    within d of their contour, counted over all images; d is that share of an image's diagonal, rounded, 1 at least.

    Pixels (image, y, x, t, p) outside the image, or with the true class ``ignore``, belong to no class.
    """
    valid = F.lit(True) if ignore is None else F.col("t") != ignore
    return _boundaries(contour_cells(px.select(image, "y", "x", *(F.when(valid, F.col(c)).alias(c) for c in "tp")), image, ratio_of_diagonal), background)


def _boundaries(cells: DataFrame, background: int | None) -> DataFrame:
    """(label, boundary_iou, support) from ``contour_cells``."""
    each = cells.select(F.inline(F.array(*(F.struct(F.col(n).alias("label"), F.col(f"{n}_edge").alias("edge"), (F.col("both") if n == "t" else F.lit(0).cast("long")).alias("both")) for n in "tp"))))
    c = each.filter("label is not null").groupBy("label").agg(F.sum("edge").alias("edge"), F.sum("both").alias("both"))
    kept = c if background is None else c.filter(F.col("label") != background)
    return kept.select("label", ratio(F.col("both").cast("double"), F.col("edge") - F.col("both"), None).alias("boundary_iou"), (F.col("edge") - F.col("both")).alias("support"))


def segmentation_report(px: DataFrame, image: str = "image", *, ratio_of_diagonal: float = 0.02, background: int | None = 0) -> DataFrame:
    """(label, iou, dice, recall, support, boundary_iou) of each class that is true or predicted, without the ``background``."""
    cells = written(contour_cells(px, image, ratio_of_diagonal), "cells")  # a row for each pair of classes, of one pass over the pixels
    scores = _scores(cells.select("t", "p", F.col("pixels").cast("double").alias("w")))
    kept = scores if background is None else scores.filter(F.col("label") != background)
    return kept.join(_boundaries(cells, background).drop("support"), "label", "left")  # a row for each class
