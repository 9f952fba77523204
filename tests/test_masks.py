"""Boundaries by loops over squares, and masks from files."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import contours, vision
from lodestone.sources.readers import mask_pixels, read_masks


def edge(mask, d):
    h, w = mask.shape
    out = mask.copy()
    for y, x in np.argwhere(mask):
        if d <= y < h - d and d <= x < w - d and mask[y - d : y + d + 1, x - d : x + d + 1].all():
            out[y, x] = False
    return out


@pytest.mark.parametrize(("share", "ignore"), [(0.02, None), (0.12, None), (0.2, 3), (0.3, None)])
def test_boundary_iou_equals_loops(spark, share, ignore):
    rng = np.random.default_rng(1)
    images = []
    for h, w in ((9, 14), (16, 16), (5, 30), (1, 1), (12, 3)):
        t = np.kron(rng.integers(0, 4, (math.ceil(h / 6), math.ceil(w / 7))), np.ones((6, 7), dtype=int))[:h, :w]
        p = np.where(rng.random((h, w)) < 0.05, rng.integers(0, 4, (h, w)), np.roll(t, 1, 1))
        images.append((t, p))
    both, union = np.zeros(4), np.zeros(4)
    for t, p in images:
        d = max(1, round(share * math.hypot(*t.shape)))
        valid = np.ones(t.shape, bool) if ignore is None else t != ignore
        for c in range(4):
            a, b = edge((t == c) & valid, d), edge((p == c) & valid, d)
            both[c] += (a & b).sum()
            union[c] += (a | b).sum()
    rows = [(i, y, x, int(t[y, x]), int(p[y, x])) for i, (t, p) in enumerate(images) for y in range(t.shape[0]) for x in range(t.shape[1])]
    df = spark.createDataFrame(rows, "image long, y int, x int, t int, p int").repartition(3)
    got = {r["label"]: (r["boundary_iou"], r["support"]) for r in vision.boundary_iou(df, ratio_of_diagonal=share, ignore=ignore, background=None).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {c: (pytest.approx(both[c] / union[c]), union[c]) for c in range(4) if union[c]}
    assert set(vision.segmentation_report(df).toPandas()["label"]) == {1, 2, 3}


def test_masks_from_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    one, stack, named = rng.integers(0, 5, (4, 6)), rng.integers(0, 2, (3, 2, 5)).astype(bool), {"a": rng.integers(0, 9, (2, 2)).astype(np.uint8), "b": rng.integers(0, 9, (3, 1))}
    np.save(tmp_path / "one.npy", one)
    np.save(tmp_path / "many.npy", stack)
    np.savez(tmp_path / "some.npz", **named)
    (tmp_path / "other.txt").write_text("no mask")
    masks = read_masks(spark, str(tmp_path))
    got = {}
    for r in masks.orderBy("image", "y").collect():
        got.setdefault(r["image"], []).append(r["row"])
    want = {"one": one, "some/a": named["a"], "some/b": named["b"]} | {f"many/{i}": m for i, m in enumerate(stack)}
    assert got == {k: v.astype(int).tolist() for k, v in want.items()}
    px = mask_pixels(masks, masks.filter("image <> 'some/a'"))
    assert px.count() == sum(v.size for k, v in want.items() if k != "some/a") and px.filter("t <> p").isEmpty()
    assert vision.segmentation_summary(px).first()["pixel_accuracy"] == 1.0


def test_odd_masks_are_refused(spark, tmp_path):
    np.save(tmp_path / "float.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="two or three dimensions"):
        read_masks(spark, str(tmp_path)).collect()


def test_boundary_iou_sends_no_pixels_to_all_tasks(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "images"))
    px = spark.read.parquet(str(tmp_path / "images")).selectExpr("id as image", "explode(sequence(0, 9)) as y").selectExpr("image", "y", "explode(sequence(0, 9)) as x", "cast(image % 2 as int) as t", "1 as p")
    plan = vision.boundary_iou(px)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan  # a small file holds many pixels: they were broadcast


def test_segmentation_report_sends_no_pixels_to_all_tasks(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "images"))
    px = spark.read.parquet(str(tmp_path / "images")).selectExpr("id as image", "explode(sequence(0, 9)) as y").selectExpr("image", "y", "explode(sequence(0, 9)) as x", "cast(image % 3 as int) as t", "1 as p")
    report = vision.segmentation_report(px)
    # The one join by which all pixels could be sent was that on the image.
    assert "[image" not in "".join(line for line in report._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
    assert {r["label"]: (r["iou"], r["support"]) for r in report.collect()} == {1: (pytest.approx(2 / 6), 200.0), 2: (0.0, 200.0)}


def test_segmentation_report_reads_pixels_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    px = spark.range(3).selectExpr("id as image", "explode(sequence(0, 9)) as y").selectExpr("image", "y", "explode(sequence(0, 9)) as x", "cast(image as int) as t", "1 as p")
    report = vision.segmentation_report(px.mapInArrow(counted, px.schema)).collect()
    assert {r["label"]: r["iou"] for r in report} == {1: pytest.approx(1 / 3), 2: 0.0}
    assert seen.value == 300


@pytest.mark.parametrize("share", [0.05, 0.3])
def test_contours_by_bands_equal_loops(spark, monkeypatch, share):
    monkeypatch.setattr(contours, "STRIP", 2)
    monkeypatch.setattr(contours, "BAND", 3)
    monkeypatch.setattr(contours, "PIXELS", 50)
    rng = np.random.default_rng(5)
    images = {None: (31, 6), "a": (8, 8), "b": (1, 9), "c": (13, 2)}
    rows, both, union = [], {c: 0 for c in "uvw"}, {c: 0 for c in "uvw"}
    for name, (h, w) in images.items():
        t = np.array(list("uvw"))[np.kron(rng.integers(0, 3, (math.ceil(h / 7), 2)), np.ones((7, 5), dtype=int))[:h, :w]]
        p = np.where(rng.random(t.shape) < 0.03, "w", t)
        there = rng.random(t.shape) < 0.98  # pixels that are not there have no class
        rows += [(name, y, x, str(t[y, x]), str(p[y, x])) for y in range(h) for x in range(w) if there[y, x]]
        bottom, right = np.argwhere(there).max(0)
        d = max(1, round(share * math.hypot(bottom + 1, right + 1)))
        for c in "uvw":
            a, b = edge((t == c) & there, d), edge((p == c) & there, d)
            both[c] += (a & b).sum()
            union[c] += (a | b).sum()
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], "image string, y int, x int, t string, p string").repartition(3)
    got = {r["label"]: (r["boundary_iou"], r["support"]) for r in vision.boundary_iou(df, ratio_of_diagonal=share, background=None).collect()}
    assert got == {c: (pytest.approx(both[c] / union[c]), union[c]) for c in "uvw"}
    cells = contours.contour_cells(df, "image", share).agg(F.sum("pixels")).first()[0]
    assert cells == len(rows)
