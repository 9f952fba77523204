"""Registered queries of detection and masks beyond the basic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import detection, vision
from lodestone.queries import _PX, _pixels, query, view


def _scenes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """True and found boxes of all areas, 40 true ones an image: each 13th is a crowd, each 9th has an area of its own; each box is found
    once, each 4th twice, each 11th in another place and each 17th with another label."""
    view(spark, d, "part")
    base = "select p_partkey div 40 as image, cast(p_partkey % 3 as int) as label, p_partkey as id, cast(p_partkey % 400 as double) as x, cast(p_partkey * 7 % 400 as double) as y, p_size * 3 + 10.0D as s, cast(p_partkey % 7 - 3 as double) as j from part"
    t = spark.sql(f"select image, label, array(x, y, x + s, y + s) as box, id, id % 13 = 0 as crowd, case when id % 9 = 0 then s * s * 0.7D end as area from ({base})")
    twice = f"select *, explode(case when id % 4 = 0 then array(0, 1) else array(0) end) as k from ({base})"
    f = spark.sql(f"select image, case when id % 17 = 0 then 3 else label end as label, array(x + u, y + j, x + u + s, y + j + s) as box, (id * 31 + k * 577) % 1000 / 1000.0D as score, id * 2 + k as id from (select *, j * (k + 1) + case when id % 11 = 0 then 300 else 0 end as u from ({twice}))")
    return t, f


query("detection_report")(lambda s, d: detection.detection_report(*_scenes(s, d)))
query("detection_by_class")(lambda s, d: detection.detection_by_class(*_scenes(s, d)))
query("detection_pr_curve")(lambda s, d: detection.detection_pr_curve(*_scenes(s, d)))
query("detection_average_precision_voc")(lambda s, d: detection.detection_average_precision(*_scenes(s, d), interpolation="voc"))

_NEAR = "b as (select a.image, a.y, a.x, min(a.t) as t, min(a.p) as p, count(*) filter (where n.t = a.t) < 25 as bt, count(*) filter (where n.p = a.p) < 25 as bp from px a left join px n on n.image = a.image and n.y between a.y - 2 and a.y + 2 and n.x between a.x - 2 and a.x + 2 group by a.image, a.y, a.x), e as (select t as label, bt::bigint as edge, (bt and bp and t = p)::bigint as both_ from b union all select p, bp::bigint, 0 from b), z as (select label, sum(both_)::bigint as i, (sum(edge) - sum(both_))::bigint as u from e where label <> 0 group by label)"
query("boundary_iou", f"with {_PX}, {_NEAR} select cast(label as int) as label, round(i * 1e0 / u, 6) as boundary_iou, u as support from z")(lambda s, d: vision.boundary_iou(_pixels(s, d), ratio_of_diagonal=0.05))
query("segmentation_report", f"with {_PX}, {_NEAR} select cast(k.label as int) as label, round(tp / (tp + fp + fn), 6) as iou, round(2 * tp / (2 * tp + fp + fn), 6) as dice, round(tp / (tp + fn), 6) as recall, round(tp + fn, 6) as support, round(i * 1e0 / u, 6) as boundary_iou from k left join z on z.label = k.label where k.label <> 0")(lambda s, d: vision.segmentation_report(_pixels(s, d), ratio_of_diagonal=0.05))
