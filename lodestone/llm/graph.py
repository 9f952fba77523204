"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): the smallest id that can be reached.

    Each round takes the least component among the neighbours and then follows the component's own component (pointer
    jumping), so rounds grow with the logarithm of long chains; a hub's neighbours meet in a partial minimum, never in one
    list. Tables are written between rounds. No links give no rows; a row with a null end is left out.
    """
    ends = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "components")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        closer = written(label.join(near, "id").select("id", "component", F.least("component", "near").alias("next")), "components")
        far = closer.select(F.col("id").alias("next"), F.col("next").alias("far"))
        jumped = written(closer.join(far, "next").select("id", F.col("far").alias("component"), (F.col("component") != F.col("far")).alias("moved")), "components")
        label = jumped.select("id", "component")
        if jumped.filter("moved").isEmpty():
            return label
