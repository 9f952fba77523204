from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import queries
from lodestone.operators import vision


def test_no_detection_is_dropped_as_the_table_grows(spark, tmp_path):
    spark.range(1, 16001).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    truth, found = queries._boxes(spark, str(tmp_path))
    most = truth.groupBy("image", "label").count().agg(F.max("count")).first()[0]
    assert most <= 100 and vision.matched_detections(truth, found).count() == 16000
