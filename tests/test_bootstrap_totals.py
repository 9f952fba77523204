from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import statistics


def test_bounds_of_many_replicates_agree_with_the_normal_ones(spark):
    df = spark.range(5000).select((F.col("id") % 10 < 7).cast("int").alias("t"), F.lit(1).alias("p")).union(spark.createDataFrame([(None, 1)], "t int, p int"))
    got = statistics.bootstrap_accuracy(df, "t", "p", replicates=2000).first()
    half = 1.959964 * math.sqrt(0.7 * 0.3 / 5000)
    assert got["estimate"] == pytest.approx(0.7)
    assert got["low"] == pytest.approx(0.7 - half, abs=0.08 * half) and got["high"] == pytest.approx(0.7 + half, abs=0.08 * half)
    assert tuple(statistics.bootstrap_accuracy(df.limit(0), "t", "p").first()) == (None, None, None)
    with pytest.raises(ValueError):
        statistics.bootstrap_accuracy(df, "t", "p", replicates=50)
